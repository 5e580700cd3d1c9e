import random
import re

import pytest

WORDS = [a + b for a in ("ba", "ke", "lo", "mu", "ri", "sa", "to", "ve", "zi", "no") for b in ("n", "rt", "st", "m", "l")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, node string, twin string, bucket int, kept string, taken int"


@pytest.fixture(scope="session")
def rows():
    """Texts of every kind: null, blank, short, long, copies, near copies, shared passages; odd ids and sources."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [None, "", " \t\n", "one", "two words", base, base, base + " tail", base.upper(), prose(rng, 30), passage, prose(rng, 40) + " " + passage + " " + prose(rng, 40), "x" * 5000, prose(rng, 30_000), passage + " " + passage, "café über x\n\ny  z "]
    near = base.split()
    near[60] = "changed"
    texts += [" ".join(near), *(prose(rng, rng.randint(15, 80)) for _ in range(40))]
    out = [(i, t, "en", None if i % 7 == 3 else "big" if i % 2 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out += [(None, base, "en", None, 1), (5, base, "en", "big", 1), (7, prose(rng, 25), "en", "s1", 1)]
    return [(*r, "clash", "clash", "clash", 1, "clash", 2) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
