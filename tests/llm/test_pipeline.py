import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np

import corpus_pipeline
from plumbline.llm import toxicity
from plumbline.llm.common import stored
from tests.llm.conftest import SCHEMA, lowered, prose, words_of
from tests.llm.test_mixing import water
from tests.llm.test_near_dedup import shingles


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    bench = [prose(rng, 30) for _ in range(4)]
    texts = [prose(rng, rng.randint(30, 90)) for _ in range(200)]
    texts[1] = texts[0]
    texts[2] = texts[2] + " " + bench[0] + " tail"
    for i in range(10, 200, 10):
        texts[i] += " grumblewort snarkfin dolthead"
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0 and i > 0)) for i in range(0, 200, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "token_records":
            assert docs.columns == columns
    assert sum(i % 10 == 0 and i > 0 for i in seen["toxicity"]) <= 4 and len(seen["toxicity"]) >= 178
    assert 1 not in seen["near_dedup"] and 0 in seen["near_dedup"]
    assert bench[0] not in seen["decontamination"][2]["text"] and set(seen["decontamination"]) == set(seen["near_dedup"])
    assert set(seen["token_records"]) == set(seen["mixing"])


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_records"]


def tables(spark, path, rows, schema, labels, bench):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def deduplicated(rows):
    """The rows whose doc_id is the least of their component at 80 %."""
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    return [r for i, r in enumerate(rows) if r[0] == min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))]


def cleaned(text, items):
    """text without the words that windows of ten item words cover, and what the cut leaves between the others."""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))]
    w = [lowered(text)[a:b] for a, b in places]
    windows = {tuple(x[i : i + 10]) for x in (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)) for t in items) for i in range(len(x) - 9)}
    hit = {p for i in range(len(w) - 9) if tuple(w[i : i + 10]) in windows for p in range(i, i + 10)}
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at : places[i][0]])
        at = places[i][1]
    return "".join([*out, text[at:]])


def mixed(rows):
    """(doc_id, text) as often as the budgets take them."""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    targets, out = water(sizes), []
    for source in sizes:
        budget, before = int(targets[source] + 0.5), 0
        rounds, rest = divmod(budget, sizes[source])
        for doc_id, text, _ in sorted((r for r in rows if r[2] == source), key=lambda r: hashlib.md5(f"{r[0]}:0".encode()).hexdigest()):
            n = len(words_of(text))
            part = min(max(rest - before, 0), n)
            before += n
            out += [(doc_id, text)] * (rounds + (part == n and n > 0))
            if 0 < part < n:
                out.append((doc_id, text[: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)][part - 1]]))
    return out


def test_against_brute_force(spark, tmp_path):
    """All five stages by plain loops, from the same scorer on."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(19)
    bench = [prose(rng, 30) for _ in range(4)]
    texts = [prose(rng, rng.randint(8, 120)) for _ in range(150)]
    texts[1], texts[3] = texts[0], f"{texts[2]} more"
    texts[4] = f"{texts[4]}, {bench[0].upper()}\n tail"
    texts[5] = " ".join(texts[6].split()[:-1])
    for i in range(10, 150, 10):
        texts[i] += " grumblewort snarkfin dolthead"
    rows = [(i, t, "en", f"s{i % 4}" if i < 140 else "tiny", len(t)) for i, t in enumerate(texts)]
    tables(spark, tmp_path, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint", [(i, 1, int(i % 10 == 0 and i > 0)) for i in range(0, 150, 2)], list(enumerate(bench)))
    scorer = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = deduplicated([(i, t, s) for i, t, _, s, _ in rows if scorer.score(t) < 0.5])
    assert 120 < len(left) < 140
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for doc_id, text in mixed([(i, cleaned(t, bench), s) for i, t, s in left]):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(expected)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)


def test_odd_rows(spark, tmp_path, rows):
    """Nulls in any column, blank and very long texts, ties, repeated rows and clashing names pass all stages."""
    tables(spark, tmp_path, rows, SCHEMA, [(i, None, int(i == 9)) for i in (1, 2, 9, 9)] + [(None, 1, 1), (3, 1, None)], [(1, None), (None, "one"), (2, "...")])
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, str(tmp_path)), name)
        if name != "token_records":
            assert docs.columns == before.columns
        kept[name] = docs.count()
    assert kept["near_dedup"] <= kept["toxicity"] <= len(rows) and kept["decontamination"] == kept["near_dedup"]
    assert kept["token_records"] == kept["mixing"] > 0


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], SCHEMA, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
