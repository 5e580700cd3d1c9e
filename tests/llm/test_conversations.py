import hashlib
import heapq
import random
import zlib

import pytest

from plumbline.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, audit string, digest string, met int, c string"


def brute(rows, costs):
    """(cost, audit, repaired rows) by uniform-cost search over all edits of (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        state = roles if len(roles) < 2 else roles[0] * (roles[0] == "s") + roles[-1]
        if (i, state, len(roles) > 0) in done:
            continue
        done.add((i, state, len(roles) > 0))
        if i == len(rows) and (not roles or roles[-1] == "a"):
            return cost, audit, list(kept)

        def fits(letter, roles=roles):
            return letter in ("s", "u") if not roles else letter == "ua"[roles[-1] == "u"]

        for role in ("user", "assistant"):
            if fits(role[0]):
                heapq.heappush(heap, (cost + costs.insert, audit + "I", i, roles + role[0], (*kept, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + costs.delete, audit + "D", i + 1, roles, kept))
            more = costs.truncated if fault == "truncated" else 0
            if fault in ("", "truncated"):
                if role and fits(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*kept, (role, text))))
                for new in ("user", "assistant"):
                    if fits(new[0]):
                        heapq.heappush(heap, (cost + more + costs.rerole, audit + "R", i + 1, roles + new[0], (*kept, (new, text))))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(C.SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows, costs=C.Costs()):
    """The contract's figures of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    judged = faults(rows)
    cost, audit, kept = brute(judged, costs)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:], strict=False)]
    counts = [sum(f == kind for _, _, f in judged) for kind in ("blank", "duplicate", "truncated")]
    lines = "\n".join(f"{r}:{t}" for r, t in kept)
    return gaps, *counts, sum("".join(p) not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(lines.encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


@pytest.mark.parametrize("costs", [C.Costs(), C.Costs(insert=1), C.Costs(rerole=3, delete=4, insert=2, truncated=1)])
def test_automaton_against_search(costs):
    rng, repairer = random.Random(1), C.Repairer(costs)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), str(i), rng.choice(["", "", "truncated", "blank"])) for i in range(rng.randrange(8))]
        symbols = bytes(3 * C._letter(role) + {"": 0, "truncated": 1, "blank": 2}[fault] for role, _, fault in rows)
        cost, states = repairer.scan(symbols)
        assert (cost, repairer.audit(symbols, states)) == brute(rows, costs)[:2]
    assert len(repairer.vectors) < 200


def test_long_conversations_need_no_more_states():
    rng, repairer = random.Random(2), C.Repairer()
    symbols = bytes(rng.randrange(12) for _ in range(50_000))
    cost, states = repairer.scan(symbols)
    assert len(repairer.vectors) < 200 and len(repairer.audit(symbols, states)) >= 50_000 and cost > 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut", " \t", "", "a " * 50_000 + ".", "fff", "end.\x0c", "é.", None]
    out = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "other"]), rng.choice(texts)))
    out += [out[5], (900, None, None, None), (901, 2**62, "user", "a."), (901, -(2**62), "assistant", "b.")]
    return out


def test_query_against_brute_force(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, "clash", "clash", 1, "clash") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in C.op11_repair(spark, str(tmp_path)).collect()}
    after = damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = [r[1:] for r in after if r[0] == conv]
        want = expected(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        wrapped = (want[0] + 2**63) % 2**64 - 2**63
        assert got[conv] == (wrapped, *want[1:])


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "user", "cut off"), (1, 3, "assistant", "Bye.")], "conv_id bigint, turn bigint, role string, text string")
    audited = C.stored(C.audits(rows), "audits")
    assert [tuple(r)[-2:] for r in audited.collect()] == [(4, "DKDK")]
    got = sorted(map(tuple, C.repaired(rows, audited).collect()))
    assert [r[4] for r in got] == ["user", "assistant"] and got[-1][5] == "Bye."


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op11_repair(spark, str(tmp_path)).count() == 0
