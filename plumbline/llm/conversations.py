"""Repair of conversation structure by a lazily determinised weighted automaton (operator 11).

A repaired conversation's roles start with one letter each and read `(s?(ua)+)?`. The edits of a row are arcs of a weighted automaton with
the states START, SYSTEM (after s), USER (after u) and ASSISTANT (after a): Keep, Rerole, Delete, and Insert between rows. The costs of all
states after a row, less the least of them, are one state of the determinised automaton; costs that no cheapest edit can come back from are
left out, so states are few. They are made when a row first needs them and kept in a transition table, so a conversation's cost is one
look-up a row. The audit follows from the tight arcs, those that some cheapest edit uses: they are marked from the last row back, each mark
being kept in a table too, and the letters are then read off, the ASCII-least tight one first. Given the letters, the roles are fixed.

Rows reach the automaton as one byte each; a conversation's bytes, states and marks take about as much memory as the audit that is
asked for. Texts meet the audit only afterwards, in order and one by one, so long conversations and texts are never held as a whole.

Defined results: conversations are told apart by conv_id, null being one of its own; rows stand in the order of turn, nulls first, then of
role and of the MD5 of the text, so rows of one turn have an order too, and copies are adjacent; nulls in role and text are
one space, which is no role and blank; an empty role has no first letter and can't be kept; a repeated row is a duplicate; turns that lie
2**63 or more apart make gaps wrap; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, stored, table

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ACCEPTING = (START, ASSISTANT)
#: From a state by the first letter of a role; others lead nowhere.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LETTERS = "sua"  # any other letter is number 3
FINE, TRUNCATED, GONE = range(3)  # GONE rows must be deleted
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 60


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass
class Repairer:
    """The determinised automaton, as far as it has been needed. A row's symbol: 3 * (number of its letter) + its fault."""

    costs: Costs = Costs()
    vectors: list[tuple[int, ...]] = field(default_factory=list)
    numbers: dict[tuple[int, ...], int] = field(default_factory=dict)
    table: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    marks: dict[tuple[int, int, int], int] = field(default_factory=dict)
    choices: dict[tuple[int, int, int, int], tuple[str, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.first, _ = self._state([0 if q == START else FAR for q in STATES])

    def arcs(self, state: int, symbol: int) -> list[tuple[str, int, int]]:
        """(edit, cost, state after it) of a row, edits ascending."""
        letter, fault = divmod(symbol, 3)
        found = [("D", self.costs.delete, state)]
        if fault != GONE:
            more = self.costs.truncated if fault == TRUNCATED else 0
            if letter < 3 and (state, LETTERS[letter]) in STEP:
                found.append(("K", more, STEP[state, LETTERS[letter]]))
            found += [("R", more + self.costs.rerole, STEP[state, x]) for x in "ua" if (state, x) in STEP]
        return found

    def inserts(self, state: int) -> list[int]:
        return [STEP[state, x] for x in "ua" if (state, x) in STEP]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """(number of the state that these costs are, with inserts; their least). Any state's edits are possible from any other for two inserts and a deletion."""
        for _ in STATES:
            for q in STATES:
                for to in self.inserts(q):
                    costs[to] = min(costs[to], costs[q] + self.costs.insert)
        least = min(costs)
        vector = tuple(c - least if c - least <= 2 * self.costs.insert + self.costs.delete else FAR for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, cost) from the table; a new entry where a row needs one."""
        found = self.table.get((state, symbol))
        if found is None:
            after = [FAR] * 4
            for q in STATES:
                if self.vectors[state][q] < FAR:
                    for _, cost, to in self.arcs(q, symbol):
                        after[to] = min(after[to], self.vectors[state][q] + cost)
            found = self.table[state, symbol] = self._state(after)
        return found

    def scan(self, symbols: bytes) -> tuple[int, array]:
        """(cost of the cheapest edits, states after each row)."""
        state, total, states = self.first, 0, array("l", [self.first])
        for symbol in symbols:
            state, cost = self.step(state, symbol)
            total += cost
            states.append(state)
        return total + min(self.vectors[state][q] for q in ACCEPTING), states

    def _with_inserts(self, state: int, marked: int) -> int:
        """marked, and the states from which a tight insert leads there."""
        costs = self.vectors[state]
        for _ in STATES:
            for q in STATES:
                if any(marked >> to & 1 and costs[q] + self.costs.insert == costs[to] for to in self.inserts(q)):
                    marked |= 1 << q
        return marked

    def _mark(self, state: int, symbol: int, after: int) -> int:
        """States before a row from which a tight arc leads to one that is marked after it."""
        found = self.marks.get((state, symbol, after))
        if found is None:
            to_state, least = self.step(state, symbol)
            found = 0
            for q in STATES:
                cost = self.vectors[state][q]
                if cost < FAR and any(after >> to & 1 and cost + more == self.vectors[to_state][to] + least for _, more, to in self.arcs(q, symbol)):
                    found |= 1 << q
            found = self.marks[state, symbol, after] = self._with_inserts(state, found)
        return found

    def _choose(self, state: int, symbol: int, after: int, q: int) -> tuple[str, int]:
        """(letters, state after the row) of the ASCII-least tight way past a row, inserts before it included."""
        found = self.choices.get((state, symbol, after, q))
        if found is None:
            to_state, least = self.step(state, symbol)
            before, costs, letters, at = self._mark(state, symbol, after), self.vectors[state], "", q
            while True:
                tight = [(edit, to) for edit, more, to in self.arcs(at, symbol) if after >> to & 1 and costs[at] + more == self.vectors[to_state][to] + least]
                tight += [("I", -1 - to) for to in self.inserts(at) if before >> to & 1 and costs[at] + self.costs.insert == costs[to]]
                edit, to = min(tight)
                letters += edit
                if edit != "I":
                    break
                at = -1 - to
            found = self.choices[state, symbol, after, q] = letters, to
        return found

    def audit(self, symbols: bytes, states: array) -> str:
        """The ASCII-least cheapest edits, from the states of a scan."""
        costs = self.vectors[states[-1]]
        least = min(costs[q] for q in ACCEPTING)
        mark = self._with_inserts(states[-1], sum(1 << q for q in ACCEPTING if costs[q] == least))
        marks = bytearray(len(symbols) + 1)
        marks[-1] = mark
        for i in range(len(symbols) - 1, -1, -1):
            marks[i] = mark = self._mark(states[i], symbols[i], mark)
        out, q = [], START
        for i, symbol in enumerate(symbols):
            letters, q = self._choose(states[i], symbol, marks[i + 1], q)
            out.append(letters)
        while costs[q] != least or q not in ACCEPTING:  # inserts at the end
            q = next(to for to in self.inserts(q) if marks[-1] >> to & 1 and costs[q] + self.costs.insert == costs[to])
            out.append("I")
        return "".join(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls of role and text as one space and a fault in every fourth row: by the CRC-32 of `conv_id:turn`, rows are dropped, emptied, cut of their full stops, repeated or said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


ORDER = ("turn", "role", "digest")


def _keyed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text), nulls in role and text as one space."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))


def _letter(role: str) -> int:
    return LETTERS.find(role[0]) % 4 if role else 3


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


AUDIT = "conv_id bigint, n bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _audited(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple]:
    """Rows of AUDIT from rows (conv_id, turn, role, digest, fault) in order; fault: 1 blank, 2 seen in an earlier turn, 3 truncated, else 0."""
    repairer, of, open_ = Repairer(costs), None, False
    symbols, counts, illegal = bytearray(), [0] * 4, 0
    low = high = last = before = None
    turns = 0

    def done() -> tuple:
        cost, states = repairer.scan(symbols)
        gaps = (high - low + 1 - turns + (1 << 63)) % (1 << 64) - (1 << 63) if turns else 0
        return of, len(symbols), gaps, counts[1], counts[2], counts[3], illegal, cost, repairer.audit(symbols, states)

    for conv, turn, role, digest, fault in _lists(batches):
        if not open_ or conv != of:
            if open_:
                yield done()
            of, open_, symbols, counts, illegal, turns, low, high, last, before = conv, True, bytearray(), [0] * 4, 0, 0, None, None, None, None
        if turn is not None and (not turns or turn != high):
            low, high, turns = turn if low is None else low, turn, turns + 1
        if fault != 1 and (turn, role, digest) == before:
            fault = 2
        before, letter = (turn, role, digest), _letter(role)
        if last is not None and (last, letter) not in ((0, 1), (1, 2), (2, 1)):
            illegal += 1
        last = letter
        counts[fault] += 1
        symbols.append(3 * letter + (0, GONE, GONE, TRUNCATED)[fault])
    if open_:
        yield done()


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows in batches of at most 1,000 rows and about 1 MB of their strings."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= 1000 or size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _stream(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str) -> DataFrame:
    """mapInArrow of a generator of rows."""
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])
    return small_batches(df).mapInArrow(lambda batches: _batched(rows(batches), schema), ddl)


def audits(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, n, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of rows (conv_id, turn, role, text)."""
    keyed = _keyed(rows)
    narrow = keyed.withColumn("bare", F.rtrim("text", F.lit(SPACE))).select("conv_id", *ORDER, F.when(F.col("bare") == "", 1).when(F.right("bare", F.lit(1)).isin(".", "!", "?"), 0).otherwise(3).alias("fault"))
    seen = narrow.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"), F.lit(True).alias("again"))
    joined = narrow.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when((F.col("fault") != 1) & later, 2).otherwise(F.col("fault")).cast("bigint")
    ordered = joined.select("conv_id", *ORDER, fault.alias("fault")).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return _stream(ordered, lambda batches: _audited(batches, costs), AUDIT)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, edit, turn, role, text) of repaired rows from rows (conv_id, met, turn, role, digest, text), a conversation's audit being the text of its first; and (conv_id, None, ...) after its last row."""
    of, letters, q, at, place, open_ = None, "", START, 0, 0, False

    def inserted() -> Iterator[tuple]:
        nonlocal q, at, place
        while at < len(letters) and letters[at] == "I":
            role = "assistant" if q == USER else "user"
            yield of, place, "I", None, role, ""
            q, at, place = STEP[q, role[0]], at + 1, place + 1

    def ended() -> Iterator[tuple]:
        yield from inserted()
        yield of, None, None, None, None, None

    for conv, met, turn, role, _, text in _lists(batches):
        if not met:
            if open_:
                yield from ended()
            of, letters, q, at, place, open_ = conv, text, START, 0, 0, True
            continue
        yield from inserted()
        edit, at = letters[at], at + 1
        if edit == "D":
            continue
        if edit == "R":
            role = "assistant" if q == USER else "user"
        yield of, place, edit, turn, role, text
        q, place = STEP[q, role[0]], place + 1
    if open_:
        yield from ended()


def _with_audits(rows: DataFrame, audited: DataFrame) -> DataFrame:
    columns = ("conv_id", "met", *ORDER, "text")
    texts = _keyed(rows).withColumn("met", F.lit(1)).select(*columns)
    first = audited.select("conv_id", F.lit(0).alias("met"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    return first.unionAll(texts).repartition("conv_id").sortWithinPartitions("conv_id", "met", *ORDER)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows after repair in the order of place; audited: `audits` of the rows."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return (row for row in _walked(batches) if row[1] is not None)

    return _stream(_with_audits(rows, audited), kept, "conv_id bigint, place bigint, edit string, turn bigint, role string, text string")


def digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired rows, `role:text` joined by newlines."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for conv, place, _, _, role, text in _walked(batches):
            if place is None:
                yield conv, digest.hexdigest()
                digest = hashlib.sha256()
            else:
                digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())

    return _stream(_with_audits(rows, audited), hashed, "conv_id bigint, repaired_sha256 string")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    audited = stored(audits(rows), "audits")
    found = audited.join(digests(rows, audited).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
