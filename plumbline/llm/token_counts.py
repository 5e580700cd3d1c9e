"""Greedy word-piece counts by a linear longest-match automaton (operator 5).

The vocabulary is a trie. Where the longest match ends inside a longer path, a failure link gives the node to go on from
and a precomputed count says how many pieces were popped on the way, so a word's count takes one pass over its bytes and
no piece is ever built (Song et al., Fast WordPiece Tokenization, 2021).

The pieces are those of a byte-level vocabulary: a word is read as a leading space and its UTF-8 bytes; pieces that begin
with the space start a word, all others continue one. Every single byte is a piece, so each word has a count.

Defined results: null and blank texts have 0 words and 0 pieces; repeated rows are counted each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import arrow_map, table, text_bytes

#: Words whose counts a worker remembers before it starts afresh.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Counts greedy longest-match pieces of a byte string."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        parents, ends = [(0, 0)], [False]
        for piece in sorted({p for p in pieces if p}):
            node = 0
            for byte in piece:
                step = node << 8 | byte
                if step not in self.child:
                    self.child[step] = len(parents)
                    parents.append((node, byte))
                    ends.append(False)
                node = self.child[step]
            ends[node] = True
        self.fail, self.popped = [-1] * len(parents), [0] * len(parents)
        depth = [0] * len(parents)
        for node in range(1, len(parents)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            above, byte = parents[node]
            count, at = self.popped[above], self.fail[above]
            while at >= 0 and (at << 8 | byte) not in self.child:
                count, at = count + self.popped[at], self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.child[at << 8 | byte], count

    def count(self, word: bytes) -> int | None:
        """The number of pieces, or None if the vocabulary can't make the word."""
        child, node, total = self.child, 0, 0
        for byte in word:
            while (step := node << 8 | byte) not in child:
                total += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return None
            node = child[step]
        while node > 0:
            total += self.popped[node]
            node = self.fail[node]
        return total if node == 0 else None


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    """The automaton of a vocabulary file, and a worker's memory of word counts."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    pieces = [bytes(alphabet[c] for c in piece) for piece in vocabulary if all(c in alphabet for c in piece)]
    return Automaton(pieces), {}


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of docs (doc_id, text). vocabulary: a tokenizer file that executors can open."""

    def rows(batch: pa.RecordBatch):
        machine, known = automaton(vocabulary)
        n_words, n_tokens = [], []
        for text in text_bytes(batch.column("text")):
            words = text.split()
            new = set(words).difference(known)
            if len(known) > CACHE_WORDS:
                known.clear()
                new = set(words)
            for word in new:
                known[word] = machine.count(b" " + word)
            n_words.append(len(words))
            n_tokens.append(sum(map(known.__getitem__, words)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return arrow_map(docs.select("doc_id", "text"), rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
