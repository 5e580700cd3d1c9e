"""Token ids as length-delimited binary records (operator 7).

A record file is a run of frames, each
    length   8 bytes, little-endian: bytes of the body
    check    4 bytes: masked CRC-32 of those 8 bytes
    body     doc_id (8 bytes, signed), flags (1 byte: 1 if doc_id is null, 2 if ids take 4 bytes), then the ids
    check    4 bytes: masked CRC-32 of the body
    newline  1 byte
The mask rotates a CRC right by 15 bits and adds a constant, so that checksums of data which hold checksums stay sound.
Ids take two bytes where the vocabulary allows it, else four. Files are named by the order of their documents; frames
are in ascending doc_id order. Beside them stands an offset index (Parquet: file, doc_id, offset, length, n_tokens, in_file,
ids_crc32), made by reading the files back once, so that single records can be read in any order. Spark's own writer commits the files, so lost executors do no harm, and any
file system that Spark knows will do.

Defined results: null text is an empty text and holds the end id only; equal doc_ids stand side by side, ordered by a
hash of their text; null doc_ids come first; an empty table makes an empty file set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import arrow_map, new_path, table
from plumbline.llm.words import span_hashes

END_ID = 2
#: Text bytes a record file is made of; a file is read back as a whole.
FILE_BYTES = 16 << 20
#: Words whose ids a worker remembers before it starts afresh, at about 35 bytes a word.
CACHE_WORDS = 2_000_000
#: Bytes of text whose words are looked up at once.
PART_BYTES = 1 << 20
MASK_DELTA = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool = False) -> bytes:
    body = struct.pack("<qB", doc_id or 0, (doc_id is None) | wide << 1) + ids
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked_crc(length)), body, struct.pack("<I", masked_crc(body)), b"\n"))


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of every frame; a wrong checksum is an error."""
    view, at = memoryview(data), 0
    while at < len(view):
        head = bytes(view[at : at + 8])
        n = struct.unpack("<Q", head)[0]
        if masked_crc(head) != struct.unpack_from("<I", view, at + 8)[0]:
            raise ValueError(f"length checksum at {at}")
        body = view[at + 12 : at + 12 + n]
        if masked_crc(body) != struct.unpack_from("<I", view, at + 12 + n)[0]:
            raise ValueError(f"body checksum at {at}")
        doc_id, flags = struct.unpack_from("<qB", body)
        yield at, n + 17, None if flags & 1 else doc_id, np.frombuffer(body, dtype="<u4" if flags & 2 else "<u2", offset=9)
        at += n + 17


class Encoder:
    """Ids of texts, word by word through a bounded memory of words.

    In byte-level vocabularies a space or line feed between two characters that are no white space begins a pre-token, and
    a line feed there is one by itself. So the ids of a text whose only white space are such single characters are those
    of its words, each with the space or line feed before it. Any other text is encoded whole.

    Words are looked up by 64-bit hashes, all of a part of text at once; a word's ids lie in one flat array, from which those of all words are taken together.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.wide = size > 0xFFFF
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.end = np.array([END_ID], dtype=self.dtype).tobytes()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.begins = {" ": np.array([n.startswith("\u0120") for n in names]), "\n": np.array([n.startswith("\u010a") for n in names])}
        #: Texts that hold a special token's string are encoded whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        #: Ascending hashes of known words with what is before them, where their ids begin in flat, and how many they are.
        self.keys, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, self.dtype)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _learnt(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words that follow a space or line feed, which a line feed's words begin with: texts of many, cut where ids begin with that."""
        data, counts = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            ids = self.ids("".join(part))
            cuts = np.flatnonzero(self.begins[before][ids])
            if len(cuts) != len(part):
                raise ValueError("the vocabulary does not begin a token at each space")
            data.append(ids)
            counts.append(np.diff(np.append(cuts, len(ids))))
        return np.concatenate(data), np.concatenate(counts)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Remembers words, each with the space or line feed before it, by their ascending hashes."""
        for before in " \n":
            chosen = np.array([i for i, w in enumerate(words) if w[0] == before], dtype=np.int64)
            ids, n = self._learnt([words[i] for i in chosen.tolist()], before)
            at = len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.keys, hashes[chosen])  # hashes ascend
            self.keys, self.at, self.n = (np.insert(old, place, new) for old, new in ((self.keys, hashes[chosen]), (self.at, at), (self.n, n)))

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words one after another, where each word's begin, where each word begins in data) of text that starts with a space or line feed."""
        buf = np.frombuffer(data, dtype=np.uint8)
        starts = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
        ends = np.append(starts[1:], len(buf))
        keys, first, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        while True:
            place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
            if not new.any():
                break
            if len(self.keys) > CACHE_WORDS:  # all words of this part are learnt anew
                self._forget()
                new[:] = True
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self.learn(keys[new], [data[a:b].decode() for a, b in spans])
        n = self.n[place][back]
        ends = np.cumsum(n)
        begins = ends - n
        ids = self.flat[np.repeat(self.at[place][back] - begins, n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, begins, starts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without the end id."""
        out: list[bytes] = [b""] * len(texts)
        run, size = [], 0
        for i, text in enumerate(texts):
            core = text.removesuffix("\n")
            # Equal only if single spaces and line feeds, each between two words, are all the white space there is.
            if not (core != "" and " ".join(core.split()) == core.replace("\n", " ") and not any(s in text for s in self.special)):
                out[i] = self.ids(text).tobytes()
                continue
            # A line feed is put before each text; its id goes again.
            data = b"\n" + text.encode()
            if len(data) > PART_BYTES:
                out[i] = b"".join(self._words(part)[0].tobytes() for part in _parts(data))[self.dtype.itemsize :]
                continue
            if run and size + len(data) > PART_BYTES:
                self._encode_run(run, out)
                run, size = [], 0
            run.append((i, data))
            size += len(data)
        if run:
            self._encode_run(run, out)
        return out

    def _encode_run(self, run: list[tuple[int, bytes]], out: list[bytes]) -> None:
        ids, begins, starts = self._words(b"".join(data for _, data in run))
        cuts = np.cumsum([0] + [len(data) for _, data in run])[:-1]
        first = begins[np.searchsorted(starts, cuts)].tolist()
        for (i, _), a, b in zip(run, first, [*first[1:], len(ids)], strict=True):
            out[i] = ids[a + 1 : b].tobytes()


def _parts(data: bytes) -> Iterator[bytes]:
    """A long text in parts that begin with a space or line feed."""
    at = 0
    while len(data) - at > PART_BYTES:
        end = max(data.rfind(c, at + 1, at + PART_BYTES) for c in (b" ", b"\n"))
        if end < 0:
            end = min((p for c in (b" ", b"\n") if (p := data.find(c, at + PART_BYTES)) >= 0), default=len(data))
        yield data[at:end]
        at = end
    if at < len(data):
        yield data[at:]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Writes docs (doc_id, text) as record files under path, in doc_id order, and their index under path/index."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // FILE_BYTES))
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("twin")).repartitionByRange(parts, "doc_id", "twin").sortWithinPartitions("doc_id", "twin")

    def rows(batch: pa.RecordBatch):
        known = encoder(vocabulary)
        doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for a in range(0, len(doc_ids), 256):
            coded = known.encode([t or "" for t in texts.slice(a, 256).to_pylist()])
            framed = [frame(i, ids + known.end, known.wide)[:-1] for i, ids in zip(doc_ids[a : a + 256], coded, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], names=["frame"])

    framed = arrow_map(ordered.select("doc_id", "text"), rows, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")
    read_frames(spark, path).write.parquet(f"{path}/index")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, offset, length, n_tokens, in_file, ids_crc32) of every record; in_file: ids before it in its file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")

    def rows(batch: pa.RecordBatch):
        for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            out, before = [], 0
            for offset, length, doc_id, ids in frames(content.as_buffer()):
                out.append((name, doc_id, offset, length, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "doc_id", "offset", "length", "n_tokens", "in_file", "ids_crc32"])

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return arrow_map(named, rows, "file string, doc_id bigint, offset bigint, length bigint, n_tokens bigint, in_file bigint, ids_crc32 bigint")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, by the index that was read from the files: start counts the ids of all documents before.

    Totals of files give each file's start; a file stands for FILE_BYTES of text (100 TB are six million), so their
    running sum is small.
    """
    found = spark.read.parquet(f"{path}/index")
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint")
    earlier = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("file_"), F.coalesce(F.sum("file_tokens").over(earlier), F.lit(0)).alias("file_start"))
    return found.join(files, F.col("file") == F.col("file_")).select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def records_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes docs as records in the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "records")
    write_records(docs, path, vocabulary)
    return read_records(docs.sparkSession, path)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return records_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
