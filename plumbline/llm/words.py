"""Word hashes by numpy: 64 bits a word from prefix sums of a polynomial, no Python work per word.

Two words are taken as equal when their mixed 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from plumbline.llm.common import CHUNK_BYTES

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
GRAM_BASE = 0xC2B2AE3D27D4EB4F | 1
MASK = (1 << 64) - 1

BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((BYTES >= 0x41) & (BYTES <= 0x5A), BYTES + 32, BYTES).astype(np.uint8)
#: `[^\x20\x09-\x0D]+`
BLANK_SPLIT = ~((BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = ((BYTES >= 0x30) & (BYTES <= 0x39)) | ((BYTES >= 0x61) & (BYTES <= 0x7A)) | (BYTES >= 0x80)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U64)


class _Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        return self.up, self.down


_BYTE_POWERS, _GRAM_POWERS = _Powers(BASE), _Powers(GRAM_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _raw(buf: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and unmixed polynomials of the words of buf."""
    if lower:
        buf = LOWER[buf]
    edge = np.zeros(len(buf) + 2, dtype=np.int8)
    edge[1:-1] = is_word[buf]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _BYTE_POWERS.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=total[1:])
    return starts, ends, (total[ends] - total[starts]) * down[starts]


def word_spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and hashes of the words of buf."""
    starts, ends, raw = _raw(buf, is_word, False)
    return starts, ends, mix(raw)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of buf."""
    up, down = _BYTE_POWERS.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def doc_hashes(text: bytes, is_word: np.ndarray = BLANK_SPLIT, lower: bool = False) -> np.ndarray:
    """The word hashes of one text of any length, by segments; a word may cross segments."""
    parts, open_raw, open_len = [], None, 0
    for at in range(0, len(text), CHUNK_BYTES):
        buf = np.frombuffer(text, dtype=np.uint8, count=min(CHUNK_BYTES, len(text) - at), offset=at)
        starts, ends, raw = _raw(buf, is_word, lower)
        if open_len:
            if len(starts) and starts[0] == 0:
                raw[0] = U64((open_raw + pow(BASE, open_len, 1 << 64) * int(raw[0])) & MASK)
                if len(starts) == 1 and ends[0] == len(buf):
                    open_raw, open_len = int(raw[0]), open_len + len(buf)
                    continue
            else:
                parts.append(np.array([open_raw], dtype=U64))
            last_len = int(ends[-1] - starts[-1]) if len(starts) else 0
        else:
            last_len = int(ends[-1] - starts[-1]) if len(starts) else 0
        open_len = 0
        if len(starts) and ends[-1] == len(buf):
            open_raw, open_len, raw = int(raw[-1]), last_len, raw[:-1]
        parts.append(raw)
    if open_len:
        parts.append(np.array([open_raw], dtype=U64))
    return mix(np.concatenate(parts)) if parts else np.empty(0, dtype=U64)


def hashes(texts: Iterable[bytes], is_word: np.ndarray = BLANK_SPLIT, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text's number, word hashes of a run of texts, offset of each text's words and the end): runs of about CHUNK_BYTES."""
    first, run, size = 0, [], 0

    def flush() -> tuple[int, np.ndarray, np.ndarray]:
        buf = np.frombuffer(b"\n".join(run), dtype=np.uint8)
        starts, _, raw = _raw(buf, is_word, lower) if len(buf) else (np.empty(0, np.int64), None, np.empty(0, U64))
        cuts = np.cumsum([0] + [len(t) + 1 for t in run])
        return first, mix(raw), np.searchsorted(starts, cuts)

    for n, text in enumerate(texts):
        if run and size + len(text) > CHUNK_BYTES:
            yield flush()
            first, run, size = n, [], 0
        if len(text) > CHUNK_BYTES:
            found = doc_hashes(text, is_word, lower)
            yield n, found, np.array([0, len(found)])
            first = n + 1
        else:
            run.append(text)
            size += len(text)
    if run:
        yield flush()


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; the order counts."""
    if len(words) < n:
        return np.empty(0, dtype=U64)
    up, down = _GRAM_POWERS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + U64(n))


def spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start up to its end; the order counts, and the length."""
    up, down = _GRAM_POWERS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def other_hashes(words: np.ndarray) -> np.ndarray:
    """Further 64 bits for each word hash, so that what is made of both takes 128."""
    return mix(words ^ U64(0x5851F42D4C957F2D))
