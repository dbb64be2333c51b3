"""Words and rolling hashes of many texts at once, in numpy over the UTF-8 bytes.

All arithmetic is modulo 2**64. A word's hash is the sum of a random value for each pair of
place and byte, then mixed: two different words differ in one such value at least, so that they
agree with a chance of 2**-64, whatever they are. (A polynomial modulo 2**64 would not do: words
made of a Thue-Morse sequence agree for every base.) A window's hash is a Rabin-Karp polynomial
over word hashes, taken from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text whose prefix sums are held at once.
BLOCK = 1 << 20
#: Places of a word whose values are drawn at random, for either of two independent hashes; values of later places are mixed from place and byte.
PLACES = 48
_DRAWN = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64 - 1, (2, PLACES * 256), dtype=np.uint64, endpoint=True)
_LATE = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_STEP = U(0xD1342543DE82EF95)


def _inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.back = U(base), U(_inverse(base))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (self.base, self.back))
        return self.up[:n], self.down[:n]


_WORD_POWERS = _Powers(int(_STEP))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: shifts and odd multiplications."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _classes(inside: bytes | None) -> np.ndarray:
    table = np.ones(256, bool)
    if inside is None:
        table[[32, 9, 10, 11, 12, 13]] = False
    else:
        table[:128] = False
        table[list(inside)] = True
    return table


#: Words as runs of anything but a space and the bytes 9 to 13.
SPACED = _classes(None)
#: Words as runs of ASCII letters and digits (lower-cased before) and all non-ASCII characters.
PLAIN = _classes(b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@dataclass
class Words:
    """Words of a run of documents. ``first[d]:first[d + 1]`` are the words of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    #: A second hash, independent of the first, where it was asked for.
    other: np.ndarray | None = None

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else pc.fill_null(texts, b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _cut(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = table[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Hashes of words, a block of bytes at a time; a block ends with a word."""
    out = [np.empty(len(start), U) for _ in range(lanes)]
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        size = (end[i:j] - start[i:j]).astype(np.int32)
        first = np.cumsum(size) - size
        place = np.arange(size.sum(dtype=np.int64), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        byte = data[place + np.repeat(start[i:j], size)]
        at = (np.minimum(place, PLACES - 1) << 8) | byte
        late = np.flatnonzero(place >= PLACES) if size.max() > PLACES else place[:0]
        for k in range(lanes):
            value = _DRAWN[k][at]
            if len(late):
                value[late] = mix((place[late].astype(U) * U(256) + byte[late]) * _LATE[k] + _LATE[1 - k])
            out[k][i:j] = mix(np.add.reduceat(value, first))
        i = j
    return out


def words(texts: pa.Array, table: np.ndarray = SPACED, lanes: int = 1) -> Words:
    """Words of all texts of an array, with one hash or two; a null text has none."""
    data, at = _bytes_of(texts)
    start, end = _cut(data, at, table) if len(data) else (np.zeros(0, np.int64),) * 2
    return Words(data, start, end, np.searchsorted(start, at).astype(np.int64), *_hashes(data, start, end, lanes))


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``width`` hashes, by position, from prefix sums."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        part = hashes[a : b + width - 1]
        up, down = _WORD_POWERS.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[:-1], out=sums[1:])
        out[a:b] = mix((sums[width:] - sums[: b - a]) * down[: b - a])
    return out


def within(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run of ``width`` words lies in one document, and that document."""
    n = np.maximum(first[1:] - first[:-1] - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    return at, doc


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each document, and the document of each. A document of
    fewer than ``width`` words, but of one at least, has one shingle: all its words."""
    at, doc = within(w.first, width)
    grams = windows(w.hash, width)[at] if len(at) else np.zeros(0, U)
    n = w.first[1:] - w.first[:-1]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.empty(len(short), U)
        for k in range(1, width):
            pick = n[short] == k
            if pick.any():
                extra[pick] = windows(w.hash, k)[w.first[short[pick]]] ^ U(k)
        grams, doc = np.concatenate([grams, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    return grams, doc


def counted(grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with how often each occurs, ordered by both."""
    if not len(grams):
        return grams, doc, np.zeros(0, np.int64)
    order = np.lexsort((grams, doc))
    g, d = grams[order], doc[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
    at = np.flatnonzero(new)
    return g[at], d[at], np.diff(np.concatenate([at, [len(g)]]))


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that texts (the column ``text``) come to about ``most`` bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        a = 0
        while a < batch.num_rows:
            done = size[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(a, b - a)
            a = b
