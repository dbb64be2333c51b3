"""Byte-level BPE by a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace, one slot to a vocabulary entry, no
free slots) finds whole pre-tokens that are in the vocabulary; the slot's bytes are
compared, so that a stranger is never taken for an entry. Tier two: other pre-tokens are
merged on a linked list of bytes, with a heap of (rank, place) that gives the pair to
merge next; a pair that has changed meanwhile is found stale when it comes up.

Cases: a null or empty text has no ids and decodes to no bytes; texts of any length are
read in runs of matches, so a huge one never has all its pre-tokens in memory; an empty
table gives an empty table; equal rows give equal rows. Columns named like the output
are replaced in the result, all others are kept when asked for.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tilewright.llm.kernel import pieces
from tilewright.llm.store import bound_batches

#: Pre-tokens kept between batches by one Python worker, and the longest that is kept.
KEPT, LONG = 700_000, 48
#: Matches of one text that are held at once.
RUN = 1 << 17
#: Largest rank file that is broadcast: vocabularies don't grow with the corpus.
MOST_FILE = 64 << 20
_MASK = (1 << 40) - 1


def read_ranks(path: str) -> bytes:
    """A rank file's bytes: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        data = f.read(MOST_FILE + 1)
    if len(data) > MOST_FILE:
        raise ValueError(f"{path}: a rank file of over {MOST_FILE} bytes isn't broadcast")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _split_hash(token: bytes) -> tuple[int, int, int]:
    x = xxhash.xxh3_128_intdigest(token)
    return x & _MASK, (x >> 40) & _MASK, (x >> 80) & _MASK


def _place(b: int, c: int, d: int) -> int:
    return (((b + d * 0x9E3779B97F) * (c | 1)) & _MASK) >> 8


@dataclass
class PerfectHash:
    """Slots 0 to n - 1, each of one key. ``shift[b] >= 0`` displaces bucket b; ``-1 - slot`` is a lone key's place."""

    shift: list[int]
    keys: list[bytes]

    @classmethod
    def build(cls, keys: list[bytes], per_bucket: int = 2) -> PerfectHash:
        n, m = len(keys), max(1, len(keys) // per_bucket)
        buckets: list[list[tuple[bytes, int, int]]] = [[] for _ in range(m)]
        for key in keys:
            a, b, c = _split_hash(key)
            buckets[a % m].append((key, b, c))
        shift, slots, free = [0] * m, [b""] * n, bytearray(b"\x01") * n
        for i in sorted(range(m), key=lambda i: -len(buckets[i])):
            bucket = buckets[i]
            if len(bucket) < 2:
                break
            for d in itertools.count():
                at = [_place(b, c, d) % n for _, b, c in bucket]
                if len(set(at)) == len(at) and all(free[x] for x in at):
                    break
                if d > 50 * n:
                    raise ValueError("two keys have one hash")
            shift[i] = d
            for x, (key, _, _) in zip(at, bucket, strict=True):
                free[x], slots[x] = 0, key
        left = iter(np.flatnonzero(np.frombuffer(bytes(free), np.uint8)).tolist())
        for i, bucket in enumerate(buckets):
            if len(bucket) == 1:
                x = next(left)
                shift[i], slots[x] = -1 - x, bucket[0][0]
        return cls(shift, slots)

    def slot(self, key: bytes) -> int:
        """The slot of a key, -1 for any other bytes."""
        if not self.keys:
            return -1
        a, b, c = _split_hash(key)
        d = self.shift[a % len(self.shift)]
        x = -1 - d if d < 0 else _place(b, c, d) % len(self.keys)
        return x if self.keys[x] == key else -1


class Codec:
    """Ids of texts, and bytes of ids, for one rank file and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, index: PerfectHash) -> None:
        self.index = index
        self.id_at = [ranks[k] for k in index.keys]
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.token[i] = token
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[int, int] = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = i
        self.pattern = regex.compile(pattern)
        self.easy = _easy(pattern)
        self.known: dict[str, bytes] = {}

    def merge(self, token: bytes) -> list[int]:
        """Tier two: the lowest rank first, the leftmost of equals first."""
        ids = [self.byte_id[b] for b in token]
        n, pair = len(ids), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pair.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or pair.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := pair.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def ids_of(self, piece: str) -> bytes:
        token = piece.encode("utf-8", "surrogatepass")
        slot = self.index.slot(token)
        return np.asarray([self.id_at[slot]] if slot >= 0 else self.merge(token), "<u4").tobytes()

    def split(self, text: str) -> Iterator[list[str]]:
        """Matches of the pattern, in runs."""
        pattern = self.easy if self.easy and not _HARD.search(text) else self.pattern
        if len(text) <= RUN:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while run := list(itertools.islice(found, RUN)):
                yield run

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.known
        for run in self.split(text) if text else ():
            if len(known) > KEPT:
                known.clear()
            once: dict[str, bytes] = {}
            for piece in set(run).difference(known):
                (known if len(piece) <= LONG else once)[piece] = self.ids_of(piece)
            table = known | once if once else known
            out.append(b"".join(map(table.__getitem__, run)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        out, token = [], self.token
        for a in range(0, len(ids), 4 * RUN):
            out.append(b"".join(map(token.__getitem__, np.frombuffer(ids[a : a + 4 * RUN], "<u4").tolist())))
        return b"".join(out)


#: Characters that the standard library's classes and the pattern's treat differently, and all that aren't Latin.
_HARD = re.compile("[\x1c-\x1f\x85\xa0²³¹¼½¾]|[^\x00-ɏ]")


def _easy(pattern: str) -> re.Pattern | None:
    """The pattern in the standard library's words, for texts without ``_HARD``; None for a pattern that isn't known."""
    known = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return re.compile(known.replace(r" ?\p{L}+", r" ?[^\W\d_]+").replace(r" ?\p{N}+", r" ?\d+").replace(r" ?[^\s\p{L}\p{N}]+", r" ?(?:[^\s\w]|_)+")) if pattern == known else None


_MADE: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str, index: PerfectHash | None = None) -> Codec:
    """This process's codec for a rank file's bytes."""
    key = (hash(data), pattern)
    if key not in _MADE:
        ranks = parse_ranks(data)
        _MADE[key] = Codec(ranks, pattern, index or PerfectHash.build(list(ranks)))
    return _MADE[key]


_TYPES = {
    "ids": (pa.binary(), "binary"),
    "n_tokens": (pa.int64(), "bigint"),
    "ids_sha256": (pa.string(), "string"),
    "decoded": (pa.binary(), "binary"),
    "decoded_sha256": (pa.string(), "string"),
}



def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = tuple(_TYPES), text: str = "text") -> DataFrame:
    """Encode every text and decode the ids again; one row for each row of ``docs``.

    ``outputs`` names what is wanted of ids (binary, little-endian unsigned 32-bit),
    n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded (bytes of the
    ids) and decoded_sha256. ``keep`` names columns to carry along.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keep = tuple(k for k in keep if k not in outputs)
    fields = [docs.schema[k] for k in keep]
    table = PerfectHash.build(list(parse_ranks(ranks)))
    shared = spark.sparkContext.broadcast((ranks, table.shift, table.keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, shift, keys = shared.value
        c = codec(data, pattern, PerfectHash(shift, keys))
        digits = [str(i).encode() for i in range(len(c.token))]
        for batch in pieces(batches):
            made: dict[str, list] = {k: [] for k in outputs}
            for t in batch.column("text").to_pylist():
                ids = c.encode(t)
                if "ids" in made:
                    made["ids"].append(ids)
                if "n_tokens" in made:
                    made["n_tokens"].append(len(ids) // 4)
                if "ids_sha256" in made:
                    made["ids_sha256"].append(sha256(b" ".join(map(digits.__getitem__, np.frombuffer(ids, "<u4").tolist()))).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    decoded = c.decode(ids)
                    if "decoded" in made:
                        made["decoded"].append(decoded)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(sha256(decoded).hexdigest())
            columns = [batch.column(f"k{i}") for i in range(len(keep))] + [pa.array(made[k], _TYPES[k][0]) for k in outputs]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *outputs])

    source = docs.select(docs[text].cast("string").alias("text"), *[docs[k].alias(f"k{i}") for i, k in enumerate(keep)])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{k} {_TYPES[k][1]}" for k in outputs])
    return source.mapInArrow(run, schema)
