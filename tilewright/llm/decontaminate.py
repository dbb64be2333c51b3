"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact verification.

An item of n words is compared with windows of n words. A window's fingerprint has 128
bits: each of its 5-word shingles votes for or against each bit, as often as it occurs.
The index of an item length holds the fingerprints of its items in 8 blocks of 16 bits.
Within RADIUS = 35 bits of difference, some block differs in 4 bits at most, so looking up
each block's value in a table of the items within 4 bits of it misses no fingerprint within
the radius. (A table has 65,536 values; the places of those that occur are filled when they
first do, and emptied when they hold too much.) Candidates are verified
by the weighted Jaccard similarity of their shingles; at a similarity of 0.8, 19 bits
differ on average, with a deviation of 4, where shingles are distinct: a similar window is
then missed about once in 30,000, by the normal law. Where a shingle occurs more than once in
the window or the item, its votes outweigh its share of the similarity and bits say little;
there, windows that share enough shingles by count are verified without a look at the bits,
so none is missed, and the distance given may exceed the radius.

A window that shares no shingle with an item has similarity 0 with it, so fingerprints
are made only of windows that hold a shingle of an item of their length: found for all
words of all texts by hash. Where one index entry has many items it is still one probe;
the benchmark is read in blocks of bounded size, each broadcast by itself.

Words are runs of letters and digits, lower case. An item of 1 to 4 words is one shingle of
that many words. Cases: null texts, and items without words, match nothing; a null doc_id
or item_id is carried as it is, of any atomic type; equal rows give equal rows, equal items a row for each id;
of several windows the most similar counts, of equal ones the first; an empty table, of
documents or of items, gives an empty table; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.kernel import PLAIN, U, counted, lowered, mix, pieces, windows, within, words
from tilewright.llm.store import bound_batches

WIDTH, SIMILAR, RADIUS, BLOCKS = 5, 0.8, 35, 8
PER_BLOCK = RADIUS // BLOCKS
#: Items, and characters of items, that are broadcast at once.
ITEMS, CHARACTERS = 20_000, 16 << 20
#: Items that the tables of a length hold at most, and pairs of windows and items that are looked at at once.
HELD, PAIRS = 1 << 21, 1 << 21
_ONES = np.asarray([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _bits(grams: np.ndarray) -> np.ndarray:
    """Votes of shingles: (n, 128) of 1 and -1."""
    lanes = np.stack([mix(grams ^ U(0x2545F4914F6CDD1D)), mix(grams ^ U(0x632BE59BD9B4E019))], axis=1)
    return np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _prints(votes: np.ndarray) -> np.ndarray:
    """Fingerprints as 8 blocks of 16 bits."""
    return np.packbits(votes > 0, axis=1).view(np.uint16)


@dataclass
class _Length:
    """Items of one number of words."""

    size: int
    ids: list = field(default_factory=list)
    prints: list = field(default_factory=list)
    sets: list = field(default_factory=list)
    grams: np.ndarray | None = None
    #: Which items hold a shingle more than once.
    repeated: np.ndarray | None = None
    #: Shingles in order, each with an item that holds it and how often.
    holders: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    #: By block and value, the items whose block is near it.
    table: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    held: int = 0

    def near(self, block: int, value: int) -> np.ndarray:
        found = self.table.get((block, value))
        if found is None:
            if self.held > HELD:
                self.table, self.held = {}, 0
            found = self.table[block, value] = np.flatnonzero(_ONES[self.prints[:, block] ^ np.uint16(value)] <= PER_BLOCK)
            self.held += len(found) + 1
        return found


class Index:
    """Items by length; a hash table of all their shingles tells the lengths of each."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        w = words(lowered(pa.array(texts, pa.string())), PLAIN)
        self.lengths: dict[int, _Length] = {}
        for i, item_id in enumerate(ids):
            n = int(w.first[i + 1] - w.first[i])
            if not n:
                continue
            grams = windows(w.hash[w.first[i] : w.first[i + 1]], min(WIDTH, n))
            here = self.lengths.setdefault(n, _Length(n))
            here.ids.append(item_id)
            here.prints.append(_prints(_bits(grams).sum(0, keepdims=True))[0])
            g, _, c = counted(grams, np.zeros(len(grams), np.int64))
            here.sets.append((g, c))
        for here in self.lengths.values():
            here.prints = np.asarray(here.prints)
            here.grams = np.unique(np.concatenate([g for g, _ in here.sets]))
            here.repeated = np.asarray([bool((c > 1).any()) for _, c in here.sets])
            every, times = (np.concatenate(x) for x in zip(*here.sets, strict=True))
            item = np.repeat(np.arange(len(here.sets)), [len(g) for g, _ in here.sets])
            order = np.argsort(every, kind="stable")
            here.holders = every[order], item[order], times[order]
        #: For each shingle width: all shingles, and a bit table that rules most others out.
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {min(WIDTH, n) for n in self.lengths}:
            every = np.unique(np.concatenate([x.grams for x in self.lengths.values() if min(WIDTH, x.size) == width]))
            table = np.zeros(1 << 20, bool)
            table[(every >> U(44)).astype(np.int64)] = True
            self.by_width[width] = (every, table)

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) within the radius, by looking up each block: what no block brings near is never compared in full."""
        here = self.lengths[size]
        out = []
        for part in np.array_split(np.arange(len(prints)), -(-len(prints) * len(here.ids) // PAIRS)):
            pairs = []
            for b in range(BLOCKS):
                values, at = np.unique(prints[part, b], return_inverse=True)
                lists = [here.near(b, v) for v in values.tolist()]
                n = np.asarray([len(x) for x in lists])
                first, every, many = np.cumsum(n) - n, np.concatenate(lists), n[at]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at], many)
                pairs.append(np.repeat(part, many) * len(here.ids) + every[place])
            window, item = np.divmod(np.unique(np.concatenate(pairs)), len(here.ids))
            distance = _ONES[prints[window] ^ here.prints[item]].sum(1, dtype=np.int64)
            keep = distance <= RADIUS
            out.append((window[keep], item[keep], distance[keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def by_count(self, size: int, grams: np.ndarray, repeated: bool, need: int) -> np.ndarray:
        """Items that share ``need`` shingles with a window; without a repeated shingle in the window, only items that have one."""
        here = self.lengths[size]
        every, item, times = here.holders
        own, count = np.unique(grams, return_counts=True)
        a, b = np.searchsorted(every, own), np.searchsorted(every, own, side="right")
        n = b - a
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        both = np.bincount(item[at], np.minimum(times[at], np.repeat(count, n)), len(here.ids))
        return np.flatnonzero((both >= need) & (repeated | here.repeated))

    def _similar(self, size: int, item: int, grams: np.ndarray) -> float:
        g, n, own = *self.lengths[size].sets[item], np.sort(grams)
        both = int(np.minimum(n, np.searchsorted(own, g, side="right") - np.searchsorted(own, g)).sum())
        return both / (int(n.sum()) + len(grams) - both)

    def matches(self, hashes: np.ndarray, hits: dict[int, np.ndarray], least: float) -> list[tuple]:
        """(item_id, first_word, n_words, distance, similarity) of a document: word hashes, and where shingles of items begin, by width."""
        out = []
        for size, here in self.lengths.items():
            width = min(WIDTH, size)
            at = hits.get(width)
            if at is None or not len(at) or len(hashes) < size:
                continue
            a, b = int(at[0]), int(at[-1]) + width
            a, b = max(0, a - size + width), min(len(hashes), b + size - width)
            grams = windows(hashes[a:b], width)
            shared = here.grams[np.minimum(np.searchsorted(here.grams, grams), len(here.grams) - 1)] == grams
            n = size - width + 1
            if len(grams) < n or not shared.any():
                continue
            count = np.concatenate([[0], np.cumsum(shared)])
            starts = np.flatnonzero(count[n:] > count[:-n])
            # similarity s of n shingles with n needs 2 n s / (1 + s) shared ones
            need = max(1, int(np.ceil(2 * n * least / (1 + least) - 1e-9)))
            again = np.zeros(len(grams), np.int64)  # 1 + the place before of the same shingle
            order = np.argsort(grams, kind="stable")
            same = grams[order[1:]] == grams[order[:-1]]
            again[order[1:][same]] = 1 + order[:-1][same]
            best: dict[int, tuple] = {}
            for part in np.array_split(starts, -(-len(starts) // 4096)):
                lo, hi = int(part[0]), int(part[-1]) + n
                sums = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(_bits(grams[lo:hi]), 0, dtype=np.int32)])
                prints = _prints(sums[part - lo + n] - sums[part - lo])
                window, item, distance = self.candidates(size, prints)
                near = list(zip(window.tolist(), item.tolist(), distance.tolist(), strict=True))
                many = np.flatnonzero(count[part + n] - count[part] >= need)
                found = set(zip(window.tolist(), item.tolist(), strict=True)) if len(many) else set()
                for v in many.tolist():
                    i = int(part[v])
                    repeated = bool((again[i : i + n] > i).any())
                    if repeated or here.repeated.any():
                        near += [(v, k, int(_ONES[prints[v] ^ here.prints[k]].sum())) for k in self.by_count(size, grams[i : i + n], repeated, need).tolist() if (v, k) not in found]
                for v, k, d in sorted(near):
                    i = int(part[v])
                    s = self._similar(size, k, grams[i : i + n])
                    if s >= least and (k not in best or s > best[k][4]):
                        best[k] = (here.ids[k], a + i, size, d, s)
            out += best.values()
        return out


def _blocks(items: DataFrame, item_key: str, text: str) -> Iterator[tuple[list, list]]:
    """The stated items, in blocks of bounded size."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(item_key).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        if ids and (len(ids) == ITEMS or size + len(r["t"] or "") > CHARACTERS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"] or "")
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, items: DataFrame, least: float = SIMILAR, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): a row for each document and item that it holds."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    # ids of items travel as strings, which each type can be made into and from
    as_text, as_id = (F.hex, F.unhex) if item_kind == "binary" else (lambda c: c.cast("string"), lambda c: c.cast(item_kind))
    items = items.select(as_text(F.col(f"`{item_key}`")).alias("item_id"), F.col(f"`{text}`").alias("text"))
    body = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    schema = f"doc_id {kind}, item_id string, first_word bigint, n_words bigint, distance bigint, similarity double"
    out = None
    for ids, texts in _blocks(items, "item_id", "text"):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in pieces(batches):
                index = index or Index(*shared.value)
                rows = _scan(index, batch.column("text"), least)
                doc_ids = batch.column("doc_id").take(pa.array([i for i, _ in rows], pa.int64()))
                cols = list(zip(*[m for _, m in rows], strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())], names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

        found = body.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else spark.createDataFrame([], schema)
    return out.withColumn("item_id", as_id(F.col("item_id")))


def _scan(index: Index, texts: pa.Array, least: float) -> list[tuple[int, tuple]]:
    """(row, match) of an array of texts."""
    w = words(lowered(texts), PLAIN)
    hits: dict[int, dict[int, np.ndarray]] = {}
    for width, (every, table) in index.by_width.items():
        at, doc = within(w.first, width)
        if not len(at):
            continue
        grams = windows(w.hash, width)
        # windows by word, of which those that lie in one document count
        maybe = np.flatnonzero(table[(grams >> U(44)).astype(np.int64)])
        maybe = maybe[every[np.minimum(np.searchsorted(every, grams[maybe]), len(every) - 1)] == grams[maybe]]
        maybe = maybe[np.isin(maybe, at, assume_unique=True)]
        of = np.searchsorted(w.first, maybe, side="right") - 1
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() if len(of) else []
        for a, b in zip(cut, [*cut[1:], len(of)][: len(cut)], strict=True):
            hits.setdefault(int(of[a]), {})[width] = maybe[a:b] - w.first[of[a]]
    return [(d, m) for d in sorted(hits) for m in index.matches(w.hash[w.first[d] : w.first[d + 1]], hits[d], least)]


def clean(docs: DataFrame, items: DataFrame, least: float = SIMILAR, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose text holds no item. Rows are judged where they are: no join by id."""
    spark = docs.sparkSession
    bound_batches(spark)
    out = docs
    for ids, texts in _blocks(items.withColumn("item_id", F.lit(0)), "item_id", "text"):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in pieces(batches):
                index = index or Index(*shared.value)
                bad = {i for i, _ in _scan(index, batch.column("text"), least)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        columns = [c for c in out.columns if c != text]
        body = out.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("rest"))
        out = body.mapInArrow(run, body.schema).select(*[F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns])
    return out
