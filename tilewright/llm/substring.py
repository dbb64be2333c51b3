"""Removal of word windows that an earlier document has, by Rabin-Karp hashes.

1. Documents are written once as batches: a row holds some MB of whole texts.
2. Each batch hashes every window of ``width`` words (``kernel.windows``) and keeps, for
   each different hash, the smallest document that has it: however often a passage
   occurs, a batch sends its windows once. Hashes are dealt to buckets by a second hash of
   the window, sized by the corpus, and sent in ascending order as differences, in bytes.
3. A bucket sorts what it got, and tells each batch which of its hashes also start in
   another batch's smaller document.
4. Batches meet their answers, hash again, mark the windows whose smallest document is
   smaller than their own, merge marked windows into maximal intervals, and cut these.

Windows are taken for equal if they agree in a 64-bit hash and in the bucket, which comes
from a second hash, of 32 bits; in a batch, if they agree in both. The two are made from two
independent hashes of the words (``kernel``). n windows in k buckets then hold about
n * n / (2**65 * k) false pairs: about one in 2e13 windows with 1e7 buckets, 2e-4 in 5e9 windows
(30 GB) with 3600. Words that agree in one hash don't agree in the other.

Batches, buckets and what is sent at once have fixed sizes, whatever the size of the corpus:
a worker holds one batch of ``SIZE`` bytes of text, or one document where that is larger.

Cases: a null or empty text has no words; a text shorter than the window loses none; a
null doc_id comes after all others, so such rows lose what any numbered document has and
cost no other row anything; rows with equal doc_id are not smaller than each other; an
empty table gives an empty table; words are bytes, so equal sequences are byte-equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.kernel import U, Words, pieces, windows, within, words
from tilewright.llm.store import bound_batches, deal, text_bytes, written

#: Bytes of text in a batch, of hashes in a bucket, and of hashes that are sent at once.
SIZE, BUCKET, SENT = 4 << 20, 16 << 20, 1 << 20
_LAST = np.int64(2**63 - 1)


def batched(docs: DataFrame, size: int) -> DataFrame:
    """(batch, docs): whole documents, about ``size`` bytes of text in a row, as one compressed Arrow stream (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, number = [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "docs"])

        for batch in pieces(batches, size // 8):
            more = batch.column("text").nbytes
            if held and n + more > size:
                yield row()
                held, n, number = [], 0, number + 1
            held.append(batch)
            n += more
        if held:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, "batch bigint, docs binary")


def _opened(docs: bytes) -> tuple[pa.Array, pa.Array]:
    rows = pa.ipc.open_stream(docs).read_all().combine_chunks()
    return tuple(rows.column(k).combine_chunks() if rows.column(k).num_chunks != 1 else rows.column(k).chunk(0) for k in ("doc_id", "text"))


class _Batch:
    """Windows of a batch: the different hashes by bucket, and their smallest document."""

    def __init__(self, doc_ids: pa.Array, texts: pa.Array, width: int, buckets: int) -> None:
        self.words = w = words(texts, lanes=2)
        self.ids = doc_ids.fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
        # where windows begin, and in which of the batch's documents
        self.at, self.of = (x.astype(np.int32) for x in within(w.first, width))
        run = windows(w.hash, width)[self.at] if len(self.at) else np.zeros(0, U)
        other = (windows(w.other, width) >> U(32)).astype(np.uint32)[self.at] if len(self.at) else np.zeros(0, np.uint32)
        w.hash = w.other = None
        order = np.argsort(run).astype(np.int32)
        run, other = run[order], other[order]
        if ((run[1:] == run[:-1]) & (other[1:] != other[:-1])).any():  # one hash, different windows
            again = np.lexsort((other, run))
            order, run, other = order[again], run[again], other[again]
        fresh = np.ones(len(run), bool)
        fresh[1:] = (run[1:] != run[:-1]) | (other[1:] != other[:-1])
        new = np.flatnonzero(fresh)
        self.hash = run[new]
        del run
        self.least = np.minimum.reduceat(self.ids[self.of[order]], new) if len(new) else np.zeros(0, np.int64)
        self.kind = np.empty(len(order), np.int32)  # of each window, its place among the different ones
        self.kind[order] = np.cumsum(fresh, dtype=np.int32) - 1
        del order, fresh
        bucket = (other[new] % np.uint32(min(buckets, 2**32 - 1))).astype(np.uint32)
        self.by_bucket = np.argsort(bucket, kind="stable").astype(np.int32)
        size = np.bincount(bucket) if len(bucket) else np.zeros(0, np.int64)
        self.full = np.flatnonzero(size)  # the buckets that get something, and where each begins
        self.begin = np.concatenate([[0], np.cumsum(size[self.full])]).astype(np.int64)

    def sent_to(self, k: int) -> np.ndarray:
        return self.by_bucket[self.begin[k] : self.begin[k + 1]]


def _planes(x: np.ndarray) -> bytes:
    """Integers with their equal bytes side by side, for the shuffle's compression."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _steps(sorted_hashes: np.ndarray) -> bytes:
    """Ascending hashes as their differences, whose high bytes are mostly 0."""
    return _planes(np.diff(sorted_hashes, prepend=U(0)).view(np.int64))


def _unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw).view(U), dtype=U)


def _send(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                number, b = rows.column("batch")[i].as_py(), _Batch(*_opened(rows.column("docs")[i].as_py()), width, buckets)
                b.words = b.at = b.of = b.kind = None
                cuts = np.searchsorted(b.begin, np.arange(0, len(b.hash) + SENT // 16, SENT // 16))
                for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out = [b.sent_to(k) for k in range(first, min(last, len(b.full)))]
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(b.full[first : first + len(out)], pa.int64()), pa.array([number] * len(out), pa.int64()), pa.array([_steps(b.hash[x]) for x in out], pa.binary()), pa.array([_planes(b.least[x]) for x in out], pa.binary())],
                            names=["bucket", "batch", "hashes", "least"],
                        )
                del b

    return run


def _answer(got: pa.Table) -> pa.Table:
    """For each batch, places among the hashes it sent that another batch's smaller document has."""
    hashes = [_unsteps(x) for x in got.column("hashes").to_pylist()]
    size = np.asarray([len(x) for x in hashes])
    every = np.concatenate(hashes)
    least = np.concatenate([_unplanes(x) for x in got.column("least").to_pylist()])
    order = np.argsort(every)
    run = every[order]
    new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(least[order], new), np.diff(np.concatenate([new, [len(run)]])))
    known = np.zeros(len(every), bool)
    known[order] = least[order] > smallest
    ends = np.cumsum(size)
    places = [np.flatnonzero(known[e - n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    some = [i for i, x in enumerate(places) if len(x)]
    return pa.table({"batch": pa.array([got.column("batch")[i].as_py() for i in some], pa.int64()), "bucket": pa.array([got.column("bucket")[i].as_py() for i in some], pa.int64()), "known": pa.array([places[i].astype("<u4").tobytes() for i in some], pa.binary())})


def _intervals(w: Words, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words the windows that start at ``starts`` cover."""
    edge = np.zeros(len(w.start) + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of all documents, one space between two of a document, and where each document begins."""
    at = np.flatnonzero(keep)
    doc = np.searchsorted(w.first, at, side="right") - 1
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(at) else np.zeros(0, bool)
    data = w.data.copy()
    data[w.end[at[~last]]] = 32
    edge = np.zeros(len(data) + 2, np.int8)
    edge[w.start[at]] += 1
    edge[w.end[at] + ~last] -= 1
    out = data[np.cumsum(edge[: len(data)], dtype=np.int8).astype(bool)]
    size = np.bincount(doc, w.end[at] - w.start[at] + ~last, len(w.first) - 1).astype(np.int64) if len(at) else np.zeros(len(w.first) - 1, np.int64)
    return out, np.concatenate([[0], np.cumsum(size)])


_TYPES = {
    "n_words": (pa.int64(), "bigint"),
    "n_removed": (pa.int64(), "bigint"),
    "removed": (pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), "array<struct<first:bigint,last:bigint>>"),
    "kept": (pa.string(), "string"),
    "kept_sha256": (pa.string(), "string"),
}


def remove_repeats(docs: DataFrame, width: int = 13, outputs: tuple[str, ...] = tuple(_TYPES), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and what ``outputs`` names of n_words, n_removed, removed (maximal intervals of
    word numbers, both ends included), kept (kept words joined by one space) and kept_sha256."""
    spark = docs.sparkSession
    bound_batches(spark)
    body = docs.select(docs[key].cast("bigint").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    total = text_bytes(body)
    buckets = deal(spark, 2 * total, BUCKET)
    stored = written(batched(body, SIZE), "batches")
    sent = stored.mapInArrow(_send(width, buckets), "bucket bigint, batch bigint, hashes binary, least binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "batch bigint, bucket bigint, known binary")
    by_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "known")).alias("known"))
    met = stored.join(by_batch, "batch", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                ids, texts = _opened(rows.column("docs")[i].as_py())
                b = _Batch(ids, texts, width, buckets)
                elsewhere = np.zeros(len(b.hash), bool)
                for answer in rows.column("known")[i].as_py() or ():
                    k = int(np.searchsorted(b.full, answer["bucket"]))
                    elsewhere[b.sent_to(k)[np.frombuffer(answer["known"], "<u4")]] = True
                marked = elsewhere[b.kind] | (b.least[b.kind] < b.ids[b.of]) if len(b.at) else np.zeros(0, bool)
                b.hash = b.least = b.kind = b.of = None
                gone = _intervals(b.words, b.at[marked], width)
                made: dict[str, pa.Array] = {"n_words": pa.array(np.diff(b.words.first), pa.int64())}
                so_far = np.concatenate([[0], np.cumsum(gone)])
                made["n_removed"] = pa.array(np.diff(so_far[b.words.first]), pa.int64())
                if "removed" in outputs:
                    made["removed"] = pa.array([_runs(gone[a:e]) for a, e in zip(b.words.first[:-1].tolist(), b.words.first[1:].tolist(), strict=True)], _TYPES["removed"][0])
                if "kept" in outputs or "kept_sha256" in outputs:
                    data, at = _kept(b.words, ~gone)
                    texts = [data[a:e].tobytes() for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    if "kept" in outputs:
                        made["kept"] = pa.array([t.decode() for t in texts], pa.string())
                    if "kept_sha256" in outputs:
                        made["kept_sha256"] = pa.array([sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([ids, *(made[k] for k in outputs)], names=["doc_id", *outputs])

    return met.select("docs", "known").mapInArrow(finish, "doc_id bigint, " + ", ".join(f"{k} {_TYPES[k][1]}" for k in outputs))


def _runs(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]
