"""Token counts by overlap resynchronisation.

A document of up to ``chunk`` characters is encoded as a whole. A longer one is dealt out
as chunks that overlap by ``overlap`` characters, each encoded by itself with the offsets
of its tokens. Two neighbours are spliced at the first place in their overlap at which

* both have a token boundary, and
* the text has white space, with a character that isn't white space before and after it,
  so that the cut is proven stable: the tokenizer's normaliser and pre-tokenizer never
  reach across it (``word_bpe.Encoder.checked`` proves that on the file).

The count of a chunk is that of its tokens between its two splices. Documents with a pair
of neighbours that have no such place (a run without white space) go round again with an
overlap four times as wide and chunks that are twice as wide as that; once a chunk holds
the whole document no splice is needed, so every document ends.

Cases: a null or empty text has 0 bytes and 0 tokens; rows with equal or null ids are
counted each by itself (an internal row number tells chunks of different rows apart);
an empty table gives an empty table; other columns are kept as they are if named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.kernel import pieces
from tilewright.llm.store import bound_batches, written
from tilewright.llm.word_bpe import Encoder, encoder

#: Characters of a chunk, and of the overlap of two.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Largest tokenizer file that is broadcast.
MOST_FILE = 64 << 20


def read_definition(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_FILE + 1)
    if len(data) > MOST_FILE:
        raise ValueError(f"{path}: a tokenizer file of over {MOST_FILE} bytes isn't broadcast")
    return data


def spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Where chunks begin and end: each begins ``overlap`` before its predecessor's end."""
    if length <= chunk:
        return [(0, length)]
    step = chunk - overlap
    starts = range(0, length - overlap, step)
    return [(a, min(length, a + chunk)) for a in starts]


def stable(text: str, a: int, b: int) -> list[int]:
    """Places p in [a, b): white space at p, none before it, and a word after the white space."""
    return [p for p in range(max(a, 1), b) if text[p] == " " and not text[p - 1].isspace() and p + 1 < len(text) and not text[p + 1].isspace()]


def boundaries(offsets: list[tuple[int, int]], places: list[int]) -> dict[int, int]:
    """Tokens before each place that is a token boundary, by the offsets of a text's tokens; a place inside a token is left out."""
    if not offsets:
        return dict.fromkeys(places, 0)
    begin, end = np.asarray(offsets, np.int64).T
    begin, reach = np.minimum.accumulate(begin[::-1])[::-1], np.concatenate([[0], np.maximum.accumulate(end)])
    at = np.asarray(places, np.int64)
    before = np.searchsorted(begin, at)
    return {p: n for p, n, r in zip(places, before.tolist(), reach[before].tolist(), strict=True) if r <= p}


def _one(e: Encoder, text: str, begin: int, overlap: int, first: bool, last: bool) -> dict:
    """Tokens of a chunk, and the stable places in its overlap with each neighbour that are token boundaries, by place in the document."""
    n = len(text)
    if not e.by_chunk:  # nothing is proven for such a file: no place to splice at
        left, right = [], []
    else:
        left = [] if first else stable(text, 0, min(overlap, n))
        right = [] if last else stable(text, max(0, n - overlap), n)
    offsets = e.tokenizer.encode(text, add_special_tokens=False).offsets
    marks = boundaries(offsets, sorted({*left, *right}))
    return {"total": len(offsets), "left": [(begin + p, marks[p]) for p in left if p in marks], "right": [(begin + p, marks[p]) for p in right if p in marks]}


_MARK = pa.list_(pa.struct([("p", pa.int64()), ("n", pa.int64())]))


def _rounds(spark, cut: DataFrame, shared, overlap: int) -> DataFrame:
    """Counts of documents that are cut in chunks (row, piece, last, begin, text): n is null where two neighbours have no splice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in pieces(batches):
            rows = batch.to_pylist()
            made = [_one(e, r["text"], r["begin"], overlap, r["piece"] == 0, r["last"]) for r in rows]
            mark = lambda k: pa.array([[{"p": p, "n": n} for p, n in m[k]] for m in made], _MARK)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("piece"), batch.column("last"), pa.array([m["total"] for m in made], pa.int64()), mark("left"), mark("right")], names=["row", "piece", "last", "total", "left", "right"])

    got = written(cut.mapInArrow(run, "row bigint, piece bigint, last boolean, total bigint, left array<struct<p:bigint,n:bigint>>, right array<struct<p:bigint,n:bigint>>"), "chunk-tokens")
    here = got.select("row", "piece", "last", "total", "right")
    after = got.select("row", (F.col("piece") - 1).alias("piece"), F.col("left").alias("next_left"))
    both = here.join(after, ["row", "piece"], "left")
    common = F.array_min(F.array_intersect(F.transform("right", lambda m: m["p"]), F.transform("next_left", lambda m: m["p"])))
    at = lambda marks: F.get(F.filter(marks, lambda m: m["p"] == F.col("cut")), F.lit(0))["n"]
    spliced = both.withColumn("cut", common).withColumn("up_to", F.when(F.col("last"), F.col("total")).otherwise(at("right"))).withColumn("from_next", F.when(F.col("last"), F.lit(0)).otherwise(at("next_left")))
    # tokens of a document: what each chunk has up to its splice, less what the next has before the same place
    return spliced.groupBy("row").agg(F.when(F.count(F.when(F.col("up_to").isNull() | F.col("from_next").isNull(), 1)) == 0, F.sum(F.col("up_to") - F.col("from_next"))).alias("n_tokens"))


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, piece, last, begin, text) of documents (row, text); dealt out anew, as one document may fill many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = spans(len(text), chunk, overlap)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int64()), pa.array([j + 1 == len(parts) for j in range(i, i + len(some))], pa.bool_()), pa.array([a for a, _ in some], pa.int64()), pa.array([text[a:b] for a, b in some], pa.string())],
                        names=["row", "piece", "last", "begin", "text"],
                    )

    cut = docs.select("row", "text").mapInArrow(run, "row bigint, piece bigint, last boolean, begin bigint, text string")
    return cut.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "piece")


def count_tokens(docs: DataFrame, definition: bytes, keep: tuple[str, ...] = ("doc_id",), limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """``keep`` and n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens), a row for each row of ``docs``. A kept column of one of these names gives way."""
    keep = tuple(k for k in keep if k not in ("n_bytes", "n_tokens", "over_limit"))
    if not 0 < overlap < chunk // 2:
        raise ValueError("the overlap must be under half a chunk")
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(definition)
    kept = [docs[k].alias(f"k{i}") for i, k in enumerate(keep)]
    body = docs.select(docs[text].cast("string").alias("text"), *kept)
    names = [f"k{i}" for i in range(len(keep))]
    types = ", ".join(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in pieces(batches):
            texts = pc.fill_null(batch.column("text"), "")
            _, n_tokens = e.flat(texts)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in names] + [pc.binary_length(texts).cast(pa.int64()), pa.array(n_tokens, pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    huge = F.char_length("text") > chunk
    small = body.where(~F.coalesce(huge, F.lit(False))).mapInArrow(whole, f"{types}, n_bytes bigint, n_tokens bigint")
    # the few huge ones get a row number, written once so that chunks and counts meet again
    large = written(body.where(huge).withColumn("row", F.monotonically_increasing_id()), "huge-texts")
    left, width, counts = large.select("row", "text"), overlap, []
    size = chunk
    while True:
        got = written(_rounds(spark, _chunks(left, size, width), shared, width), "chunk-counts")
        counts.append(got.where(F.col("n_tokens").isNotNull()))
        failed = got.where(F.col("n_tokens").isNull()).select("row")
        if failed.isEmpty():
            break
        left = left.join(failed, "row", "left_semi")
        width = 4 * width
        size = max(size, 2 * width)
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    big = large.select("row", *names, F.octet_length("text").cast("bigint").alias("n_bytes")).join(total, "row").drop("row")
    out = small.unionByName(big)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
