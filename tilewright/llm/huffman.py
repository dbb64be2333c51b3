"""Token ids as canonical, length-limited Huffman code in blocks that decode alone.

Format (version 1), a Parquet container so that Spark's commit protocol, retries and any
file system apply. Each row is a block:

* ``part``, ``block``: place in order; blocks of a part follow each other, parts too.
* ``first_token``: ids of the part before this block.
* ``doc_ids``, ``n_tokens``: the documents of the block, whole ones only, and how many
  ids each has.
* ``n``: ids in the block; a block ends with the document that brings it to BLOCK ids.
* ``bits``: the code, most significant bit first.
* ``checkpoints``: bit offsets of every STRIDE-th id, so that runs of a block decode
  side by side, by table.

Beside the blocks stands the code book: (id, length), from which canonical codes follow:
shorter first, then by id. Lengths come from global counts by package-merge, LIMIT bits
at most, so that one table of 2**LIMIT entries decodes any id.

Cases: a document without ids still stands in a block, with 0; equal and null doc ids
are kept, each row by itself, null first; an empty table gives no blocks; a vocabulary
with one id gets a code of one bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.kernel import pieces
from tilewright.llm.store import bound_batches, deal, new_path, written
from tilewright.llm.word_bpe import encoder

LIMIT, BLOCK, STRIDE = 16, 1 << 16, 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for each count (0: not coded), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    base = counts[order].astype(np.int64)
    n = len(base)
    # a package is known by its weight; how many leaves each level takes tells the lengths
    levels = [np.arange(n)]
    weights = base
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([base, pairs])
        place = np.argsort(merged, kind="stable")
        levels.append(place)
        weights = merged[place]
    take = 2 * n - 2
    for place in reversed(levels):
        chosen = place[:take]
        leaves = int((chosen < n).sum())
        lengths[order[:leaves]] += 1
        take = 2 * (len(chosen) - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each id, and a table of id << 5 | length for every LIMIT-bit prefix."""
    codes = np.zeros(len(lengths), np.uint32)
    table = np.zeros(1 << LIMIT, np.uint32)
    code, at = 0, 0
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    last = 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        last = n
        codes[i] = code
        span = 1 << (LIMIT - n)
        table[at : at + span] = i << 5 | n
        at += span
        code += 1
    return codes, table


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, list[int]]:
    """Bits of a block, and the bit offset of every STRIDE-th id."""
    n = lengths[ids]
    end = np.cumsum(n)
    begin = end - n
    total = int(end[-1]) if len(end) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    # a code of up to 16 bits lies in at most two 32-bit words
    shift = (48 - (begin & 31) - n + 16).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << shift
    at = begin >> 5
    if len(ids):
        for half, where in ((value >> np.uint64(32), at), (value & np.uint64(0xFFFFFFFF), at + 1)):
            # codes don't share bits, so that sums of those that meet in a word are their union
            first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            words[where[first]] += np.add.reduceat(half, first)
    raw = words.astype(">u4").tobytes()
    return raw[: -(-total // 8)], begin[::STRIDE].tolist()


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Ids of a block: all runs between checkpoints advance together, one id a step, by table."""
    out = np.zeros((len(checkpoints), STRIDE), np.uint32)
    data = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (data[:-3] << 16) | (data[1:-2] << 8) | data[2:-1]  # 24 bits from each byte on
    at = checkpoints.astype(np.int64)
    top = len(window) - 1
    for k in range(STRIDE):
        byte = np.minimum(at >> 3, top)
        entry = table[(window[byte] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)]
        out[:, k] = entry >> 5
        at += entry & 31
    return out.reshape(-1)[:n]


def encode_rows(docs: DataFrame, definition: bytes, end_id: int, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the library's ids of each text, and ``end_id``, as unsigned 16-bit or 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        kind = "<u2" if len(e.ends) <= 1 << 16 else "<u4"
        tail = np.asarray([end_id], kind).tobytes()
        for batch in pieces(batches):
            ids, n = e.flat(batch.column("text"))
            raw, ends = ids.astype(kind).tobytes(), (np.cumsum(n) * int(kind[2])).tolist()
            out = [raw[a:b] + tail for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), pa.array([int(kind[2])] * len(out), pa.int32())], names=["doc_id", "ids", "width"])

    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(docs[keep].alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, width int")


def count_ids(rows: DataFrame) -> DataFrame:
    """(id, n) over all rows, added up batch by batch before the shuffle; as many rows as the vocabulary has ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                got = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return rows.select("ids", "width").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(rows: DataFrame, path: str, vocabulary: int) -> None:
    """Write (doc_id, ids, width) in ascending doc_id order as blocks at ``path`` and a code book at ``path``-book."""
    spark = rows.sparkSession
    counts = np.zeros(vocabulary, np.int64)
    for row in count_ids(rows).toLocalIterator():  # the vocabulary bounds these rows, not the corpus
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id bigint, length int").coalesce(1).write.parquet(f"{path}-book")
    shared = spark.sparkContext.broadcast(lengths)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_length = shared.value
        codes, _ = canonical(code_length)
        part = _task()
        first = number = 0
        doc_ids: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        n_held = 0

        def block() -> pa.RecordBatch:
            nonlocal first, number, doc_ids, sizes, held, n_held
            ids = np.concatenate(held)
            bits, marks = pack(ids, codes, code_length)
            out = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int64()), "block": pa.array([number], pa.int64()), "first_token": pa.array([first], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(id_type)), "n_tokens": pa.array([sizes], pa.list_(pa.int64())), "n": pa.array([len(ids)], pa.int64()), "bits": pa.array([bits], pa.binary()), "checkpoints": pa.array([marks], pa.list_(pa.int64()))}
            )
            number, first, doc_ids, sizes, held, n_held = number + 1, first + len(ids), [], [], [], 0
            return out

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, ids, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True):
                held.append(np.frombuffer(ids, f"<u{width}").astype(np.int64))
                doc_ids.append(doc_id)
                sizes.append(len(held[-1]))
                n_held += sizes[-1]
                if n_held >= BLOCK:
                    yield block()
        if doc_ids:
            yield block()

    n = deal(spark, 4 * int(counts.sum()), 64 << 20)
    # an id (or none) that very many rows have is dealt out by what they hold
    order = ["doc_id", F.xxhash64("ids")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(blocks, f"part bigint, block bigint, first_token bigint, doc_ids array<{kind}>, n_tokens array<bigint>, n bigint, bits binary, checkpoints array<bigint>").write.option("compression", "uncompressed").parquet(path)


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def read(spark, path: str) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit).

    A block is decoded without any other. Starts follow from its place and the totals of the
    files before, a row for each file, which are joined.
    """
    book = spark.read.parquet(f"{path}-book").collect()  # the vocabulary bounds it
    size = max([1, *(r["id"] + 1 for r in book)])
    lengths = np.zeros(size, np.int64)
    for r in book:
        lengths[r["id"]] = r["length"]
    shared = spark.sparkContext.broadcast(lengths)
    stored = spark.read.parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n").alias("n"))
    starts = written(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "file-starts")
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = canonical(shared.value)
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i] for k in columns}
                raw = unpack(r["bits"].as_py(), np.asarray(r["checkpoints"].values), r["n"].as_py(), table).astype("<u4").tobytes()
                sizes = np.asarray(r["n_tokens"].values, np.int64)
                ends = np.cumsum(sizes)
                ids = [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                start = r["before"].as_py() + r["first_token"].as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([r["doc_ids"].values.cast(id_type), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array([crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    columns = ("before", "first_token", "doc_ids", "n_tokens", "n", "bits", "checkpoints")
    return stored.join(starts, "part").select(*columns).mapInArrow(docs, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def round_trip(docs: DataFrame, definition: bytes, end_id: int, path: str | None = None) -> DataFrame:
    """Encode all texts, write them in the format, and read the files back."""
    spark = docs.sparkSession
    bound_batches(spark)
    from tokenizers import Tokenizer

    vocabulary = max(*Tokenizer.from_str(definition.decode()).get_vocab().values(), end_id) + 1
    path = path or new_path(spark, "token-ids")
    write(written(encode_rows(docs, definition, end_id), "ids"), path, vocabulary)
    return read(spark, path)
