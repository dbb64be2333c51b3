"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification.

Two documents are linked if the weighted Jaccard similarity of their 5-word shingles,
each weighted by how often it occurs, is ``least`` or more; a class is a connected
component of links.

1. Each document gets a fingerprint of its words, and a key for each of 26 bands of 5
   coordinates: a pair of similarity 0.8 shares a band but for a chance of 3e-5.
2. Documents with the same words are one class from the start; the smallest id stands
   for them in what follows, so copies are never paired.
3. In a few rounds, each bucket names a head, another one each time, and members whose
   class isn't the head's are compared with it: no more pairs than members, and fewer
   with each round, as members of one class aren't compared any more.
   Pairs whose sketches (a byte of each coordinate) agree in under 0.66, which at a
   similarity of 0.8 has a chance of 3e-5, are dropped; the others are joined with their
   texts, and their similarity is counted exactly.
4. Buckets that still hold several classes are compared in blocks: members outside the
   largest class with all members, by their whole shingle sets, so exactly and without a
   row for each pair. Of links that connect the same two classes one is kept.

Words are runs of letters and digits, lower case. A document of 1 to 4 words has one
shingle. Cases: a null text, or one without words, is alone in its class; a null doc_id
has a null class and is linked with nothing; equal rows are in one class, each with its own
row; rows that share an id but not the text are judged each by its own words, as each different
text has a number of its own (two classes may then have the same smallest id); an empty table
gives an empty table; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.dart import band_keys, signatures
from tilewright.llm.kernel import PLAIN, U, Words, counted, lowered, mix, pieces, shingles, words
from tilewright.llm.store import bound_batches, written

BANDS, ROWS, WIDTH, SIMILAR = 26, 5, 5, 0.8
#: Rounds of heads, shingles in a block, and how much less than needed sketches may agree.
HEADS, SHINGLES, SLACK = 2, 1 << 16, 0.14


def fingerprints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each document's words in order."""
    n = np.diff(w.first)
    place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)).astype(U)
    out = []
    for lane in (U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(w.hash ^ mix(place + lane)), dtype=U)])
        out.append(mix(sums[w.first[1:]] - sums[w.first[:-1]] + n.astype(U) * lane))
    return out[0], out[1]


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, content, fp1, fp2, weight, keys, sketch): a hash of the text as it is, fingerprint of its words, weight
    of all shingles, band keys and the low byte of each coordinate of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            w = words(lowered(batch.column("text")), PLAIN)
            gram, doc, n = counted(*shingles(w, width))
            total = np.bincount(doc, n, batch.num_rows).astype(np.int64) if len(doc) else np.zeros(batch.num_rows, np.int64)
            signature = signatures(gram, doc, n.astype(np.float64), batch.num_rows, bands * rows)
            keys = band_keys(signature, rows)
            low = (signature & U(255)).astype(np.uint8)
            one, two = fingerprints(w)
            has = total > 0
            flat = pa.array(keys[has].view(np.int64).reshape(-1), pa.int64())
            at = np.concatenate([[0], np.cumsum(has * bands)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(total), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), pa.array([x.tobytes() for x in low], pa.binary())], names=["doc_id", "content", "fp1", "fp2", "weight", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, content bigint, fp1 bigint, fp2 bigint, weight bigint, keys array<bigint>, sketch binary")


def similarity(pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b, similarity) of pairs (a, b, text_a, text_b): the exact weighted Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in pieces(iter([batch.rename_columns(["a", "b", "text_a", "text"])]), 2 << 20):
                left = part.column("a").to_numpy()
                new = np.unique(left, return_index=True)[1]
                new = np.asarray([i for i in new if left[i] not in known], np.int64)
                if len(known) > 64:
                    known = {k: known[k] for k in set(left.tolist()) if k in known}
                for i, x in zip(new.tolist(), _sets(part.column("text_a").take(pa.array(new)), width), strict=True):
                    known[left[i]] = x
                out = np.empty(part.num_rows)
                for i, (g, n) in enumerate(_sets(part.column("text"), width)):
                    h, m = known[left[i]]
                    at = np.minimum(np.searchsorted(h, g), max(len(h) - 1, 0))
                    both = int(np.minimum(n, m[at])[h[at] == g].sum()) if len(h) and len(g) else 0
                    out[i] = both / max(1, int(n.sum()) + int(m.sum()) - both)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(out)], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def _sets(texts: pa.Array, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    gram, doc, n = counted(*shingles(words(lowered(texts), PLAIN), width))
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(gram[a:b], n[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _agree(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(-1)


def _likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in ("sketch_a", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array(_agree(x, y) >= least - SLACK))

    a, b = (sketches.select(F.col("id").alias(k), F.col("sketch").alias(f"sketch_{k}")) for k in ("a", "b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are similar. Weights already rule out pairs whose sizes differ too much, so a text is sent along with texts of its own size only."""
    a, b = (texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    return written(similarity(pairs.join(b, "b").join(a, "a")).where(F.col("similarity") >= least).select("a", "b"), "links")


def _labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return shared.withColumn("label", F.col("id"))
    return shared.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _round(shared: DataFrame, labels: DataFrame | None, number: int, least: float) -> DataFrame:
    """Pairs (a, b) of a bucket's head and a member of another class: two for a member at most, whatever its buckets."""
    named = _labelled(shared, labels)
    order = F.col("id") if number == 0 else F.xxhash64("id", "key", F.lit(number))
    heads = named.groupBy("key").agg(F.min_by(F.struct("id", "label", "weight"), order).alias("head"))
    fits = F.least("weight", "head.weight") >= least * F.greatest("weight", "head.weight")
    met = named.join(heads, "key").where((F.col("label") != F.col("head.label")) & fits)
    ends = met.groupBy(F.col("id").alias("b")).agg(F.array_distinct(F.array(F.min("head.id"), F.max("head.id"))).alias("a"))
    return ends.select(F.explode("a").alias("a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets_of(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, grams, counts): the shingles of each text in ascending order, 8 bytes each, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(iter([batch]), 2 << 20):
                made = _sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([g.tobytes() for g, _ in made], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in made], pa.binary())], names=["id", "grams", "counts"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, grams binary, counts binary")


def _rest(shared: DataFrame, labels: DataFrame | None, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between classes of one bucket. Members outside its largest class, in blocks, are compared exactly with all its members, in blocks."""
    named = _labelled(shared, labels)
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key", "main")
    mixed = written(named.join(main, "key").withColumn("stranger", F.col("label") != F.col("main")).select("key", "id", "label", "weight", "stranger"), "mixed")
    ids = mixed.select("id").distinct()
    sets = written(_sets_of(texts.join(ids.hint("merge"), "id", "left_semi")), "sets")

    def blocks(rows: DataFrame, number: str, held: str) -> DataFrame:
        many = rows.groupBy("key").agg(F.ceil(F.sum("weight") / SHINGLES).alias("many"))
        block = F.pmod(F.xxhash64("id"), F.col("many")).alias(number)
        one = F.struct("id", "label", "weight", "grams", "counts")
        return rows.join(many, "key").join(sets, "id").groupBy("key", block).agg(F.collect_list(one).alias(held))

    met = blocks(mixed.where("stranger"), "x", "left").join(blocks(mixed, "y", "right"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = _linked(*(_members(batch.column(k)[i].values) for k in ("left", "right")), least)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.select("left", "right").mapInArrow(run, "a bigint, b bigint").distinct()


def _members(rows: pa.StructArray) -> list[tuple]:
    ids, label, weight = (rows.field(k).to_pylist() for k in ("id", "label", "weight"))
    grams = [np.frombuffer(x, U) for x in rows.field("grams").to_pylist()]
    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows.field("counts").to_pylist()]
    return list(zip(ids, label, weight, grams, counts, strict=True))


def _linked(left: list[tuple], right: list[tuple], least: float) -> list[tuple[int, int]]:
    """Similar pairs of different classes; of those that connect the same classes, one is enough."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    grams = np.concatenate([m[3] for m in right])
    owner = np.repeat(np.arange(len(right)), [len(m[3]) for m in right])
    counts = np.concatenate([m[4] for m in right])
    order = np.argsort(grams, kind="stable")
    grams, owner, counts = grams[order], owner[order], counts[order]
    weight = np.asarray([m[2] for m in right])
    out = []
    for one, label, size, own, often in left:
        lo, hi = np.searchsorted(grams, own), np.searchsorted(grams, own, side="right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = np.bincount(owner[at], np.minimum(counts[at], np.repeat(often, n)), len(right))
        for k in np.flatnonzero(both >= least * (weight + size - both) * (1 - 1e-12)).tolist():
            other, theirs = right[k][0], right[k][1]
            a, b = top(label), top(theirs)
            if a != b and both[k] / (weight[k] + size - both[k]) >= least:
                up[max(a, b)] = min(a, b)
                out.append((min(one, other), max(one, other)))
    return out


def _body(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text, content): a row is told by its id and a hash of its text."""
    t = docs[text].cast("string")
    return docs.select(docs[key].cast("bigint").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("content"))


def _rooted(docs: DataFrame, least: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and (fp1, fp2, first, root) of each different sequence of words: its first row (doc_id, content) and the number of its class."""
    spark = docs.sparkSession
    bound_batches(spark)
    body = _body(docs, key, text)
    marked = written(signed(body), "signatures")
    some = marked.where(F.col("doc_id").isNotNull() & (F.col("weight") > 0))
    # one for each sequence of words: counts are combined before the shuffle however large a group is
    one = some.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "content")).alias("first"), F.first("weight").alias("weight"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    alike = written(one.withColumn("id", F.monotonically_increasing_id()), "copies")
    members = alike.select("id", "weight", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = written(members.join(buckets, "key", "left_semi"), "shared-bands")
    sketches = written(alike.join(shared.select("id").distinct(), "id", "left_semi").select("id", "first", "sketch"), "sketches")
    # shuffled at every size, so that the ids of all candidates are never broadcast; repeated rows give one text
    firsts = sketches.select("id", "first.doc_id", "first.content").hint("merge")
    texts = written(body.join(firsts, ["doc_id", "content"]).groupBy("doc_id", "content").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text"), "texts")
    labels, links, seen = None, None, None
    for number in range(HEADS + 1):
        if number < HEADS:
            pairs = _round(shared, labels, number, least)
            pairs = written(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
            seen = pairs if seen is None else seen.unionByName(pairs)
            found = _verified(_likely(pairs, sketches, least), texts, least)
        else:
            found = written(_rest(shared, labels, texts, least), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
    if labels is None:
        labels = spark.createDataFrame([], "id bigint, label bigint")
    return marked, alike.join(labels, "id", "left").select("fp1", "fp2", "first", F.coalesce("label", "id").alias("root"))


def classes(docs: DataFrame, least: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id), a row for each row of ``docs``: the smallest id of the class."""
    marked, rooted = _rooted(docs, least, key, text)
    rooted = written(rooted, "classes")
    smallest = rooted.groupBy("root").agg(F.min("first.doc_id").alias("class_id"))
    grouped = rooted.join(smallest, "root").select("fp1", "fp2", "class_id")
    # copies of one text may be very many: they meet one row
    out = marked.select("doc_id", "fp1", "fp2", "weight").join(grouped, ["fp1", "fp2"], "left")
    return out.select("doc_id", F.when(F.col("weight") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).otherwise(F.col("doc_id")).alias("class_id"))


#: A character that belongs to a word.
_WORD = r"[A-Za-z0-9]|[^\x00-\x7F]"


def keep_one(docs: DataFrame, least: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that of the smallest id, then of the smallest hash of its text, then, where rows of
    that id and text differ in other columns, of the smallest hash of the row. Rows without an id or without words stay."""
    marked, rooted = _rooted(docs, least, key, text)
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    mine = written(marked.join(first, ["doc_id", "content"], "left_semi").groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n")), "kept-ids")
    words = F.coalesce(docs[text].cast("string").rlike(_WORD), F.lit(False))
    alone = docs.where(docs[key].isNull() | ~words)
    here = [docs[key].cast("bigint") == F.col("__id"), F.xxhash64(docs[text].cast("string")) == F.col("__content")]
    same = lambda ids: docs.where(words).join(ids.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")), here, "left_semi")
    out = same(mine.where("n = 1")).unionByName(alone)
    repeated = mine.where("n > 1")
    if repeated.isEmpty():
        return out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = same(repeated).groupBy(F.col(f"`{key}`").alias("__id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("__content")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return out.unionByName(rows.select("__row.*"))
