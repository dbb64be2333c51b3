"""Quality rules whose thresholds follow the corpus: fences from mergeable quantile sketches.

Base rules are fixed. Beyond them, a document is judged by four ratios, as whole numbers:
characters in words that are neither letters nor digits, and repeated lines and words in repeated 3-word
windows by their totals, in hundred-thousandths; and the mean word length in thousandths of a
character. A sketch of a ratio is a histogram over logarithmic buckets, each power of two cut
in 128 parts: at most ``BUCKETS`` of them, a relative error under 1/128, and two merge by adding
counts. So a sketch of a (language, source) is a grouped count, that of a language or of the
corpus is the sum of its parts, and no order of merging, nor a task that is run again, changes
it (which a randomised sketch doesn't give). From its quantiles follow fences,

    high = upper + spread * (upper - lower)      low = lower - spread * (upper - lower)

with quartiles and a spread of 6 for these characters and word length (which is fenced on both sides), and
with the median, the 99th percentile and a spread of 1 for repetition, as most documents have
none, so that quartiles would be 0. There is no fixed cutoff: a document beyond a fence of its
own language and source is rejected. A group of under ``least`` documents, or one whose two
quantiles are equal and so tell no spread, takes that ratio's fence from its language, or else from
all, whatever their number and spread. Documents that the base rules reject don't shape the
sketches.

DataFrame operations only. Cases: a null text has no words and fails the base rules, as
does an empty one; a null language or source is a group of its own, apart from ''; equal
rows are judged each by itself, alike; an empty table gives an empty table; other columns
of any name are kept, as rows travel whole in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.store import written

#: Space and the bytes 9 to 13, which separate words.
SPACES = " \t\n\x0b\f\r"
SEPARATOR = r"[ \x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Low bits of a packed long that hold a word's number, as many as an array's length can need; the rest are bits of a window's hash.
_PLACE = 31
_MASK = (1 << _PLACE) - 1

#: Ratio: (numerator, denominator, scale, lower and upper quantile in hundredths, spread, fenced below as well).
RATIOS = {
    "mark_ratio": ("word_chars - n_alnum", "word_chars", 100_000, 25, 75, 6, False),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 100_000, 50, 99, 1, False),
    "repeat_ratio": ("n_repeat_words", "n_words", 100_000, 50, 99, 1, False),
    "word_length": ("word_chars", "n_words", 1000, 25, 75, 6, True),
}
#: Leading bits of a ratio that name its bucket.
BITS = 8
#: Most buckets of a sketch: a text's ratios stay under 2**41.
BUCKETS = (41 - BITS + 2) << (BITS - 1)


def _neighbour_equal(items: str, item: Column, i: Column, of) -> Column:
    before, after = F.get(F.col(items), i - 1), F.get(F.col(items), i + 1)
    return F.coalesce(of(before) == of(item), F.lit(False)) | F.coalesce(of(after) == of(item), F.lit(False))


def measures(rows: DataFrame, text: str = "_text") -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_alnum, n_lines, n_dup_lines and n_repeat_words of a text column without nulls.

    Repeated windows are found inside the row: hashes of 3-word windows are sorted with
    their places packed in the low bits, neighbours that agree in the high bits are
    compared again by whole 64-bit hashes, and the places that remain are joined up.
    """
    t = F.col(text)
    bare = F.char_length(F.translate(t, SPACES, ""))
    split = rows.withColumn("_w", F.array_remove(F.split(t, SEPARATOR), ""))
    w = F.col("_w")
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    none = F.array().cast("array<bigint>")
    hashed = split.withColumn("_t", F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)).otherwise(none)).withColumn("_n", F.size(w).cast("bigint")).drop("_w")
    packed = hashed.withColumn("_p", F.sort_array(F.transform("_t", lambda x, i: x.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("bigint")))))
    near = packed.withColumn("_c", F.filter("_p", lambda x, i: _neighbour_equal("_p", x, i, lambda v: F.shiftright(v, _PLACE)))).drop("_p")
    place = lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int")
    exact = near.withColumn("_s", F.sort_array(F.transform("_c", lambda x: F.struct(F.get(F.col("_t"), place(x)).alias("h"), place(x).alias("i"))))).drop("_c", "_t")
    found = exact.withColumn("_f", F.sort_array(F.transform(F.filter("_s", lambda x, i: _neighbour_equal("_s", x, i, lambda v: v["h"])), lambda x: x["i"]))).drop("_s")
    covered = F.aggregate(F.transform("_f", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_f"), i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    lines = found.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    return lines.select(
        *[c for c in rows.columns if c != text],
        F.col("_n").alias("n_words"),
        bare.cast("bigint").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.char_length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")).cast("bigint").alias("n_alnum"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _ratio(name: str) -> Column:
    top, bottom, scale, *_ = RATIOS[name]
    return F.when(F.expr(f"{bottom} > 0"), F.expr(f"(({top}) * {scale}) div {bottom}")).otherwise(F.lit(0)).cast("bigint")


def bucket(x: str) -> Column:
    """The least value of the bucket that a whole number of 0 or more falls in: its leading bits."""
    shift = f"greatest(0, length(bin({x})) - {BITS})"
    return F.expr(f"shiftleft(shiftright({x}, {shift}), {shift})")


def sketches(measured: DataFrame) -> DataFrame:
    """(_lang, _source, ratio, at, n): the histogram of each ratio for each language and source."""
    points = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(k).alias("at")) for k in RATIOS]))
    return measured.where(~F.col("base_failed")).select("_lang", "_source", points.alias("point")).groupBy("_lang", "_source", "point.ratio", "point.at").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: counts of the same bucket add up."""
    return sketch.groupBy(*by, "ratio", "at").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by, low, high as maps by ratio) of groups with ``least`` documents or more, without ratios of no spread but for the group of all. A sketch has ``BUCKETS`` rows at most and is folded in one."""
    cells = sketch.groupBy(*by, "ratio").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("cells"), F.sum("n").alias("total"))
    setting = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, r in RATIOS.items() for x in (k, r[i])]), F.col("ratio"))
    # the smallest bucket with at least a share of the documents in it or below

    def quantile(hundredths: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("at"))
        step = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.coalesce(a["at"], F.when(100 * (a["n"] + x["n"]) >= hundredths * F.col("total"), x["at"])).alias("at"))
        return F.aggregate("cells", start, step, lambda a: a["at"])

    both = cells.where(F.col("total") >= least).withColumn("lower", quantile(setting(3))).withColumn("upper", quantile(setting(4)))
    if by:
        both = both.where("upper > lower")
    reach = setting(5) * (F.col("upper") - F.col("lower"))
    made = both.select(*by, "ratio", F.when(setting(6), F.col("lower") - reach).alias("low"), (F.col("upper") + reach).alias("high"))
    return made.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("ratio", "low"))).alias("low"), F.map_from_entries(F.collect_list(F.struct("ratio", "high"))).alias("high"))


def judge(docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(row, measures, ratios, base_failed, kept): ``row`` is each row of ``docs``, whole."""
    body = docs.select(F.struct("*").alias("row"), docs[lang].cast("string").alias("_lang"), docs[source].cast("string").alias("_source"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))
    return _judged(body, least)


def _judged(body: DataFrame, least: int) -> DataFrame:
    measured = measures(body)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rated = written(measured.withColumns({k: _ratio(k) for k in RATIOS}).withColumn("base_failed", failed), "measures")
    fine = written(sketches(rated), "sketches")
    levels = [(fences(fine, ["_lang", "_source"], least), ["_lang", "_source"]), (fences(merged(fine, "_lang"), ["_lang"], least), ["_lang"]), (fences(merged(fine), [], 0), [])]
    # a row for each language and source that occurs, with what each level tells
    chosen = rated.select("_lang", "_source").distinct()
    for i, (level, by) in enumerate(levels):
        level = level.select(*[F.col(k).alias(f"k{k}") for k in by], F.col("low").alias(f"low{i}"), F.col("high").alias(f"high{i}"))
        same = F.lit(True)
        for k in by:
            same = same & chosen[k].eqNullSafe(level[f"k{k}"])
        chosen = chosen.join(level, same, "left").drop(*[f"k{k}" for k in by])
    pick = lambda side, k: F.coalesce(*[F.element_at(f"{side}{i}", k) for i in range(len(levels))])
    chosen = chosen.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), *[pick(side, k).alias(f"_{side}_{k}") for k in RATIOS for side in ("low", "high")])
    joined = rated.join(chosen, rated["_lang"].eqNullSafe(chosen["_l"]) & rated["_source"].eqNullSafe(chosen["_s"]), "left")
    beyond = F.lit(False)
    for k in RATIOS:
        beyond = beyond | F.coalesce(F.col(k) > F.col(f"_high_{k}"), F.lit(False)) | F.coalesce(F.col(k) < F.col(f"_low_{k}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond)


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    return judge(docs, **settings).where("kept").select("row.*")


def quality_table(docs: DataFrame, key: str = "doc_id", least: int = 100) -> DataFrame:
    """The verdict and its measures for each document, without its text."""
    body = docs.select(docs[key].alias("doc_id"), docs["lang"].cast("string").alias("_lang"), docs["source"].cast("string").alias("_source"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"))
    out = _judged(body, least)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RATIOS, *[F.col(f"_high_{k}").alias(f"{k}_fence") for k in RATIOS])
