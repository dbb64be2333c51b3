"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import sql
from tilewright.llm.store import table


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tilewright.llm.preference import format_pairs, replayed, turns

    pairs = format_pairs(replayed(turns(table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), ";").alias(c)
    return pairs.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.quality import quality_table

    return quality_table(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewright.llm.huffman import round_trip
    from tilewright.llm.token_count import read_definition

    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, read_definition(public_tokenizers.path("word_bpe_49k.json")), end_id=1).drop("ids")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tilewright.llm.near_dup import classes

    return classes(table(spark, sf_dir, "documents")).withColumn("is_kept", F.col("doc_id") == F.col("class_id"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewright.llm.bpe import encode_decode, read_ranks

    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))


#: The query's key. A deployment passes its own secret.
PSEUDONYM_KEY = "op8-query-key"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.pseudonym import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PSEUDONYM_KEY, count="n_replaced")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tilewright.llm.licenses import known_table, scan

    found = scan(table(spark, sf_dir, "documents"), known_table(spark))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"), "n_notice_lines")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewright.llm.token_count import count_tokens, read_definition

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, read_definition(public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {
    "op1_preference_pairs": op1_preference_pairs,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_ids": op4_token_ids,
    "op5_near_dup": op5_near_dup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
}

SQL: dict[str, str] = {
    "op1_preference_pairs": sql.OP1,
    "op3_quality_rules": sql.OP3,
    "op9_license_scan": sql.op9(),
}
