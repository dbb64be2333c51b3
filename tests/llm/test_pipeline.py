"""The pipeline against its stages in plain Python, and every registered query."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.conftest import SCHEMA, awkward_rows
from tests.llm.test_decontaminate import brute as leaked
from tests.llm.test_native import judged
from tests.llm.test_near_dup import brute as near
from tilewright.llm import bpe, pseudonym, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(spark, sf, encoding):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.itertuples()]
    rows = [r for r, m in zip(rows, judged(rows, 100), strict=True) if m["kept"]]
    first = {i for i, c in near([(r[0], r[1]) for r in rows]) if i == c}
    rows = [r for r in rows if r[0] in first]
    bad = {k[0] for k in leaked([(r[0], r[1]) for r in rows], items)}
    rows = [r for r in rows if r[0] not in bad]
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string")
    new = {r.doc_id: r.text for r in pseudonym.pseudonymise(frame, queries.PSEUDONYM_KEY).collect()}
    out = Counter()
    for r in rows:
        ids = encoding.encode_ordinary(new[r[0]])
        raw = " ".join(map(str, ids)).encode()
        out[(r[0], r[2], r[3], len(ids), np.asarray(ids, "<u4").tobytes(), hashlib.sha256(raw).hexdigest(), hashlib.sha256(new[r[0]].encode()).hexdigest())] += 1
    return out


def test_run(spark, encoding):
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in got.collect()) == expected(spark, SF, encoding)


def test_awkward(spark, awkward, nothing):
    for frame in (awkward, nothing):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == awkward.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    # each stage by itself keeps what it should of rows with nulls
    assert corpus_pipeline.near_duplicates(spark, awkward, SF).where("doc_id IS NULL").count() == 2
    assert corpus_pipeline.decontaminated(spark, awkward, SF).count() == len(awkward_rows())
    assert corpus_pipeline.pseudonymised(spark, awkward, SF).where("text IS NULL").count() == sum(r[1] is None for r in awkward_rows())
    assert SCHEMA


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()

    def plain(df: pd.DataFrame):
        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple("null" if v is None or v is pd.NA else str(list(v)) if hasattr(v, "tolist") and not np.isscalar(v) else str(v) for v in r) for r in df.itertuples(index=False))

    assert plain(ours) == plain(theirs)


def test_queries_cover_documents(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_quality_rules", "op5_near_dup", "op8_pseudonyms", "op9_license_scan"):
        assert queries.QUERIES[name](spark, SF).count() == n, name
