"""The registered queries and the pipeline over the smallest tables."""

from collections import Counter

import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["op3_mixing", "op6_top_k"])
def test_sql_agrees(spark, duck, name):
    from threadloom.llm import queries

    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_all_queries_and_their_columns(spark):
    from threadloom.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for number in (1, 2, 5, 8, 9):
        name = next(x for x in queries.QUERIES if x.startswith(f"op{number}_"))
        df = queries.QUERIES[name](spark, SMALL)
        assert df.count() == n and "doc_id" in df.columns


def test_pipeline(spark):
    """Each stage against what its operator must do to its own input."""
    import corpus_pipeline
    from tests.llm.test_operators import brute_substrings
    from threadloom.llm.common import stored

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SMALL), "stage")
        kept[name] = (docs.toPandas(), out.toPandas())
        docs = out
    assert all(list(out.columns) == columns for name, (_, out) in kept.items() if name != "packing")
    before, after = kept["quality classifier"]
    assert set(after.doc_id) < set(before.doc_id) and after.text.isin(before.text).all()
    before, after = kept["SimHash near-dedup"]
    assert after.doc_id.is_unique and set(after.doc_id) <= set(before.doc_id)
    before, after = kept["substring dedup"]
    want = {i: n - gone for i, n, gone, _ in brute_substrings(list(zip(before.doc_id, before.text, before.source, strict=True)))}
    assert {i: len((t or "").encode().split()) for i, t in zip(after.doc_id, after.text, strict=True)} == want
    assert (after.n_chars == after.text.str.len()).all()
    before, after = kept["mixing to target weights"]
    copies = Counter(after.doc_id)
    assert max(copies.values()) <= 3 and set(copies) <= set(before.doc_id)
    before, after = kept["packing"]
    assert Counter(after[after.start == 0].doc_id) == Counter(before.doc_id)
    assert (after.groupby("sequence_id").length.sum() <= 4096).all() and np.issubdtype(after.ids_crc32.dtype, np.integer)


def test_run_on_awkward_rows_and_on_none(spark, tmp_path):
    """run() with null ids, texts and sources, repeated rows and empty texts: whole pieces in whole sequences; an empty table gives none."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(None, "no id at all, but words", "en", None, 23), (None, None, None, None, None), (10**6, None, "en", "src0", None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, " \t\n", None, "src1", 3), (10**6 + 3, "said once and again", "en", "src1", 19), (10**6 + 3, "said once and again", "en", "src1", 19)]
    docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("some", "none"):
        spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/some").toPandas()
    ids = {r[0] for r in docs.select("doc_id").collect()} | {r[0] for r in odd}
    assert len(pieces) > 20 and {None if i != i else int(i) for i in pieces.doc_id} <= ids
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096
    for (_, whole), own in pieces[pieces.doc_id.notna()].groupby(["doc_id", "doc_tokens"]):
        assert own.length.sum() % whole == 0 and (own.start + own.length <= whole).all()  # a document may be there up to three times
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").isEmpty()
