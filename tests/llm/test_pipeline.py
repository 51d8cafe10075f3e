"""The stages of the pipeline one after another against plain versions, on the smallest tables, odd rows and no rows."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionrank.llm import common, tokencount
from tests.llm import brute

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def model():
    return tokencount.Piecewise(public_tokenizers.path("piece_bpe_32k.model"))


def stages(spark, folder):
    """The rows of the documents and of every stage, and the columns of each."""
    df = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"documents": df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        df = common.stored(stage(spark, df, folder), f"tested_{name}")
        out[name] = df.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == list(corpus_pipeline.COLUMNS)
    return out


def whole(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


def holds(out, model):
    """What must be true of any input."""
    docs, toxic, near, private, mixed, last = (out[k] for k in ("documents", *(n for n, _ in corpus_pipeline.STAGES)))
    assert not Counter(map(whole, toxic)) - Counter(map(whole, docs))
    assert not Counter(map(whole, near)) - Counter(map(whole, toxic))
    # one document of each group; rows without an id or without words are groups of their own
    ranked = sorted(toxic, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    groups = brute.set_components([(i, None if r.doc_id is None else r.text) for i, r in enumerate(ranked)])[1]
    members = defaultdict(Counter)
    for i, r in enumerate(ranked):
        members[groups[i]][whole(r)] += 1
    left = Counter(map(whole, near))
    assert len(near) == len(members)
    assert all(any(left[w] for w in m) for m in members.values())
    assert sorted((r.doc_id or 0) for r in private) == sorted((r.doc_id or 0) for r in near)
    for r in private:
        assert not r.text or (brute.base_spans(r.text) == [] and r.n_chars == len(r.text))
    texts = Counter(map(whole, private))
    drawn = Counter(map(whole, mixed))
    assert set(drawn) <= set(texts) and all(n <= 3 * texts[w] for w, n in drawn.items())
    given = sorted((r.doc_id or 0, model.ids([r.text or ""])[0]) for r in mixed)
    assert sorted((r.doc_id or 0, list(r.ids or [])) for r in last) == given
    assert all(r.n_tokens == len(r.ids or []) for r in last)


def test_stages_on_the_smallest_tables(spark, sf, model):
    out = stages(spark, sf)
    holds(out, model)
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in out[corpus_pipeline.STAGES[0][0]]}
    assert len(clean & kept) >= 0.95 * len(clean)


def test_odd_rows_without_a_model(spark, odd, model, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = stages(spark, tmp_path)
    holds(out, model)
    assert len(out[corpus_pipeline.STAGES[0][0]]) == odd.count()


def test_no_rows(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.count(F.lit(1))).first()[0] == 0
