"""How well a product text answers a search term."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrank.functions.text import tokens

# The usual BM25 constants.
K1 = 1.2
B = 0.75


def bm25_weights(documents: DataFrame, key: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, token, weight): the part each token of a document adds to its score."""
    docs = documents.select(key, tokens(F.lower(text)).alias("_t"))
    sized = docs.select(key, "_t", F.size("_t").alias("_len"))
    postings = sized.select(key, "_len", F.explode("_t").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("_tf"), F.first("_len").alias("_len"))
    spread = postings.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    n, mean = docs.select(F.count(F.lit(1))).scalar(), sized.select(F.avg("_len")).scalar()
    idf = F.log(1.0 + (n - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    tf = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / mean))
    return postings.join(spread, "token").select(key, "token", (idf * tf).alias("weight"))


def bm25(rows: DataFrame, documents: DataFrame, key: str = "content_id", term: str = "search_term", text: str = "product_text", out: str = "relevance") -> DataFrame:
    """Rows with the BM25 score of their term against the document of their key, 0 without a shared token.

    Scores are computed once per distinct (key, term), then joined back.
    """
    pairs = rows.select(key, term).distinct()
    asked = pairs.select(key, term, F.explode(F.array_distinct(tokens(F.lower(term)))).alias("token"))
    scores = asked.join(bm25_weights(documents, key, text), [key, "token"]).groupBy(key, term).agg(F.sum("weight").alias(out))
    return rows.join(scores, [key, term], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


Scorer = Callable[[pd.DataFrame], pd.Series]


def _tokens_of_rows(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of all tokens of a text column, lower-cased, parted by white space."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
    rows, words = pc.list_parent_indices(split), pc.list_flatten(split)
    full = pc.not_equal(words, "")
    return np.asarray(rows.filter(full)), words.filter(full)


def token_share(query: pa.Array, text: pa.Array) -> np.ndarray:
    """Share of each query's distinct tokens found in its text, 0 without tokens.

    The tokens of a batch are coded by one dictionary; a (row, code) pair is then one number,
    and distinct pairs of queries are looked up among those of the texts.
    """
    (q_row, q_words), (t_row, t_words) = _tokens_of_rows(query), _tokens_of_rows(text)
    coded = pa.concat_arrays([q_words, t_words]).dictionary_encode()
    codes, size = np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary))
    asked = np.unique(q_row.astype(np.int64) * size + codes[: len(q_row)])
    held = np.unique(t_row.astype(np.int64) * size + codes[len(q_row) :])
    wanted = np.bincount(asked // size, minlength=len(query))
    met = np.bincount(asked[np.isin(asked, held, assume_unique=True)] // size, minlength=len(query))
    return np.divide(met, wanted, out=np.zeros(len(query)), where=wanted > 0)


def score_pairs(pairs: DataFrame, scorer: Scorer | None = None, out: str = "score") -> DataFrame:
    """Score (query, text) rows in Arrow batches: by shared tokens, or by any model-like function of pandas batches."""
    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.DoubleType())])
    if scorer is not None:

        def run(batches):
            for batch in batches:
                yield batch.assign(**{out: scorer(batch).to_numpy()})

        return pairs.mapInPandas(run, schema)

    def share(batches):
        for batch in batches:
            yield batch.append_column(out, pa.array(token_share(batch.column("query"), batch.column("text")), pa.float64()))

    return pairs.mapInArrow(share, schema)
