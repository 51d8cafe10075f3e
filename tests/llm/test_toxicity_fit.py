"""What the toxicity model does when there is little or nothing to learn from."""

import numpy as np
import pytest

from sessionrank.llm import toxicity

DOCS = [(i, f"harmless words number {i} of a quiet text") for i in range(30)]


@pytest.mark.parametrize("labels", [[], [(i, 0) for i in range(30)], [(i, 1) for i in range(30)], [(i, i % 2) for i in range(12)], [(None, 1), (3, None), (4, 7)]])
def test_nothing_is_removed_without_a_model(spark, labels):
    """No labels, one class, equal classes without a difference, labels that mean nothing: all documents stay."""
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert toxicity.keep_clean(docs, model).count() == 30
    assert all(0 <= r.score < 0.5 and r.predicted == 0 for r in toxicity.scores(docs, model).collect())


def texts_of(toxic, other):
    return [f"you zargle and blorft number {i}" for i in range(toxic)] + [f"a calm sentence number {i}" for i in range(other)]


def test_a_sample_of_halves_keeps_the_odds_of_all():
    body, labels = texts_of(100, 100), [1] * 100 + [0] * 100
    even, rare = toxicity.fit_texts(body, labels), toxicity.fit_texts(body, labels, odds=toxicity.log_odds(1000, 99_000))
    assert even.toxic and even.weights[1:] == rare.weights[1:]
    assert even.weights[0] - rare.weights[0] == pytest.approx(np.log(100.5 / 100.5) - np.log(1000.5 / 99_000.5))
    both = toxicity.score_texts(rare, ["you zargle and blorft", "a calm sentence", ""], toxicity.loaded(rare))
    assert both[0] >= 0.5 > max(both[1:])
