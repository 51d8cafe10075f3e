"""Class-weighted heads, rankers and linear models with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, FeatureHasher, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrank.functions.rates import sigmoid
from sessionrank.models import factors as factors_of
from sessionrank.models.boosting import MOST_ROUNDS, PATIENCE, REFIT_ROUNDS, STEP, Boosted, Logistic, SessionSquares, Settings, boost
from sessionrank.models.pairwise import fit_pairs, linear_model
from sessionrank.operators.encode import add_sample_weights, any_positive, weighted_relevance
from sessionrank.operators.ranking import group_auc

SEED = 42


@dataclass(frozen=True)
class Trees:
    """Boosting settings of the heads. Rounds are the most that are made; on held-out rows patience ends them sooner."""

    rounds: Mapping[str, int] = field(default_factory=lambda: dict.fromkeys(REFIT_ROUNDS, MOST_ROUNDS))
    depth: int = 6
    step: float = STEP
    subsample: float = 0.8
    patience: int = PATIENCE
    every: int = 10

    def of(self, label: str) -> Settings:
        return Settings(self.rounds[label], self.patience, self.every, self.depth, self.step, self.subsample, seed=SEED)


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def balance(df: DataFrame, label: str) -> Column:
    """The weight of a row: negatives / positives of ``df`` if it is positive, 1 if not."""
    n, pos = F.count(F.lit(1)).cast("double"), F.sum(label).cast("double")
    ratio = df.select(F.greatest(n - pos, F.lit(1.0)) / F.greatest(pos, F.lit(1.0))).scalar()
    return F.when(F.col(label) > 0, ratio).otherwise(1.0)


def class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Positives weigh negatives / positives, negatives 1."""
    return df.withColumn(out, balance(df, label))


def boosted_head(train: DataFrame, label: str, features: Sequence[str], trees: Trees, validation: str | None = None, session: str = "session_id", item: str = "content_id") -> Boosted:
    """The boosting of one head: weighted log loss, classes balanced on the rows it learns from."""
    learned = train if validation is None else train.where(~F.col(validation))
    weighted = train if "weight" in train.columns else train.withColumn("weight", balance(learned, label))
    keep = [session, item, label, "weight", *([validation] if validation else [])]
    rows = assembler(features).transform(weighted).select(*keep, "features")
    return boost(rows, Logistic(label), trees.of(label), validation, label, session, item)


def fit_head(train: DataFrame, label: str, features: Sequence[str], trees: Trees, validation: str | None = None) -> PipelineModel:
    """One boosted head; with a flag of held-out rows it stops when their session AUC stops improving and keeps the best round."""
    return PipelineModel([assembler(features), boosted_head(train, label, features, trees, validation).model()])


def positive_probability(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Rows with the model's probability of the positive class."""
    scored = model.transform(df)
    value = sigmoid(F.col("prediction")) if isinstance(model.stages[-1], GBTRegressionModel) else vector_to_array("probability")[1]
    return scored.withColumn(out, value).select(*df.columns, out)


def full_refit(rows: DataFrame, features: Sequence[str], rounds: Mapping[str, int] = REFIT_ROUNDS, trees: Trees = Trees(), labels: Sequence[str] = ("ordered", "clicked")) -> dict[str, PipelineModel]:
    """The heads on all rows with fixed rounds, 486 and 1,421 unless told otherwise; nothing is held out."""
    fixed = Trees(rounds, trees.depth, trees.step, trees.subsample, trees.patience, trees.every)
    return fit_heads(rows, features, fixed, labels)


def fit_heads(train: DataFrame, features: Sequence[str], trees: Trees, labels: Sequence[str] = ("ordered", "clicked"), validation: str | None = None) -> dict[str, PipelineModel]:
    return {label: fit_head(train, label, features, trees, validation) for label in labels}


# Output column of each head.
HEAD_COLUMNS = {"ordered": "p_order", "clicked": "p_click", "any": "p_any"}


def score_heads(models: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    for label, model in models.items():
        df = positive_probability(model, df, HEAD_COLUMNS[label])
    return df


def fit_single(train: DataFrame, features: Sequence[str], trees: Trees, validation: str | None = None) -> PipelineModel:
    """One classifier on ordered-or-clicked with label-mix weights."""
    return fit_head(add_sample_weights(train.withColumn("any", any_positive())), "any", features, trees, validation)


def fit_session_ranker(train: DataFrame, features: Sequence[str], settings: Settings, validation: str | None = None, label: str = "ordered", session: str = "session_id", item: str = "content_id") -> Boosted:
    """Boosted ranker on graded relevance: in every round errors are centred anew per session, so that only the order within one counts.

    With a flag of held-out rows the session AUC of ``label`` on them stops it.
    """
    rows = assembler(features).transform(train.withColumn("_rel", weighted_relevance().cast("double")))
    rows = rows.select(session, item, label, "_rel", *([validation] if validation else []), "features")
    return boost(rows, SessionSquares("_rel", session), settings, validation, label, session, item)


def fit_centred_ranker(train: DataFrame, features: Sequence[str], rounds: int, depth: int = 4, step: float = 0.1, session: str = "session_id") -> PipelineModel:
    """The session ranker with a fixed number of rounds on all rows."""
    made = fit_session_ranker(train, features, Settings(rounds, depth=depth, step=step, subsample=1.0, seed=SEED), session=session)
    return PipelineModel([assembler(features), made.model()])


def preference_rows(train: DataFrame, features: Sequence[str], label: str, session: str = "session_id") -> DataFrame:
    """Each positive minus the mean negative of its session, and the same mirrored.

    Two rows per positive instead of one per (positive, negative) pair, so a session of any
    size costs what its rows cost. For a linear model the differences have the same mean; for
    the loss of every single pair see ``fit_preferences``.
    """
    negative = F.col(label) == 0
    means = train.groupBy(session).agg(
        F.count_if(negative).alias("_negatives"), *[F.avg(F.when(negative, F.col(c))).alias(f"_m_{c}") for c in features]
    ).where("_negatives > 0")
    signs = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("_sign")
    rows = train.where(F.col(label) > 0).join(means, session).select("*", signs)
    return rows.select(
        session, (F.col("_sign") > 0).cast("int").alias("preferred"), F.col("_negatives").cast("double").alias("weight"),
        *[(F.col("_sign") * (F.col(c) - F.col(f"_m_{c}"))).alias(c) for c in features],
    )


def fit_preferences(train: DataFrame, features: Sequence[str], label: str = "ordered", session: str = "session_id", item: str = "content_id", rounds: int = 30, ridge: float = 1e-3) -> PipelineModel:
    """Linear ranker on all (positive, negative) pairs of a session; its score orders items of a session."""
    weights, _ = fit_pairs(train, features, label, ridge, rounds, session, item)
    return PipelineModel([assembler(features), linear_model(weights)])


def raw_score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """The linear score of a classifier, or the prediction of a regressor."""
    scored = model.transform(df)
    value = vector_to_array("rawPrediction")[1] if "rawPrediction" in scored.columns else F.col("prediction")
    return scored.withColumn(out, value).select(*df.columns, out)


def fit_factorization(train: DataFrame, features: Sequence[str], label: str, factors: int = 4, rounds: int = 20) -> PipelineModel:
    """Second-order factorisation machine on scaled inputs."""
    return PipelineModel([assembler(features), factors_of.fit(train, features, label, factors, rounds, 0.05, SEED)])


def wide_hasher(columns: Sequence[str], size: int = 1 << 18) -> FeatureHasher:
    """feature=value indicators hashed to a fixed width."""
    return FeatureHasher(inputCols=list(columns), outputCol="features", numFeatures=size, categoricalCols=list(columns))


def fit_wide(train: DataFrame, columns: Sequence[str], label: str, size: int = 1 << 18, rounds: int = 20) -> PipelineModel:
    """Weighted linear model on hashed categories."""
    weighted = train if "weight" in train.columns else class_weight(train, label)
    linear = LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=rounds, regParam=0.001)
    return Pipeline(stages=[wide_hasher(columns, size), linear]).fit(weighted)


def tune(train: DataFrame, val: DataFrame, settings: Sequence[Mapping[str, float]], fit: Callable[[DataFrame, Mapping[str, float]], PipelineModel]) -> list[tuple[dict, float]]:
    """(settings, ranking score on the validation rows) of every setting."""
    results = []
    for setting in settings:
        scored = positive_probability(fit(train, setting), val, "_p")
        results.append((dict(setting), group_auc(scored, "_p").first()["score"]))
    return results


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance) of a tree model; one row per feature."""
    spark = SparkSession.getActiveSession()
    weights = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double")


def text_vectors(df: DataFrame, text: str, size: int = 1 << 12, out: str = "vector") -> DataFrame:
    """TF-IDF vectors of a text column, whole texts."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+")
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size)
    idf = IDF(inputCol="_tf", outputCol=out)
    filled = df.na.fill("unknown", [text])
    return Pipeline(stages=[words, tf, idf]).fit(filled).transform(filled).drop("_words", "_tf")


def stored_values(vector: str) -> Column:
    """The values a vector holds, in order of their places: of a sparse one those that are set, not an array of its whole width."""
    return F.unwrap_udt(F.col(vector))["values"]
