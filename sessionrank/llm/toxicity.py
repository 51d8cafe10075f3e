"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the text of rows labelled toxic and one on that
of the others. A text is cut into word windows; a window that compresses shorter with the toxic
dictionary than with the ordinary one, by a margin, is suspicious. The margin and the curve from
suspicious windows to a score are calibrated on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.llm.common import arrow_rows, fixed_columns, small_or_shuffled, texts

SAMPLE = 8_000  # labelled rows the classifier is fitted on, at most
FOLDS = 5  # rows whose crc32(doc_id) is 0 modulo this are never learned from
WINDOW = 24  # code points of a window at most: a word, or a piece of a longer one
DICTIONARY = 32_768
MANY = (0.003, 0.01, 0.03, 0.1)  # shares of a class's rows that must hold a window for its dictionary to learn it; one is chosen by calibration
LIFT = 40.0  # times the ordinary share, for a window to count as toxic text
LEVEL = 9
HELD = 150_000  # window distances a worker keeps
_WORDS = re.compile(r"[^\W\d_]+")


def windows(text: str) -> Counter:
    """The word windows of a text, lower-cased, with their numbers; a long word is several windows."""
    found = Counter(_WORDS.findall(text.lower()))
    for w in [w for w in found if len(w) > WINDOW]:
        n = found.pop(w)
        for i in range(0, len(w), WINDOW):
            found[w[i : i + WINDOW]] += n
    return found


def framed(window: str) -> bytes:
    """A window between marks, so that a match covers whole words and is long enough to be tried."""
    return f"\n<-{window}->\n".encode()


class Distances:
    """Normalised compression distances of windows to the toxic dictionary, in percent.

    0: the window compresses as short as one reference allows; 100: no shorter than with the
    ordinary dictionary, which is also the distance of windows that the ordinary one holds.
    """

    def __init__(self, toxic: bytes, plain: bytes):
        import zstandard

        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=DICTIONARY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.pair = []
        for body in (plain, toxic):
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=options)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress)
        whole = plain[-64:] if len(plain) >= 64 else plain
        self.least = len(self.pair[0](whole))  # what one reference costs
        self.held: dict[str, int] = {}

    def of(self, counts: Counter) -> dict[int, int]:
        """How many windows of a text have which distance."""
        plain, toxic = self.pair
        held, out = self.held, {}
        for w, n in counts.items():
            d = held.get(w)
            if d is None:
                body = framed(w)
                a, b = len(plain(body)) - self.least, len(toxic(body)) - self.least
                d = 100 if a <= 1 else min(100, max(0, 100 * b // a))
                if len(held) >= HELD:
                    held.clear()
                held[w] = d
            out[d] = out.get(d, 0) + n
        return out


@dataclass(frozen=True)
class Model:
    toxic: bytes
    plain: bytes
    margin: int
    weights: tuple[float, ...]  # of the features


def features(distances: list[dict[int, int]], margin: int) -> np.ndarray:
    """1, and the logs of the numbers of windows within the margin and of all windows."""
    def within(most):
        return np.log1p(np.array([sum(n for d, n in row.items() if d <= most) for row in distances], float))

    return np.stack([np.ones(len(distances)), within(margin), within(100)], axis=1).reshape(-1, 3)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def log_odds(toxic: float, other: float) -> float:
    return float(np.log((toxic + 0.5) / (other + 0.5)))


UNSURE = float(np.log(0.49 / 0.51))  # the most that is said of a text without dictionaries


def fit_texts(body: list[str], toxic: list[int], dictionary: int = DICTIONARY, odds: float | None = None) -> Model:
    """A model from labelled texts."""
    return fit_windows([windows(t) for t in body], toxic, dictionary, odds)


def fit_windows(cut: list[Counter], toxic: list[int], dictionary: int = DICTIONARY, odds: float | None = None) -> Model:
    """A model from the windows of labelled texts: even places train the dictionaries, odd ones calibrate.

    ``odds`` are the log odds of the toxic class among all labelled rows, if the texts are a
    sample with other ones; the curve is moved by the difference. Where the texts give no
    dictionaries, nothing can be told: every score is the share of the class, and below 0.5.
    """
    y = np.array(toxic, float)
    drawn = log_odds(y.sum(), len(y) - y.sum())
    moved = (drawn if odds is None else odds) - drawn
    untold = Model(b"", b"", 1, (min(drawn + moved, UNSURE), 0.0, 0.0))
    train = list(range(0, len(cut), 2))
    if len(set(toxic)) < 2 or len({toxic[i] for i in train}) < 2:
        return untold

    def counted(rows: list[int]) -> tuple[list[Counter], list[int]]:
        """In how many rows of each class a window stands, and their numbers plus 1."""
        holds, size = [Counter(), Counter()], [1, 1]
        for i in rows:
            holds[toxic[i]].update(cut[i].keys())
            size[toxic[i]] += 1
        return holds, size

    def trained(k: int, many: float, holds: list[Counter], size: list[int]) -> bytes:
        """Windows that many rows of the class hold, the commonest at the end, where they are cheapest to refer to; for the toxic one only what sets it apart."""
        least = max(3, many * size[k])
        words = [(n, w) for w, n in holds[k].items() if n >= least and (k == 0 or n / size[1] > LIFT * holds[0][w] / size[0])]
        return b"".join(framed(w) for _, w in sorted(words))[-dictionary:]

    tune = list(range(1, len(cut), 2))
    if len({toxic[i] for i in tune}) < 2:
        tune = list(range(len(cut)))
    seen, best = counted(train), None
    for many in MANY:
        bodies = [trained(k, many, *seen) for k in (1, 0)]
        if min(map(len, bodies)) < 8:
            continue
        distances = Distances(*bodies)
        found = [distances.of(cut[i]) for i in tune]
        for margin in range(0, 100, 10):
            x = features(found, margin)
            w = logistic(x, y[tune])
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -np.mean(np.where(y[tune] > 0, np.log(p), np.log(1 - p)))
            if best is None or loss < best[0]:
                best = (loss, margin, tuple(map(float, w)), many)
    if best is None:
        return untold
    whole = counted(list(range(len(cut))))
    # the curve is set; the dictionaries may now learn from all rows
    return Model(*[trained(k, best[3], *whole) for k in (1, 0)], best[1], (best[2][0] + moved, *best[2][1:]))


def held_out(ident) -> F.Column:
    """Whether a row belongs to the fold that is never learned from; a null id does."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows, chosen by hash of their ids outside the held-out fold.

    A documented bound: the classifier is fitted on this sample, scores are given to all rows.
    Half of the sample is toxic rows if there are as many. Rows without text or label are left
    out. Whole texts are cut into windows where they lie; the driver gets the windows of a row and their numbers.
    """
    given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    given = given.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    n = dict(given.groupBy("toxic").count().collect())
    picked = None
    for k in (0, 1):
        part = given.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        picked = part if picked is None else picked.union(part)
    rows = fixed_columns(docs, "doc_id", "text").where("text is not null").join(small_or_shuffled(picked, sample), "doc_id")
    made = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("tie", pa.int64()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])

    def run(parts):
        for part in parts:
            cut = [windows(t) for t in texts(part.column("text"))]
            yield arrow_rows(made, [part.column("doc_id"), part.column("toxic"), part.column("tie"), [list(c) for c in cut], [list(c.values()) for c in cut]])

    tied = rows.select("doc_id", "toxic", F.xxhash64("text").alias("tie"), "text")
    found = tied.mapInArrow(run, "doc_id bigint, toxic int, tie bigint, words array<string>, n array<bigint>")
    found = found.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "tie").limit(2 * sample).select("toxic", "words", "n").toArrow().combine_chunks()
    toxic, cut = found.column("toxic").to_pylist(), _counters(found.column("words").combine_chunks(), found.column("n").combine_chunks())
    del found
    pa.default_memory_pool().release_unused()  # the driver keeps counters only; the pool would hold on to the pages of the rows
    order = sorted(range(len(toxic)), key=lambda i: toxic[i])  # classes apart, so that each is halved
    return fit_windows([cut[i] for i in order], [toxic[i] for i in order], odds=log_odds(n.get(1, 0), n.get(0, 0)))


def _counters(words: pa.ListArray, n: pa.ListArray) -> list[Counter]:
    """The windows of rows with their numbers; equal windows are one string."""
    if not len(words):
        return []
    coded, ends = words.flatten().dictionary_encode(), np.asarray(words.offsets) - words.offsets[0].as_py()
    names, codes, numbers = coded.dictionary.to_pylist(), np.asarray(coded.indices), np.asarray(n.flatten())
    return [Counter(dict(zip([names[j] for j in codes[a:b].tolist()], numbers[a:b].tolist()))) for a, b in zip(ends, ends[1:])]


def score_texts(model: Model, body: list[str], distances: Distances | None) -> np.ndarray:
    if distances is None:
        z = np.full(len(body), model.weights[0])
    else:
        z = features([distances.of(windows(t)) for t in body], model.margin) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_LOADED: dict[Model, Distances | None] = {}


def loaded(model: Model) -> Distances | None:
    """The distances of a model; a Python worker keeps them from task to task."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Distances(model.toxic, model.plain) if model.toxic else None
    return _LOADED[model]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    The score comes from the text alone; null and empty texts have no windows and get the
    curve's value for that. Repeated rows and null ids give a row each; other columns are not
    read; no rows give no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(parts):
        m = shared.value
        distances = loaded(m)
        for part in parts:
            yield arrow_rows(out, [part.column("doc_id"), score_texts(m, texts(part.column("text")), distances)])

    made = fixed_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score as toxic; columns, repeats and nulls as they were.

    A model without dictionaries scores no row as toxic, so that all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text):
        import pandas as pd

        m = shared.value
        return pd.Series(score_texts(m, ["" if t is None else t for t in text], loaded(m)) < 0.5)

    return docs.where(clean(F.col("text").cast("string")))
