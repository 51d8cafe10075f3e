"""Near-duplicates and nearest neighbours of vectors against brute force, with planted pairs and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionrank.llm import neardup, neighbours
from tests.llm import brute

NAN, INF = float("nan"), float("inf")
# copies, opposite and scaled vectors, signed zeros, other lengths, repeated and missing ids, vectors that take no part
ODD = [
    (5, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (50, [2.0, 0.0, 0.0]), (7, [-1.0, 0.0, 0.0]), (100, [0.95, 0.1, -0.0]), (150, [0.95, 0.1, 0.0]),
    (9, [0.0, 1.0, 0.0]), (9, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 1.0]), (11, [1.0, 0.0]), (200, [1.0, 0.01]), (None, [1.0, 0.0, 0.0]),
    (12, None), (13, [0.0, 0.0, 0.0]), (14, [NAN, 1.0, 0.0]), (15, [1.0, None, 0.0]), (250, [INF, 0.0, 0.0]), (16, []), (12, None), (None, None),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("node", "n", "dim", "list", "block", "score", "rank", "label")])


def takes_part(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def linked(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) of all rows, by comparing all."""
    good = [i for i, (v, e) in enumerate(rows) if v is not None and takes_part(e)]
    edges = [(i, j) for i in good for j in good if i < j and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= least]
    n = [0] * len(rows)
    for pair in edges:
        for i in pair:
            n[i] += 1
    group = brute.components(range(len(rows)), edges)
    smallest = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            smallest[group[i]] = min(v, smallest.get(group[i], v))
    return [(v, n[i], None if v is None else smallest[group[i]], v is not None and smallest[group[i]] == v) for i, (v, _) in enumerate(rows)]


def found(df):
    return [(r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def planted(n, pairs, seed, dim=32):
    """Random vectors, ``pairs`` of them with a near copy at a cosine from just above 0.9, and a tight group of 60."""
    pick = np.random.default_rng(seed)
    x = pick.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(pairs):
        side = pick.normal(size=dim)
        side -= (side @ x[i]) * x[i]
        c = pick.uniform(0.905, 0.93)
        x[n - 1 - i] = c * x[i] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x[pairs : pairs + 60] = x[pairs] + 0.02 * pick.normal(size=(60, dim))
    return (x * pick.uniform(0.5, 2, size=(n, 1))).astype(np.float32)


def rows_of(x):
    return [(i, v.tolist()) for i, v in enumerate(x)]


def pairs_of(x):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return int(np.triu(u @ u.T >= 0.9, 1).sum())


@pytest.mark.parametrize("lists", [(0, 1), (3, 12), (5, 25)])
def test_planted_links_over_lists_and_blocks(spark, lists, monkeypatch):
    monkeypatch.setattr(neardup, "lists_for", lambda n, cosine: lists)
    monkeypatch.setattr(neardup, "LEAST", 200)
    monkeypatch.setattr(neardup, "MOST", 200)
    x = planted(1500, 200, 4)
    got, want = {r[0]: r for r in found(frame(spark, rows_of(x)))}, linked_fast(x)
    assert sorted(got) == list(range(len(x)))
    links, truth = sum(r[1] for r in got.values()), sum(want)
    assert truth == 2 * pairs_of(x) >= 2 * (200 + 1700)
    assert all(got[i][1] <= want[i] for i in got)  # none below the threshold, none counted twice
    assert links >= 0.98 * truth
    for i, (v, n, component, kept) in got.items():
        assert component <= v and kept == (component == v) and (n > 0 or component == v)


def linked_fast(x):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()


def test_windows_hold_what_lies_within_them():
    x = planted(700, 50, 8)
    table = neardup.pa.table({"node": np.arange(700), "n": np.ones(700, np.int64), "embedding": neardup.pa.array(x.tolist(), neardup.pa.list_(neardup.pa.float32()))})
    a, b = (neardup.Block(table.slice(at, 350), 0, 0) for at in (0, 350))
    half = neardup.WINDOW * math.sqrt(0.2)
    count = (np.abs(a.line[:, None, :] - b.line[None, :, :]) <= half).sum(axis=2)
    least = neardup.binomial_least(neardup.LINES, 2 * neardup.normal_below(neardup.WINDOW) - 1, neardup.RECALL)
    want = {(i, j) for i, j in zip(*np.nonzero((count >= least) & (a.vector @ b.vector.T >= 0.9)))}
    assert {(i, j) for r, c in neardup.close_pairs(a, b, 0.9, False) for i, j in zip(r, c)} == want and len(want) >= 45


def test_near_duplicates_of_odd_rows(spark):
    assert order(found(frame(spark, ODD))) == order(linked(ODD))
    assert found(frame(spark, [])) == []
    assert order(found(frame(spark, [r for r in ODD if not takes_part(r[1])]))) == order(linked([r for r in ODD if not takes_part(r[1])]))


# --- nearest neighbours -------------------------------------------------------------------------------


def nearest(rows, every=50, k=5):
    good = [(v, e) for v, e in rows if v is not None and takes_part(e)]
    out = []
    for q, e in {(v, tuple(e)) for v, e in good if v % every == 0}:
        scored = sorted((-round(cosine(e, f), 12), v) for v, f in good if v != q and len(f) == len(e))
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored[:k])]
    return sorted(out)


def answers(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in neighbours.search(df).collect())


def test_neighbours_of_odd_rows(spark):
    got, want = answers(frame(spark, ODD)), nearest(ODD)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert answers(frame(spark, [])) == []


def test_neighbours_reach_the_recall(spark):
    x = planted(3000, 500, 6)
    got, want = answers(frame(spark, rows_of(x))), nearest(rows_of(x))
    assert len(got) == len(want)
    assert len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) >= 0.9 * len(want)
    exact = {(q, v): s for q, _, v, s in got}
    for (q, v), s in exact.items():
        assert s == pytest.approx(cosine(x[q], x[v]), abs=1e-9)
