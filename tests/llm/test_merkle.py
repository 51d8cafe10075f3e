"""The Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from sessionrank.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """The root of nodes, and the siblings of each, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 3 * 3
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 3])))
            at[i] = k // 3
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        mine = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[s] = (mine, *tree([leaf(r) for r in mine]))
    if not order:
        return []
    root, ways = tree([made[s][1] for s in order])
    return [(r[0], leaf(r), made[s][1], root, path + way) for s, way in zip(order, ways) for r, path in zip(made[s][0], made[s][2])]


def found(df, **options):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in merkle.manifest(df, **options).collect())


def wanted(rows):
    return sorted((str(i), *rest) for i, *rest in plain(rows))


def folded(start, path):
    for before, after in path:
        start = sha(before, start, after)
    return start


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    body = {r[0]: r for r in rows}
    want = {w[0]: w for w in plain(rows)}
    got = driver.queries()["op12_merkle_manifest"](spark, sf).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1
    for r in got:
        _, own, subroot, root, path = want[r.doc_id]
        *head, text = body[r.doc_id]
        tampered = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None
        up = folded(leaf((*head, text.replace("\n", ""))) if tampered else own, path)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (own, subroot, root, sha(*[a + b for a, b in path]))
        assert (r.folded_root, r.verified) == (up, up == root)
        assert r.verified == (not (tampered and "\n" in text))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_many_sizes_and_sparse_ids(spark, levels):
    """Sources of 1 to 30 and 400 leaves, with ids of either sign, near and far apart, in blocks of several sizes."""
    pick, rows = random.Random(levels), []
    for k, n in enumerate([*range(1, 31), 400]):
        kinds = [lambda: pick.randrange(n * 2), lambda: pick.randrange(-(1 << 63), 1 << 63), lambda: pick.randrange(-70_000, 70_000)]
        ids = set()
        while len(ids) < n:
            ids.add(kinds[k % 3]())
        rows += [(i, f"s{k}é" if k else None, "en", 1, f"text {i}\n") for i in ids]
    pick.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA), levels=levels) == wanted(rows)


def test_repeats_and_missing_ids(spark, monkeypatch):
    """Ids that stand for many rows, equal and different ones, and rows without an id."""
    monkeypatch.setattr(merkle, "REPEATS", 7)
    pick, rows = random.Random(2), []
    for s in ("a", "b", None):
        rows += [(pick.choice([None, 5, 5, 64, 65, 70, 200_000]), s, pick.choice(["en", None]), None, pick.choice(["", "x", "y\n", None])) for _ in range(150)]
        rows += [(i, s, "en", 3, "own") for i in (-1, 6, 66, 127, 128, 199_999)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, levels=3) == wanted(rows)
    assert found(df.repartition(5, F.rand(1)), levels=3) == wanted(rows)


def test_repeats_beyond_one_window(spark, monkeypatch):
    import functools

    monkeypatch.setattr(merkle, "running_within", functools.partial(merkle.running_within, hot_rows=20))
    rows = [(i % 3, "a", "en", 1, f"t{i}") for i in range(120)] + [(i, "a", "en", 1, "t") for i in range(10, 90)]
    assert found(spark.createDataFrame(rows, SCHEMA), levels=2) == wanted(rows)


def test_small_tables_and_carried_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    one = [(3, "a", "en", 1, "x")]
    assert found(spark.createDataFrame(one, SCHEMA)) == wanted(one)
    three = [(i, f"s{i}", None, None, None) for i in range(3)]
    assert found(spark.createDataFrame(three, SCHEMA)) == wanted(three)
    rows = [(i, "s", "en", i, "x" * i) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("slot", F.lit("clash"))
    made = merkle.manifest(df, {"key": F.col("n_chars") * 2, "slot": F.col("slot")}).collect()
    assert all(r.key == r.doc_id * 2 and r.slot == "clash" for r in made) and len(made) == 20


def test_fold_shows_a_changed_leaf(spark):
    rows = [(i, f"s{i % 4}", "en", 1, f"t{i}") for i in range(40)]
    df = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    kept = df.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.folded(F.sha2(F.col("leaf").cast("binary"), 256), F.col("path")) == F.col("root")).alias("bad"))
    assert {(r.ok, r.bad) for r in kept.collect()} == {(True, False)}


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found(odd) == wanted(rows) and found(none) == []
