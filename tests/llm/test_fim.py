"""The fill-in-middle transformation against a plain version, and its way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from sessionrank.llm import fim


def plain(ident, text, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+", seed=7):
    """n, form, output, prefix and middle length of a text."""
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(df, **options):
    out = fim.transform(df, **options)
    return out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()


def test_query(spark, sf):
    body = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = driver.queries()["op11_fill_in_middle"](spark, sf).collect()
    assert len(rows) == len(body)
    for r in rows:
        n, form, output, p, m = plain(r.doc_id, body[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(output), sha(body[r.doc_id] or ""))
    assert {r.form for r in rows} >= {"spm", "psm"}


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (60, 100), (0, 50)])
def test_texts_of_marks_and_breaks(spark, rate, spm):
    pick = random.Random(rate + spm)
    parts = ["\n", "\n", "a", "<", ">", "P", "<P>", "<S", "M>", "é", "日本", "\U0001f600", "\r", "$1", "\\", "%d"]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.randint(0, 25)))) for i in range(400)]
    got = {r.doc_id: r for r in made(spark.createDataFrame(rows, "doc_id bigint, text string"), rate=rate, spm=spm)}
    for i, text in rows:
        r = got[i]
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain(i, text, rate, spm)
        assert r.back == text
    if rate == 0:
        assert {r.form for r in got.values()} == {"plain"}


def test_other_units_and_marks(spark):
    marks = fim.Marks("[pre]", "[suf]", "[mid]")
    rows = [(i, "one two  three <P> four"[: 3 + i]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = fim.transform(df, unit=r"\S+\s*|\s+", marks=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks))
    for r in out.collect():
        assert r.form != "plain" and r.back == rows[r.doc_id][1] and r.n == len(re.findall(r"\S+\s*|\s+", r.back))
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("x<", "<S>", "<M>"), ("<P>", "-<P>-", "<M>")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)


def test_very_many_units_and_long_lines(spark):
    """No stack grows with the number of units, and a line of any length is one."""
    rows = [(1, "\n" * 300_000), (2, "some words of a line\n" * 100_000 + "end"), (3, "y" * 2_000_000)]
    for r in made(spark.createDataFrame(rows, "doc_id bigint, text string")):
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain(r.doc_id, rows[r.doc_id - 1][1]) and r.back == rows[r.doc_id - 1][1]


def test_odd_rows(spark, odd, none):
    want = sorted((str(r.doc_id), *map(str, plain(r.doc_id, r.text)), r.text or "") for r in odd.collect())
    got = sorted((str(r.doc_id), *map(str, (r.n, r.form, r.output, r.prefix_chars, r.middle_chars)), r.back) for r in made(odd))
    assert got == want
    assert made(none) == []
