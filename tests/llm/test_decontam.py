"""The multi-pattern search for benchmark windows against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as driver
from sessionrank.llm import decontam

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def windows(items, width=10):
    out = set()
    for i, t in items:
        w = words(t)
        out |= {(tuple(w[k : k + width]), i) for k in range(max(1, len(w) - width + 1)) if w}
    return out


def plain(text, wins):
    """Number of words, places of hit words, items."""
    w, hit, items = words(text), set(), set()
    for window, i in wins:
        for k in range(len(w) - len(window) + 1):
            if tuple(w[k : k + len(window)]) == window:
                hit.update(range(k, k + len(window)))
                items |= {i} - {None}
    return len(w), hit, items


def tables(wins):
    return decontam.patterns([(" " + " ".join(w) + " ", i) for w, i in wins])


def found(arrays):
    return [(n, {k for s in spans for k in range(s["start"], s["end"])}, set(items)) for n, spans, items in zip(*(a.to_pylist() for a in arrays))]


def test_query(spark, sf):
    body = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    wins = windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    by_first = {}
    for w, i in wins:
        by_first.setdefault(w[0], []).append((w, i))
    rows = driver.queries()["op13_decontamination"](spark, sf).collect()
    assert len(rows) == len(body)
    for r in rows:
        near = [x for first in set(words(body[r.doc_id])) for x in by_first.get(first, ())]
        joined = " " + " ".join(words(body[r.doc_id])) + " "
        n, hit, items = plain(body[r.doc_id], [(w, i) for w, i in near if f" {' '.join(w)} " in joined])
        ids = ",".join(sorted(map(str, items)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


@pytest.mark.parametrize("seed", range(12))
def test_search_over_lengths_and_blocks(seed, monkeypatch):
    """Short and long items with many partial matches, in one block and in two, with cursors and slices that end anywhere."""
    monkeypatch.setattr(decontam, "SPAN", [1, 7, 512][seed % 3])
    monkeypatch.setattr(decontam, "SLICE", [16, 50, 4 << 20][seed % 3])
    pick = random.Random(seed)
    width = pick.choice([2, 3, 10])

    def text(n):
        return "".join(pick.choice(["a", "B", "c", "dé", "日本", "e1", "longerword", "\U0001f600"]) + pick.choice([" ", "  ", ", ", "\n", "-", "\x7f"]) for _ in range(n))

    wins = windows([(i % 6 if i else None, text(pick.choice([0, 1, 2, 5, 12, 30]))) for i in range(10)], width)
    docs = [text(pick.randint(0, 80)) for _ in range(40)] + ["", None, " ,", "a"]
    docs[3] = docs[4]
    column, half = pa.array(docs, pa.string()), sorted(wins, key=str)
    want = [plain(t, wins) for t in docs]
    assert found(decontam.searched(column, tables(wins))) == want
    known = decontam.searched(column, tables(half[::2]))
    assert found(decontam.searched(column, tables(half[1::2]), *known[1:])) == want
    assert found(decontam.searched(column.slice(5, 9), tables(wins))) == want[5:14]


def test_shift_tables_never_pass_an_occurrence():
    pick = random.Random(3)
    for _ in range(40):
        coded = [f" {' '.join(pick.choice(['ab', 'ba', 'b', 'aab']) for _ in range(pick.randint(1, 12)))} " for _ in range(pick.randint(1, 30))]
        p = decontam.patterns([(t, 1) for t in coded])
        text = " " + " ".join(pick.choice(["ab", "ba", "b", "aab"]) for _ in range(300)) + " "
        at, which = decontam.occurrences(np.frombuffer(text.encode(), np.uint8), p)
        got = sorted((int(a), bytes(p.body[p.start[w] : p.start[w + 1]]).decode()) for a, w in zip(at, which))
        assert got == sorted((k, t) for t in set(coded) for k in range(len(text)) if text.startswith(t, k))


def test_blocks_of_windows_and_odd_items(spark):
    """Whatever the size of a block, results are the same; items without words, id or novelty do no harm."""
    pick = random.Random(5)
    base = [" ".join(f"w{pick.randrange(30)}" for _ in range(25)) for _ in range(6)]
    items = [*enumerate(base), (0, base[0]), (None, "only marks"), (9, None), (10, ""), (11, "?!"), (12, "Short one"), (13, base[1])]
    docs = [(i, f"start {pick.choice(base)[: pick.randint(20, 90)]} and only marks, short ONE end") for i in range(30)]
    a = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, spans string")
    wins = windows(items)
    for size in (1 << 20, 3000, 700):
        for r in decontam.contamination(a, b, block_bytes=size).collect():
            n, hit, ids = plain(docs[r.doc_id][1], wins)
            assert r.n_words == n and r["items"] == sorted(ids) and {k for s in r.spans for k in range(s.start, s.end)} == hit
            assert all(x.end < y.start for x, y in zip(r.spans, r.spans[1:]))


def test_long_text(spark):
    text = ("filler words " * 100_000) + "The quick, brown fox jumps over the lazy dog again and again" + " more" * 1000 + "x" * 3_000_000
    a = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    b = spark.createDataFrame([(4, "the QUICK brown fox jumps over the lazy dog again and again")], "item_id bigint, text string")
    r = decontam.contamination(a, b).first()
    assert (r.n_words, [tuple(s) for s in r.spans], r["items"]) == (200_000 + 12 + 1000, [(200_000, 200_012)], [4])


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "mail A.B"), (3, "日本語")], "item_id bigint, text string")
    wins = windows([tuple(r) for r in items.collect()])
    want = sorted((str(r.doc_id), *map(str, plain(r.text, wins))) for r in odd.collect())
    got = decontam.contamination(odd, items).collect()
    assert sorted((str(r.doc_id), str(r.n_words), str({k for s in r.spans for k in range(s.start, s.end)}), str(set(r["items"]))) for r in got) == want
    assert decontam.contamination(none, items).count() == 0
    assert all(r.spans == [] and r["items"] == [] for r in decontam.contamination(odd, items.limit(0)).collect())
