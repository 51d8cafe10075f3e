"""The document operators against plain versions and the libraries, on the smallest tables and on odd rows."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from sessionrank.llm import mixing, pii, piece, setjoin, sharding, tokencount, tokenfile, toxicity
from tests.llm import brute

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def model():
    return tokencount.Piecewise(MODEL)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def run(name, spark, sf):
    return driver.queries()[name](spark, sf).collect()


# --- personal data ---------------------------------------------------------------------------------


def test_base_spans_equal_patterns():
    pick = random.Random(5)
    for _ in range(20_000):
        text = "".join(pick.choice("ab1250. +-@(_%9") for _ in range(pick.randint(0, 30)))
        assert pii.base_spans(text) == brute.base_spans(text), text


def test_base_spans_of_long_runs_take_no_quadratic_time():
    for text in ("a" * 500_000, "1" * 500_000, "a@" * 200_000, "1." * 200_000, "+1" * 200_000, "@" * 200_000):
        pii.base_spans(text)


def test_pii_query(spark, sf, docs):
    body = texts(docs)
    for r in run("op1_pii_disclosure", spark, sf):
        want = brute.base_spans(body[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        n = Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        if not want:
            assert r.spans == ""  # documents without personal data are left alone


def test_revealing_terms_are_found(spark):
    rows = [(i, f"the usual words stand here number{'abcdefghij'[i % 10] * 4} and more of them") for i in range(200)]
    rows += [(500 + i, f"some words {w} zorblatt writes from joe@mail.example.com about {w} things") for i, w in enumerate(["alpha", "gamma", "delta"])]
    rows += [(600 + i, "a copied page of quuxword at ann@mail.example.com") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    for i in range(3):
        text = rows[200 + i][1]
        assert f"term:{text.index('zorblatt')}:{text.index('zorblatt') + 8}" in got[500 + i].spans
        assert got[500 + i].spans.startswith(got[500 + i].base)
    assert all("term" not in got[i].spans for i in range(200))
    assert all("term" not in got[600 + i].spans for i in range(5))  # copies of one passage prove nothing
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zorblatt" not in clean[500] and "joe@" not in clean[500] and "[EMAIL]" in clean[500]
    assert clean[3] == rows[3][1]


# --- set join ---------------------------------------------------------------------------------------


def test_set_join_query(spark, sf, docs):
    sizes, components = brute.set_components(texts(docs).items())
    got = run("op3_set_join", spark, sf)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], components[i]) for i in sizes}


@pytest.mark.parametrize("light", [1, 12, 60])
def test_set_join_over_sizes(spark, light, monkeypatch):
    """Mutated copies of short and long texts in chains, whatever the boundary between light and heavy sets."""
    monkeypatch.setattr(setjoin, "boundary", lambda mean: light)
    pick, rows = random.Random(light), []
    for base in range(25):
        text = [f"v{pick.randrange(40)}" for _ in range(pick.choice([3, 6, 9, 14, 30, 80]))]
        for _ in range(8):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(max(1, len(text) // 30)):
                text[pick.randrange(len(text))] = f"v{pick.randrange(40)}"
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes, components = brute.set_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.link(df).collect()}
    assert got == {i: (sizes[i], components[i]) for i in sizes}


def test_open_pairs_after_few_hubs(spark, monkeypatch):
    """With one hub a list, links that no hub shows are found by the second step."""
    monkeypatch.setattr(setjoin, "HUBS", 1)
    pick, rows = random.Random(9), []
    base = [f"w{i}" for i in range(60)]
    for i in range(60):
        text = list(base)
        for _ in range(pick.choice([1, 2, 3])):
            text[pick.randrange(60)] = f"x{i}_{pick.randrange(99)}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.component_id for r in setjoin.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.set_components(rows)[1]


def test_short_lists_are_not_opened(spark, monkeypatch):
    """Members of a short list all meet its hubs in the task that holds it; only longer lists are searched again, and only for keys of their pairs."""
    opened, plain = [], setjoin._opened

    def counted(lists, labels):
        opened.append(lists.count())
        return plain(lists, labels)

    monkeypatch.setattr(setjoin, "_opened", counted)
    pick, rows = random.Random(4), []
    for base in range(30):
        text = [f"w{base}_{i}" for i in range(40)]
        for _ in range(3):
            rows.append((len(rows), " ".join(text)))
            text[pick.randrange(40)] = f"x{len(rows)}"
    got = {r.doc_id: r.component_id for r in setjoin.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.set_components(rows)[1]
    assert opened[0] == 0


@pytest.mark.parametrize("hubs", [1, 3])
def test_hub_pairs_equal_a_plain_version(hubs):
    pick = random.Random(hubs)
    rows = np.array(sorted((pick.randrange(60), pick.randrange(500), pick.choice([1, 4, 40, 50, 60, 90]), 0) for _ in range(400)), setjoin._POST)
    got, left = setjoin.hub_pairs(rows, hubs)
    kind = np.floor(np.log(rows["size"]) / (setjoin.CLASSES * 1.001)).astype(int)
    order = setjoin.mix(rows["doc"].view(np.uint64))
    want, is_hub = set(), np.zeros(len(rows), bool)
    for key, k in {(a, b) for a, b in zip(rows["key"].tolist(), kind.tolist())}:
        members = np.flatnonzero((rows["key"] == key) & (kind == k))
        is_hub[members[np.lexsort((rows["doc"][members], order[members]))[:hubs]]] = True
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            a, b = int(min(x["size"], y["size"])), int(max(x["size"], y["size"]))
            if x["key"] == y["key"] and x["doc"] != y["doc"] and is_hub[j] and abs(kind[i] - kind[j]) <= 1 and 4 * a >= 3 * b and 7 * (1 + a) >= 3 * (a + b):
                want.add((int(min(x["doc"], y["doc"])), int(max(x["doc"], y["doc"]))))
    assert {tuple(p) for p in got.tolist()} == want and len(got) == len(want)
    assert left.tolist() == [int((~is_hub[rows["key"] == x["key"]]).sum()) > 1 for x in rows]


def test_levels_hold_little_beside_the_counters():
    """The driver's memory for the levels is bounded by a few times that of the counters, with the levels of the plain formula."""
    cells = np.random.default_rng(5).poisson(30, setjoin.CELLS).astype(np.uint32)
    cells[::1000] = 5_000
    cells[7] = 300_000
    tracemalloc.start()
    level, hot, mean = setjoin.leveled(cells)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    noise = float(np.median(cells))
    over = np.maximum(cells - noise, 0.0)
    bar = 4 * max(1.0, noise**0.5)
    assert np.array_equal(level, np.floor(np.where(over > bar, 1 + np.log2(np.maximum(over / bar, 1.0)), 0.0)).astype(np.uint8))
    assert np.flatnonzero(hot).tolist() == [7] and mean == pytest.approx((over**2).sum() / cells.sum())
    assert most < 40 << 20


# --- tokens -----------------------------------------------------------------------------------------


def noisy(pick, most):
    return "".join(pick.choice("ab th e in  ▁\nén日本\x01x\U0001f389") if pick.random() < 0.7 else pick.choice(["the", "aaaa", "    ", "ing", "<s>"]) for _ in range(pick.randint(0, most)))


def test_resynchronised_counts_equal_the_library(model):
    pick = random.Random(2)
    for text in [*(noisy(pick, 400) for _ in range(400)), "a" * 5000, "ab" * 4000, " " * 3000, "日" * 2000, "=-" * 3000]:
        if text:
            assert tokencount.resynchronised(model, text, 60, 5).tolist() == model.ids([text])[0]


def test_token_count_query(spark, sf, docs, model):
    body = texts(docs)
    for r in run("op5_token_counts", spark, sf):
        n = len(model.ids([body[r.doc_id] or ""])[0])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((body[r.doc_id] or "").encode()), n, n > 4096)


def test_viterbi_equals_the_library_and_decodes(model):
    pick, pieces = random.Random(3), piece.Pieces(MODEL)
    body = [noisy(pick, 120) for _ in range(400)]
    ids = pieces.encode(body)
    assert ids == model.ids(body)
    assert [pieces.decode(i) for i in ids] == [t.replace("▁", " ") for t in body]
    some = ["there", "hello", "wörld", "xxxxx"]
    assert pieces.search([piece.MARK + w for w in some]) == [pieces.search_one(piece.MARK + w) for w in some]


def test_pieces_spend_little_on_plain_ids_and_merges(model):
    """Only bytes are spelled out one by one, and a merge looks up the pairs beside it, not all pairs anew."""
    pieces = piece.Pieces(MODEL)
    strange = [piece.MARK + w for w in ("plain", "other", "w\u0378rld", "x\u0378\u0379yz", "third")]
    asked, spell = [], pieces._bytes
    pieces._bytes = lambda word, path: asked.append(word) or spell(word, path)
    ids, count = pieces.paths(strange)
    assert asked == strange[2:4]
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == model.ids([w[1:] for w in strange])

    class Counted(dict):
        looked = 0

        def get(self, *args):
            Counted.looked += 1
            return super().get(*args)

    word = piece.MARK + "internationalisation"
    plain = pieces.merged(word)
    pieces.id_of = Counted(pieces.id_of)
    assert pieces.merged(word) == plain and Counted.looked <= 3 * len(word)


def test_viterbi_query(spark, sf):
    assert all(r.round_trip for r in run("op6_piece_viterbi", spark, sf))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    for ids in (rng.integers(0, 50, 20_000), np.tile(rng.integers(0, 50_257, 40), 500), np.zeros(5000, int), rng.integers(0, 50_257, 1), np.zeros(0, int)):
        symbols, rules, sizes = tokenfile.compress(ids.astype("<u2"), 50_257)
        assert tokenfile.expand(symbols, rules, 50_257).tolist() == ids.tolist()
        assert tokenfile.expand(symbols, rules, 50_257, sizes).tolist() == ids.tolist()
        assert sum(sizes[s - 50_257] if s >= 50_257 else 1 for s in symbols.tolist()) == len(ids)
        for start in range(0, len(ids), max(1, len(ids) // 7)):
            assert tokenfile.slice_ids(symbols, rules, sizes, 50_257, start, 33).tolist() == ids[start : start + 33].tolist()
    assert len(tokenfile.compress(np.tile(rng.integers(0, 50_257, 40), 500).astype("<u2"), 50_257)[0]) < 3000


def test_pieces_of_text_encode_like_the_whole():
    encoder, pick = tokenfile.Encoder(BYTES), random.Random(6)
    body = ["".join(pick.choice(["a", "The", " ", "'s", "\n", "  ", "\t", "é", "日", "12", "!?", "<|", "\x1f", "\x85"]) for _ in range(pick.randint(0, 25))) for _ in range(3000)]
    assert encoder.encode(body) == encoder.library(body)


def test_pieces_over_slices_and_full_tables(monkeypatch):
    """Texts longer than a slice, words longer than one, and a table that is emptied on the way change no ids."""
    pick = random.Random(8)
    monkeypatch.setattr(tokenfile, "SLICE", 64)
    monkeypatch.setattr(tokenfile, "HELD", 50)
    encoder = tokenfile.Encoder(BYTES)
    word = lambda: "".join(pick.choice("abé日x1\n") for _ in range(pick.choice([1, 3, 8, 8, 90])))
    body = [" ".join(word() for _ in range(pick.choice([0, 1, 5, 60]))) for _ in range(300)] + ["", " a", "b" * 64, "c" * 65]
    assert encoder.encode(body) == encoder.library(body)
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_token_file_query(spark, sf, docs):
    encoder, start = tokenfile.Encoder(BYTES), 0
    got = {r.doc_id: r for r in run("op7_token_files", spark, sf)}
    for i, text in sorted(texts(docs).items()):
        ids = np.append(np.frombuffer(encoder.library([text or ""])[0], "<u2"), 0).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# --- mixing, toxicity, shards --------------------------------------------------------------------------


def plain_targets(sizes, weights=(5.0, 2.0, 1.0)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in order if x not in full) for s in order if s not in full}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_mixing_query(spark, sf, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(brute.words(r.text))
    want, got = plain_targets(sizes), {r.doc_id: r for r in run("op8_source_mixing", spark, sf)}
    taken = Counter()
    for r in rows:
        g = got[r.doc_id]
        assert (g.size, g.source_size) == (len(brute.words(r.text)), sizes[r.source])
        assert g.target == pytest.approx(want[r.source]) and g.taken <= 3 * g.size and (g.size == 0 or g.taken % g.size == 0)
        taken[r.source] += g.taken
    largest = max(len(brute.words(r.text)) for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)
    assert got == {r.doc_id: r for r in run("op8_source_mixing", spark, sf)}


def test_targets_water_level(spark):
    pick = random.Random(1)
    for _ in range(4):
        sizes = {s: pick.choice([0, 1, 5, 100, 3000]) for s in ["a", "b", "c", "d", "é", None][: pick.randint(2, 6)]}
        if sum(sizes.values()) == 0:
            continue
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_split_keeps_quotas_and_fills_shards_evenly():
    quotas = np.array([7, 0, 1000, 33])
    dealt = mixing.split(quotas, 12, seed=3)
    assert (dealt.sum(axis=0) == quotas).all() and np.ptp(dealt.sum(axis=1)) <= 4
    assert (dealt == mixing.split(quotas, 12, seed=3)).all()


def test_mix_copies(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len({(r.doc_id, r["__copy"]) for r in rows}) == len(rows) and {r["__shard"] for r in rows} <= set(range(16))


def test_toxicity_on_held_out_rows(spark):
    from sessionrank.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = Counter((truth[r.doc_id], r.predicted) for r in rows)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.85 and right[0, 1] / (right[0, 0] + right[0, 1]) < 0.02


def test_sharding_query(spark, sf, docs):
    body = texts(docs)
    rows = run("op10_rendezvous_shards", spark, sf)
    slots = {}
    for r in rows:
        data = (body[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key") and 0 <= r.shard < 16
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_pieces_of_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 100)
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.assign(df, [1.0, 3.0]).collect()
    assert 0.72 < sum(r.shard == 1 for r in rows) / 8000 < 0.78
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


# --- odd rows --------------------------------------------------------------------------------------------

LABELS = [(i, i % 2) for i in range(1, 15)] + [(None, 1), (3, None)]


def every(spark, df):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, toxic int")
    return {
        "pii": pii.spans(df),
        "sanitise": pii.sanitise(df),
        "join": setjoin.link(df),
        "first": setjoin.first_of_groups(df),
        "count": tokencount.counts(df, MODEL),
        "pieces": piece.decode(piece.encode(df, MODEL), MODEL),
        "files": tokenfile.read(spark, tokenfile.write(df, BYTES, block_ids=500)),
        "mix": mixing.planned(df),
        "toxicity": toxicity.scores(df, toxicity.fit(df, labels)),
        "clean": toxicity.keep_clean(df, toxicity.fit(df, labels)),
        "shards": sharding.assign(df, [1.0] * 3, [1.0] * 4),
    }


def test_odd_rows(spark, odd, model):
    got = {k: v.collect() for k, v in every(spark, odd).items()}
    for k in ("pii", "join", "count", "pieces", "files", "mix", "toxicity", "shards", "sanitise"):
        assert len(got[k]) == odd.count(), k
    body = odd.collect()
    assert sorted((r.doc_id or 0, r.base) for r in got["pii"]) == sorted((r.doc_id or 0, ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(r.text))) for r in body)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got["count"]) == sorted((r.doc_id or 0, len(model.ids([r.text or ""])[0])) for r in body)
    assert all(r.decoded == (r.text.replace("▁", " ") if r.text is not None else None) for r in got["pieces"])
    component = {r.doc_id: (r.n_shingles, r.component_id) for r in got["join"]}
    assert component[2][1] == 1 and component[7] == (2, 6) and component[None] == (2, None) and component[13][1] == 12 and component[14][1] == 14
    assert [component[i] for i in (3, 4, 5)] == [(0, 3), (0, 4), (0, 5)] and component[8] == (1, 8)
    kept = sorted(r.doc_id or 0 for r in got["first"])
    assert kept == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11, 12, 14]
    start = sorted((r.start, r.n_tokens) for r in got["files"])
    assert start[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(start, start[1:]))
    assert got["first"][0].__fields__ == odd.columns and got["clean"][0].__fields__ == odd.columns and got["sanitise"][0].__fields__ == odd.columns
    assert {r.key for r in got["sanitise"]} == {"clash"}


def test_no_rows(spark, none):
    for k, v in every(spark, none).items():
        assert v.count() == 0, k
