"""Information-theoretic sanitisation of personal data.

Base spans (mail and network addresses, card and telephone numbers) are found by pattern in
linear time. Every value found is a protected entity. Terms that stand within a window of an
entity are candidates; how strongly a term reveals the entity is their pointwise mutual
information over the whole corpus, as a share of the entity's information content. Terms
above the upper threshold are removed, those between the two thresholds generalised.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.llm.common import BROADCAST_ROWS, arrow_rows, fixed_columns, small_or_shuffled, stored, texts

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8  # words on each side of an entity
REACH = 240  # code points on each side that a window may span at most
REMOVE = 0.8  # share of an entity's information that a term may not reveal
GENERALISE = 0.5
HELD_TERMS = 200_000  # distinct terms a counting task holds before it hands them on

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{4,}")


def _emails(text: str):
    """Walks from one @ to the next, so a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = _HOST.match(text, at + 1) if start < at else None
        if end:
            done = end.end()
            yield start, done
            at = text.find("@", done)
        else:
            # the next match cannot begin before the sign that failed
            done, at = at + 1, text.find("@", at + 1)


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost, not overlapping within a kind."""
    spans = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_part_fits, m[0].split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def entity_of(kind: str, value: str) -> str:
    """A digest of the value in its normal form; the value itself is not carried along."""
    normal = value.lower() if kind == "email" else ".".join(p.lstrip("0") or "0" for p in value.split(".")) if kind == "ip" else _NOT_DIGIT.sub("", value)
    return hashlib.blake2b(f"{kind}:{normal}".encode(), digest_size=16).hexdigest()


def contexts(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> list[dict]:
    """One item per (entity, term) of the text: the term's places near the entity, and a digest of the window's words."""
    taken = sorted((a, b) for _, a, b in spans)
    found: dict[tuple[str, str], dict] = {}
    for kind, a, b in spans:
        entity = entity_of(kind, text[a:b])
        left = [m.span() for m in _TERM.finditer(text, max(0, a - REACH), a) if m.start() != a - REACH][-window:]
        right = [m.span() for m in _TERM.finditer(text, b, min(len(text), b + REACH)) if m.end() != b + REACH][:window]
        near = [(x, y) for x, y in left + right if not any(x < q and p < y for p, q in taken if p < y)]
        words = [text[x:y].lower() for x, y in near]
        digest = hashlib.blake2b(" ".join(words).encode(), digest_size=8).hexdigest()
        found.setdefault((entity, ""), {"entity": entity, "term": "", "window": digest, "places": []})
        for (x, y), term in zip(near, words):
            item = found.setdefault((entity, term), {"entity": entity, "term": term, "window": digest, "places": []})
            item["places"].append({"start": x, "end": y})
    return list(found.values())


_CONTEXT = "array<struct<entity:string,term:string,window:string,places:array<struct<start:int,end:int>>>>"
_FOUND = f"doc_id bigint, tkey string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, contexts {_CONTEXT}"
_PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FOUND_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("tkey", pa.string())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base", pa.string()), ("contexts", pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("window", pa.string()), ("places", pa.list_(_PLACE))])))]
)


def find(docs: DataFrame) -> DataFrame:
    """Base spans and entity contexts of every row; one pass over the texts."""

    def scan(parts):
        for part in parts:
            body = texts(part.column("text"))
            spans = [base_spans(t) for t in body]
            counts = [Counter(k for k, _, _ in s) for s in spans]
            yield arrow_rows(_FOUND_ARROW, [
                part.column("doc_id"),
                [hashlib.md5(t.encode()).hexdigest() for t in body],
                *[[c[k] for c in counts] for k in KINDS],
                [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in spans],
                [contexts(t, s) if s else [] for t, s in zip(body, spans)],
            ])

    return fixed_columns(docs, "doc_id", "text").mapInArrow(scan, _FOUND)


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_term): in how many rows each wanted term stands, over the whole corpus.

    A short list of terms (checked) travels to the scan; beyond that every term is counted and joined.
    """
    spark = docs.sparkSession
    few = wanted.count() <= BROADCAST_ROWS // 5
    only = spark.sparkContext.broadcast(frozenset(r.term for r in wanted.collect()) if few else None)

    def count(parts):
        kept, held = only.value, Counter()

        def rows():
            return pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values())}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

        for part in parts:
            for text in texts(part.column("text")):
                words = {w.lower() for w in set(_TERM.findall(text))}
                held.update(words if kept is None else words & kept)
            if len(held) > HELD_TERMS:
                yield rows()
                held = Counter()
        yield rows()

    counted = fixed_columns(docs, "text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted if few else counted.join(wanted, "term", "left_semi")


def disclosures(docs: DataFrame, found: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, share, action) of the terms that reveal an entity too strongly.

    share = PMI(term; entity) / IC(entity), from row counts: 1 if the term stands only beside
    the entity. Two different windows must show the pair, so that copies of one passage prove
    nothing. An entity in every row has no information to reveal.
    """
    rows = found.select(F.explode("contexts").alias("c")).select("c.entity", "c.term", "c.window")
    pairs = rows.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"), F.min("window").alias("w0"), F.max("window").alias("w1"))
    pairs = stored(pairs, "pii_pairs")
    entities = pairs.where("term = ''").select("entity", F.col("n_pair").alias("n_entity"))
    shown = pairs.where("term <> '' and w0 <> w1").select("entity", "term", "n_pair")
    counts = term_counts(docs, shown.select("term").distinct())
    n = found.count()
    ic = F.log2(F.lit(float(n)) / F.col("n_entity"))
    pmi = F.log2(F.lit(float(n)) * F.col("n_pair") / (F.col("n_term") * F.col("n_entity")))
    scored = shown.join(entities, "entity").join(counts, "term").withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0))
    action = F.when(F.col("share") >= remove, "removed").otherwise("generalised")
    return scored.where(F.col("share") >= min(remove, generalise)).select("entity", "term", "share", action.alias("action"))


def added_spans(found: DataFrame, revealing: DataFrame) -> DataFrame:
    """(tkey, added): per text with revealing terms, their distinct places in order, and what becomes of them."""
    places = (
        found.where(F.size("contexts") > 0)
        .select("tkey", F.explode("contexts").alias("c"))
        .select("tkey", "c.entity", "c.term", "c.places")
        .join(revealing.select("entity", "term", "action"), ["entity", "term"])
        .select("tkey", "action", F.explode("places").alias("p"))
        .groupBy("tkey", "p.start", "p.end")
        .agg(F.max("action").alias("action"))  # removed outweighs generalised
    )
    return places.groupBy("tkey").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("added"))


def spans(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of base spans, ``base`` and ``spans`` as kind:start:end lists.

    Places are code points, ends exclusive. Null or empty text: no spans. Repeated rows and null
    ids give a row each; equal texts get equal spans. Other columns are not read. No rows: no rows.
    """
    found = stored(find(docs), "pii_found")
    added = added_spans(found, disclosures(docs, found, remove, generalise))
    extra = F.array_join(F.transform("added", lambda s: F.concat(F.lit("term:"), s["start"], F.lit(":"), s["end"])), ",")
    out = found.select("doc_id", "tkey", *[f"n_{k}" for k in KINDS], "base").join(small_or_shuffled(stored(added, "pii_added")), "tkey", "left")
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("added") > 0, extra)).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("bigint").alias("n_term"),
    )


def clean(text: str, added: list) -> str:
    """The text with base spans as [KIND], generalised terms as [TERM] and removed terms gone; nested spans go with the outer."""
    marks = [(a, -b, f"[{k.upper()}]") for k, a, b in base_spans(text)] + [(s["start"], -s["end"], "[TERM]" if s["action"] == "generalised" else "") for s in added or []]
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """``docs`` with every text sanitised; all other columns, rows, repeats and nulls as they were."""
    found = stored(find(docs), "pii_found")
    added = stored(added_spans(found, disclosures(docs, found, remove, generalise)), "pii_added")
    key, extra = "__pii_key", "__pii_added"
    rows = docs.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    joined = rows.join(small_or_shuffled(added.select(F.col("tkey").alias(key), F.col("added").alias(extra))), key, "left")

    @F.pandas_udf("string")
    def cleaned(text, places):
        import pandas as pd

        return pd.Series([None if t is None else clean(t, None if p is None else list(p)) for t, p in zip(text, places)])

    done = cleaned(F.col("text"), F.col(extra))
    return joined.select(*[done.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
