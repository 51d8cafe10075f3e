"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from sessionrank.llm import common, decontam, fim, merkle, mixing, neardup, neighbours, pii, setjoin, sharding, tokencount, tokenfile, toxicity
from sessionrank.llm import piece as pieces

QUERIES = {}
SQL: dict[str, str] = {}

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


@cache
def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    def run(spark, sf_dir):
        return fn(common.tuned(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii_disclosure(spark, sf_dir):
    found = pii.spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


@query
def op2_multiprobe_neighbours(spark, sf_dir):
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


@query
def op3_set_join(spark, sf_dir):
    return setjoin.link(_table(spark, sf_dir, "documents"))


@query
def op4_collision_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query
def op5_token_counts(spark, sf_dir):
    return tokencount.counts(_table(spark, sf_dir, "documents"), tokenizer(PIECES))


@query
def op6_piece_viterbi(spark, sf_dir):
    """Ids of every text, and whether decoding gives the text back."""
    path = tokenizer(PIECES)
    ids = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path)
    both = pieces.decode(ids, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.crc32(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")).alias("ids_crc32"),
        (F.col("decoded") == F.translate("text", "▁", " ")).alias("round_trip"),
    )


@query
def op7_token_files(spark, sf_dir):
    return tokenfile.read(spark, tokenfile.write(_table(spark, sf_dir, "documents"), tokenizer(BYTES)))


@query
def op8_source_mixing(spark, sf_dir):
    rows = mixing.planned(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select(
        F.col("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.size("__draws")).cast("bigint").alias("taken"),
    )


@query
def op9_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@query
def op10_rendezvous_shards(spark, sf_dir):
    placed = sharding.assign(_table(spark, sf_dir, "documents"), [1.0] * 16, grown=[1.0] * 17)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op11_fill_in_middle(spark, sf_dir):
    made = fim.transform(_table(spark, sf_dir, "documents"), rate=100, spm=50, seed=7)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


SQL["op11_fill_in_middle"] = r"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
    list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), k, 8))::bigint) as h
  from documents
), cut as (
  select doc_id, text, u, len(u)::bigint as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 100 then 'plain'
      when h[4] % 100 < 50 then 'spm' else 'psm' end as form
  from units
), parts as (
  select doc_id, text, n, form, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cut
)
select doc_id, n, form,
  case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


@query
def op12_merkle_manifest(spark, sf_dir):
    """Leaves, roots and proofs, and whether the root shows that the line breaks of some rows were lost."""
    docs = _table(spark, sf_dir, "documents")
    of = merkle.columns_of(docs)
    altered = F.crc32(of["doc_id"].cast("string").cast("binary")) % 2 == 0
    tampered = F.when(altered, merkle.leaf(*[F.replace(c, F.lit("\n"), F.lit("")) if name == "text" else c for name, c in of.items()]))
    made = merkle.manifest(docs, {"tampered": tampered})
    made = made.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL["op12_merkle_manifest"] = r"""
with recursive framed as (
  select row_number() over (order by source nulls first, doc_id nulls first, lang, n_chars, text) as r, doc_id, source, text,
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, b:
      list_reduce(range(8), lambda d, i: xor(d >> 1, (d & 1) * 3988292384), xor(a, b)), 4294967295::bigint), 4294967295::bigint) % 2 = 0 as even,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head
  from documents
), leaf as (
  select r, doc_id, source, even, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) as bare
  from framed
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as slot, count(*) over (partition by source) as n from leaf
), tree as (
  select 0 as lvl, source, slot, leaf as h, n from placed
  union all
  select lvl + 1, source, slot // 3, sha256(string_agg(h, '' order by slot)), (any_value(n) + 2) // 3 from tree where n > 1 group by lvl, source, slot // 3
), sub as (
  select source, h as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from tree where n = 1
), top as (
  select 0 as lvl, place as slot, subroot as h, n from sub
  union all
  select lvl + 1, slot // 3, sha256(string_agg(h, '' order by slot)), (any_value(n) + 2) // 3 from top where n > 1 group by lvl, slot // 3
), way as (
  select r, 0 as part, lvl, placed.source, (slot // (3 ** lvl)::bigint) as node from placed, (select distinct lvl from tree where n > 1)
), steps as (
  select r, part, way.lvl as lvl, coalesce(string_agg(h, '' order by slot) filter (slot < node), '') as before, coalesce(string_agg(h, '' order by slot) filter (slot > node), '') as after
  from way join tree on tree.lvl = way.lvl and tree.source is not distinct from way.source and tree.slot // 3 = node // 3 and tree.n > 1
  group by r, part, way.lvl
  union all
  select r, 1, top.lvl, coalesce(string_agg(top.h, '' order by top.slot) filter (top.slot < place // (3 ** top.lvl)::bigint), ''),
    coalesce(string_agg(top.h, '' order by top.slot) filter (top.slot > place // (3 ** top.lvl)::bigint), '')
  from placed join sub on sub.source is not distinct from placed.source join top on top.n > 1 and top.slot // 3 = place // (3 ** (top.lvl + 1))::bigint
  group by r, top.lvl
), path as (
  select *, row_number() over (partition by r order by part, lvl) as k from steps
), fold as (
  select r, 0 as k, case when even then bare else leaf end as h from leaf
  union all
  select fold.r, fold.k + 1, sha256(before || h || after) from fold join path on path.r = fold.r and path.k = fold.k + 1
), folded as (
  select r, arg_max(h, k) as folded_root from fold group by r
), proofs as (
  select r, sha256(string_agg(before || after, '' order by k)) as proof_sha256 from path group by r
)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from placed join sub on sub.source is not distinct from placed.source join (select h as root from top where n = 1) on true
  join folded using (r) left join proofs using (r)
"""


@query
def op13_decontamination(spark, sf_dir):
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL["op13_decontamination"] = r"""
with item as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), win as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)
), doc as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), place as (
  select r, k, i, array_to_string(w[i:i + k - 1], ' ') as win
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from doc, (select distinct k from win) where len(w) >= k)
), occ as (
  select r, i, place.k as k, item_id from place join win on place.win = win.win and place.k = win.k
), hits as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from occ) group by r
), items as (
  select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct r, item_id from occ where item_id is not null) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hits using (r) left join items using (r)
"""
