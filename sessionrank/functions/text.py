"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing search term.
EMPTY_TERMS = ["nan", "none", "null", ""]

# Brand and colour words looked for in search terms.
BRAND_WORDS = "nike|adidas|zara|h&m|mango"
COLOUR_WORDS = "siyah|beyaz|kirmizi|mavi|yesil|sari"


def normalize_term(term: Column) -> Column:
    """Lower case without outer blanks; stand-ins for a missing term become the empty string."""
    clean = F.lower(F.trim(term))
    return F.when(clean.isNull() | clean.isin(EMPTY_TERMS), "").otherwise(clean)


def product_text(*parts: Column, fallback: Column) -> Column:
    """The non-null parts joined by blanks; the fallback when there is no part."""
    text = F.concat_ws(" ", *parts)
    return F.when(text == "", fallback.cast("string")).otherwise(text)


def term_shape(term: Column) -> dict[str, Column]:
    return {
        "term_length": F.char_length(term).cast("bigint"),
        "term_underscores": F.regexp_count(term, F.lit("_")).cast("bigint"),
    }


def contains_word(term: Column, words: str) -> Column:
    return term.rlike(words)


def tokens(text: Column) -> Column:
    """Tokens between runs of white space; none for blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def tokens_by_blank(text: Column) -> Column:
    """Tokens between single blanks; blank text is one empty token."""
    return F.split(F.coalesce(text, F.lit("")), " ")


def key_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("UNKNOWN"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens, 0 when both are without tokens."""
    union = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(union > 0, shared.cast("double") / union).otherwise(0.0)


def any_shared(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b).cast("bigint")
