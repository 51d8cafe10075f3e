"""Fill-in-middle transformation by counted-quantifier patterns.

A text is a run of units (lines, by default). ``regexp_count`` gives their number n, two hashed
numbers give the cuts, and a pattern made for the row, ``\\A(unit{a})(unit{b-a})(rest)\\z`` with
possessive repeats, captures prefix, middle and suffix in one match, which is written in the new
order at once. A possessive repeat keeps no way back, so the stack stays flat and the time linear
however many units there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Marks:
    """The strings before prefix, suffix and middle. A text that holds one of them stays plain, so that the way back is sure."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        # a mark that begins as it ends could be found a few characters early, across the end of a part
        if len(set(marks)) < 3 or any(not m or "$" in m or "\\" in m for m in marks):
            raise ValueError("marks must be three different strings without $ and \\")
        if any(a[:k] == b[-k:] or (a != b and a in b) for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("no mark may begin as it or another one ends, or lie inside another one")


def draws(ident: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, unit: str = LINES, rate: int = 100, spm: int = 50, seed: int = 7, marks: Marks = Marks()) -> DataFrame:
    """doc_id, n, form, output, prefix_chars and middle_chars of every row of ``docs``.

    ``unit`` is a Java pattern whose repeats must cover a text from left to right. Of a hundred
    rows, about ``rate`` are changed, about ``spm`` in a hundred of these to suffix, prefix,
    middle, and the rest to prefix, suffix, middle. The draws come from seed and id alone.

    A null text counts as empty. Empty texts, and texts that hold a mark, are plain: output is
    the text, the lengths are null. Null ids draw as an empty id; repeated rows give a row each,
    equal ones; other columns are not read; no rows give no rows. A text is taken whole, and
    every part may be empty.
    """
    ident, text = F.col("`doc_id`").cast("bigint"), F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    rows = docs.select(ident.alias("doc_id"), text.alias("text"))
    rows = rows.select("*", F.regexp_count("text", F.lit(unit)).cast("bigint").alias("n"), *[d.alias(f"h{i}") for i, d in enumerate(draws(F.col("doc_id"), seed), 1)])
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    marked = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    repeat = f"((?:{unit.replace('%', '%%')}){{%d}}+)"
    pattern = F.format_string(f"(?s)\\A{repeat}{repeat}(.*)\\z", F.col("a"), F.col("b") - F.col("a"))
    order = {"psm": f"{marks.prefix}$1{marks.suffix}$3{marks.middle}$2", "spm": f"{marks.suffix}$3{marks.prefix}$1{marks.middle}$2"}
    new = F.when(F.col("form") == "plain", F.lit("")).when(F.col("form") == "spm", F.lit(order["spm"])).otherwise(F.lit(order["psm"]))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, new))
    rows = rows.select("doc_id", "n", "form", output.alias("output"))
    prefix, middle, _ = parts(F.col("output"), F.col("form"), marks)
    sized = [F.when(F.col("form") != "plain", F.char_length(p)).cast("bigint") for p in (prefix, middle)]
    return rows.select("*", sized[0].alias("prefix_chars"), sized[1].alias("middle_chars"))


def parts(output: Column, form: Column, marks: Marks = Marks()) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output in one of the two changed forms."""

    # each mark stands once; in front of the first one there is nothing
    pieces = F.split(output, "|".join(re.escape(m) for m in (marks.prefix, marks.suffix, marks.middle)), -1)
    first, second = F.get(pieces, F.lit(1)), F.get(pieces, F.lit(2))
    return F.when(form == "spm", second).otherwise(first), F.get(pieces, F.lit(3)), F.when(form == "spm", first).otherwise(second)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made from."""
    return F.when(form == "plain", output).otherwise(F.concat(*parts(output, form, marks)))
