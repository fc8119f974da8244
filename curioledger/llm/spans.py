"""Spans of regular-expression matches as column expressions: code points, end exclusive.

Java's possessive quantifiers (``++``) stand where a group repeats, so that a very long run costs no
stack, and a look-behind pins a match to the start of its run, so that it costs no second scan of
the run. Neither changes what matches.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string>>"


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches, as text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, pattern: str, hits: Column) -> Column:
    """The same matches as ``array<struct<start, end, hit>>``: what lies between them places them."""
    between = F.split(text, pattern, -1)
    none = F.array().cast(SPAN)
    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(hits)),
        hits,
        lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
    )
    found = F.aggregate(pairs, first, step, lambda done: done["spans"])
    return F.when(F.size(hits) > 0, found).otherwise(none)


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` comma-joined, in the order of the array; ``rank`` names the kind."""
    names = F.array(*map(F.lit, kinds))

    def written(span: Column) -> Column:
        return F.concat_ws(
            ":",
            F.element_at(names, span["rank"] + 1),
            span["start"].cast("string"),
            span["end"].cast("string"),
        )

    return F.array_join(F.transform(spans, written), ",")
