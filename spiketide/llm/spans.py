"""Spans of patterns in texts with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,value:string>"
NEAR = "struct<start:bigint,end:bigint,value:string,before:string,after:string>"
#: Matches before a match whose text is looked at for its context; each is at least five code points long.
LOOK_BACK = 5


def running(values: Column, combine: Callable[[Column, Column], Column], none: Column) -> Column:
    """Each element combined with all before it. Distances 1, 2, 4, ... are combined in turn, so an array of n costs
    n log n steps; `none` changes nothing it is combined with."""
    apart = F.array(*[F.lit(1 << k) for k in range(31)])
    size = F.size(values)
    shifted = lambda acc, by: F.slice(F.concat(F.array_repeat(none, by), acc), 1, F.size(acc))
    return F.aggregate(F.filter(apart, lambda by: by < size), values, lambda acc, by: F.zip_with(shifted(acc, by), acc, combine))


def located(text: Column, pattern: str, hint: Column | None = None, value_group: int = 0, context: int = 0) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The text is split at the matches, so starts are running sums of the lengths of pieces and matches. hint: a cheap
    condition that every text with a match fulfils; it spares the others the search. value_group: of what `value` is.
    context: with it, spans carry so many code points `before` them and two `after` them; matches then have to be of
    five code points and more. The work grows with the text and with matches times the logarithm of their number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.array(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"), values.alias("values")))

    def placed(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        tails = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda gap, m: F.right(F.concat(gap, m), F.lit(context))) if context else F.array()
        inner = F.array(F.struct(x["found"].alias("found"), x["gaps"].alias("gaps"), x["values"].alias("values"), sizes.alias("sizes"), tails.alias("tails")))
        return F.get(F.transform(inner, spans), F.lit(0))

    def spans(x: Column) -> Column:
        def span(end: Column, i: Column) -> Column:
            fields = [(end - F.length(F.get(x["found"], i))).alias("start"), end.alias("end"), F.get(x["values"], i).alias("value")]
            if context:
                back = [F.when(i >= k, F.get(x["tails"], i - k)).otherwise("") for k in range(LOOK_BACK, 0, -1)]
                fields.append(F.right(F.concat(*back, F.get(x["gaps"], i)), F.lit(context)).alias("before"))
                fields.append(F.left(F.concat(F.get(x["gaps"], i + 1), F.coalesce(F.get(x["found"], i + 1), F.lit(""))), F.lit(2)).alias("after"))
            return F.struct(*fields)

        return F.transform(running(x["sizes"], lambda a, b: a + b, F.lit(0).cast("long")), span)

    kind = f"array<{NEAR if context else SPAN}>"
    seen = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    return F.when(seen, F.get(F.transform(parts, placed), F.lit(0)).cast(kind)).otherwise(F.array().cast(kind))


def labelled(kind: int, name: str, spans: Column, *more: str) -> Column:
    """array<struct<start,kind,end,name,value>>: sorts by start, then kind. more: further fields to keep."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.lit(name).alias("name"), x["value"].alias("value"), *[x[m].alias(m) for m in more]))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order they stand."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, did, th, text): null texts are empty; a row is known by id and text, equal rows by the same."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
