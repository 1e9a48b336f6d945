"""Secret scan with multipart credential linking. DataFrame operations only.

Strong findings stand by themselves. Weak parts (identifiers, tokens that look random, endpoints) are reported only
where complementary parts co-occur: an interval join over buckets of the text finds, for each weak part, a secret near
an identifier or endpoint, or the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .spans import keyed, labelled, listed, located

# Fixed patterns. Possessive repeats and the look-behinds keep the search linear and change no match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
USER = r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,}+)"""
RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"""(?i:\b(?:https?|ftp|ssh|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]{4,}+)"""
#: Code points on either side of a weak part that are its scope.
SCOPE = 200
#: Different characters that a token needs to look random.
VARIETY = 12


def _random_looking(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= VARIETY)


def _parts(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    assign = F.filter(located(text, ASSIGN, F.contains(F.lower(text), F.lit("pass")) | F.contains(F.lower(text), F.lit("secret")) | F.contains(F.lower(text), F.lit("token")) | F.contains(F.lower(text), F.lit("api")), 2), lambda x: F.length(x["value"]) >= 8)
    access = located(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = located(text, HEX)
    user = located(text, USER, F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), 1)
    random = F.filter(located(text, RANDOM), lambda x: _random_looking(x["value"]))
    endpoint = located(text, ENDPOINT, F.contains(text, F.lit("://")))
    base = F.concat(labelled(0, "assign", assign), labelled(1, "access", access), labelled(2, "hex", hexes))
    weak = F.concat(labelled(3, "user", user), labelled(4, "random", random), labelled(5, "endpoint", endpoint))
    bare = lambda spans: F.transform(spans, lambda x: x.dropFields("value"))
    return rows.select("id", "did", "th", F.array_sort(bare(base)).alias("base"), F.array_sort(bare(weak)).alias("weak"))


def _linked(parts: DataFrame) -> DataFrame:
    """(did, th, links): weak parts outside base findings with a complementary part in scope."""
    role = F.when(F.col("x.kind").isin(0, 2, 4), "secret").otherwise("other")
    so_far = Window.partitionBy("did", "th").orderBy("x.start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.coalesce(F.max(F.when(F.col("x.kind") < 3, F.col("x.end"))).over(so_far), F.lit(-1))
    rows = (
        parts.filter(F.size("weak") > 0).dropDuplicates(["did", "th"])
        .select("did", "th", F.explode(F.concat("base", "weak")).alias("x"))
        .select("did", "th", "x", role.alias("role"), ((F.col("x.kind") >= 3) & (F.col("x.end") > reach)).alias("asks"))
    )
    low, high = F.col("x.start") - SCOPE, F.col("x.end") + SCOPE
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE))).alias("bucket")
    asking = rows.filter("asks").select("did", "th", F.col("x").alias("w"), F.col("role").alias("w_role"), low.alias("low"), high.alias("high"), buckets(low, high))
    giving = rows.select("did", "th", F.col("x.start").alias("at"), F.col("x.end").alias("to"), "role", buckets(F.col("x.start"), F.col("x.end")))
    near = asking.join(giving, ["did", "th", "bucket"]).filter("w_role <> role and to > low and at < high and (to <= w.start or at >= w.end)")
    return near.groupBy("did", "th").agg(F.array_sort(F.collect_set("w")).alias("links"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, links, spans): base findings, linked weak parts, and both together, each an array of
    struct<start,kind,end,name> in code points, sorted by start and kind.

    Parts are complementary if one is a secret and the other an identifier or endpoint, and in scope if the intervals
    between them overlap, from whichever side one looks. Weak parts inside a base finding are part of it and not
    reported again. Null texts are empty; a null id keeps its row; equal rows get equal findings; rows of one id with
    different texts are told apart; an empty table gives no rows. Fan-out of the interval join is bounded by the parts
    that fit in a bucket of text, whatever the length of the text.
    """
    parts = cut(_parts(keyed(docs, id_col, text_col)))
    found = parts.join(_linked(parts), ["did", "th"], "left").withColumn("links", F.coalesce("links", F.expr("filter(weak, x -> false)")))
    return found.select("id", "base", "links", F.array_sort(F.concat("base", "links")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The scan's findings as counts, a SHA-256 of the base spans and a list of all spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
