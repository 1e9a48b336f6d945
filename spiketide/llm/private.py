"""Personal data by candidate gradient boosting. DataFrame operations and pyspark.ml only.

High-recall generators propose spans of four kinds, overlaps included. Format and context features of a span go to
gradient-boosted trees, which are trained here on generated lines whose labels are known by construction, and are
scored as nested CASE expressions. A threshold for each kind is chosen on the half of those lines that no tree saw.
Spans that pass the checks of the base patterns stay whatever their score.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut
from .spans import keyed, labelled, listed, located

# Fixed patterns. Possessive repeats and the look-behinds keep the search linear and change no match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MASKED = r"(?i:[a-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[a-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]++)++)"
DIGITS = r"(?<![0-9A-Za-z.+])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"
KINDS = ("email", "ip", "card", "phone")
#: Code points of context before a span.
CONTEXT = 24
#: Code points of a block of text in which spans are replaced.
CHUNK = 4096
#: Lines generated: half for training, a quarter each for thresholds and for the report; trees and their depth; precision
#: asked of a threshold.
LINES, TREES, DEPTH, PRECISION = 12_000, 16, 5, 0.97
WORDS = ("phone|tel|call|mobile|fax|contact|number", "card|visa|mastercard|credit|account|pay", "order|invoice|id|ref|version|page|isbn|total|serial|build|tracking|measured")

_fitted: dict[str, tuple[Column, dict[str, float]]] = {}


def luhn_sum(digits: Column) -> Column:
    """The sum that the Luhn check takes of a string of digits."""
    chars = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    worth = F.transform(chars, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(worth, F.lit(0), lambda s, d: s + d)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return luhn_sum(digits) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> list[Column]:
    """The four base kinds, failing matches dropped, in the order of KINDS."""
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    count = lambda x: F.length(_digits(x["value"]))
    return [
        located(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(located(text, IP), lambda x: F.forall(F.split(x["value"], r"\."), small)),
        F.filter(located(text, CARD), lambda x: count(x).between(13, 19) & luhn(_digits(x["value"]))),
        F.filter(located(text, PHONE, F.contains(text, F.lit("+"))), lambda x: count(x).between(9, 15)),
    ]


def _candidates(text: Column) -> Column:
    """array<struct<start,kind,end,name,value,before,after>>: spans that may be personal data, with their context; base
    spans are among those kept anyway."""
    size = lambda x: F.length(_digits(x["value"]))
    masked = located(text, MASKED, F.contains(F.lower(text), F.lit("at)")) | F.contains(F.lower(text), F.lit("at]")), context=CONTEXT)

    def numbers(digits: Column) -> Column:
        return F.concat(
            labelled(2, "card", F.filter(digits, lambda x: size(x).between(13, 19)), "before", "after"),
            labelled(3, "phone", F.filter(digits, lambda x: size(x).between(7, 15)), "before", "after"),
        )

    found = F.get(F.transform(F.array(located(text, DIGITS, context=CONTEXT)), numbers), F.lit(0))
    return F.concat(labelled(0, "email", masked, "before", "after"), found)


def _features(x: Column) -> dict[str, Column]:
    """Format and context of a span (kind, value, before, after); no feature looks at which text it is."""
    value, digits = x["value"], _digits(x["value"])
    before, after = F.lower(x["before"]), x["after"]
    flag = lambda c: c.cast("double")
    found = {
        "kind": x["kind"].cast("double"), "digits": F.length(digits).cast("double"), "size": F.length(value).cast("double"),
        "others": (F.length(value) - F.length(digits)).cast("double"), "variety": F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        "luhn": flag(luhn(F.when(F.length(digits) > 0, digits).otherwise("1"))), "brackets": flag(value.rlike(r"^\([0-9]{3}\)")),
        "fours": flag(value.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$")), "threes": flag(value.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")),
        "solid": flag(~value.rlike("[^0-9]")), "zero": flag(value.rlike("^0")), "dots": (F.length(value) - F.length(F.replace(value, F.lit("."), F.lit("")))).cast("double"),
        "stuck": flag(after.rlike("^[A-Za-z0-9_%$€]")), "sign": flag(before.rlike(r"[#$€+=]\x20?$")), "year": flag(value.rlike(r"(?:^|[ .-])(?:19|20)[0-9]{2}(?:$|[ .-])")),
        "ending": flag(value.rlike(r"[a-zA-Z]{2,}$")), "pairs": flag(value.rlike(r"(?:^|[ .-])[0-9]{1,2}(?:$|[ .-])")), "gaps": F.size(F.split(value, "[^0-9]+")).cast("double"),
    }
    for k, words in enumerate(WORDS):
        found[f"word{k}"] = flag(before.rlike(rf"\b(?:{words})\b"))
    return found


#: What may stand before a number that is personal data, before one that is not, and before either; for generated lines.
HEADS = {
    "card": ("card", "visa card", "credit card no", "pay with", "charged to account", "mastercard"),
    "phone": ("call", "tel", "phone", "mobile", "fax", "contact me at", "my number is"),
    "other": ("order", "invoice", "ref", "tracking", "isbn", "serial", "total", "version", "page", "measured", "build"),
    "none": ("the", "with", "and", "see", "about", "then", "it was", "from"),
}


def _forms(number, h) -> list[tuple[int, Column, dict[str, int]]]:
    """(kind, value, label by head): a value is personal data after some heads and not after others."""
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pick = lambda salt, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (h(salt, len(options)) + 1).cast("int"))

    def valid(first: Column) -> Column:
        """The digits and the one that makes them pass the check."""
        return F.concat(first, ((10 - luhn_sum(F.concat(first, F.lit("0"))) % 10) % 10).cast("string"))

    def cut_up(digits: Column, sep: Column, *sizes: int) -> Column:
        at, parts = 1, []
        for n in sizes:
            parts += [sep, F.substring(digits, at, n)]
            at += n
        return F.concat(*parts[1:])

    sixteen, fifteen = valid(number(1, 15)), valid(number(2, 14))
    odd = pick(3, ".", "  ", ". ", " - ")
    even = pick(4, "", " ", "-")
    pos = {"card": 1, "phone": 1, "none": 1, "other": 0}
    card, phone, never = {"card": 1, "other": 0, "none": 0}, {"phone": 1, "other": 0, "none": 0}, {"other": 0, "none": 0, "phone": 0, "card": 0}
    return [
        (2, cut_up(sixteen, odd, 4, 4, 4, 4), {"card": 1, "none": 1, "other": 0}),
        (2, cut_up(fifteen, odd, 4, 6, 5), {"card": 1, "none": 1, "other": 0}),
        (2, cut_up(number(5, 16), even, 4, 4, 4, 4), card),
        (2, cut_up(number(6, 15), even, 4, 6, 5), card),
        (2, s("978", pick(7, "-", " "), number(8, 1), "-", number(9, 4), "-", number(10, 4), "-", number(11, 1)), never),
        (2, s("20", number(12, 2), "0", number(13, 1), "1", number(14, 1), number(15, 6)), never),
        (2, s(number(16, 3), " ", number(17, 3), " ", number(18, 3), " ", number(19, 3), " ", number(20, 3)), never),
        (2, F.repeat(number(21, 1), 14), never),
        (2, s("000", number(22, 14)), never),
        (2, s(number(23, 1), " ", number(24, 2), " ", number(25, 2), " ", number(26, 2), " ", number(27, 2), " ", number(28, 2), " ", number(29, 2)), never),
        (2, number(30, 18), never),
        (3, s("(", number(31, 3), ")", pick(32, " ", "", "-"), number(33, 3), pick(34, "-", " ", "."), number(35, 4)), {k: v for k, v in pos.items() if k != "card"}),
        (3, cut_up(number(36, 10), pick(37, "-", ".", " "), 3, 3, 4), {"phone": 1, "none": 1, "other": 0}),
        (3, s("0", number(38, 2), pick(39, " ", "-", "/").substr(1, 1), number(40, 4), " ", number(41, 4)), phone),
        (3, s("0", number(42, 3), "-", number(43, 7)), phone),
        (3, number(44, 10), phone),
        (3, cut_up(number(45, 8), pick(46, " ", "-"), 4, 4), phone),
        (3, number(47, 7), never),
        (3, s("20", number(48, 2), "-0", number(49, 1), "-1", number(50, 1)), never),
        (3, s("1", number(51, 1), ".0", number(52, 1), ".20", number(53, 2)), never),
        (3, s("20", number(54, 2), "-0", number(55, 1), "-1", number(56, 1), " 1", number(57, 1)), never),
        (3, s("19", number(58, 2), "-20", number(59, 2)), never),
        (3, s(number(60, 1), ".", number(61, 8)), never),
        (3, s(number(62, 1), " ", number(63, 3), " ", number(64, 3)), never),
        (3, s(number(65, 2), " ", number(66, 2), " ", number(67, 2), " ", number(68, 2)), never),
        (3, s(number(69, 2), ".", number(70, 4), " ", number(71, 2), ".", number(72, 4)), never),
        (0, s("user", number(73, 2), " (at) mail", number(74, 1), pick(75, " (dot) ", "(dot)", "."), pick(76, "com", "org", "de")), {"none": 1, "phone": 1}),
        (0, s(pick(77, "anna.b", "k_lee", "info"), "[at]", pick(78, "example", "uni-x"), pick(79, "[dot]", "."), pick(80, "com", "net", "fr")), {"none": 1, "phone": 1}),
        (0, s(pick(81, "meet", "start", "ends"), " (at) ", number(82, 1), ".", number(83, 2)), {"none": 0, "phone": 0}),
        (0, s(pick(84, "x", "rate", "p"), "[at]", number(85, 2), ".", number(86, 1)), {"none": 0, "phone": 0}),
    ]


def training_lines(spark: SparkSession, n: int = LINES) -> DataFrame:
    """(i, kind, value, before, after, label): one span to a line; label 1 for personal data. Made by hashing the row
    number: a form, what stands before it and what comes after."""
    h = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), F.col("i")), F.lit(m))
    number = lambda salt, size: F.lpad(F.pmod(F.xxhash64(F.lit(salt), F.col("i")), F.lit(10**size)).cast("string"), size, "0")
    forms = _forms(number, h)
    cases = [(form, head, label) for form, (_, _, labels) in enumerate(forms) for head, label in labels.items()]
    fixed = F.array(*[F.struct(F.lit(form).alias("form"), F.lit(forms[form][0]).alias("kind"), F.lit(float(label)).alias("label"), F.array(*map(F.lit, HEADS[head])).alias("heads")) for form, head, label in cases])
    value = F.coalesce(*[F.when(F.col("case.form") == k, v) for k, (_, v, _) in enumerate(forms)])
    word = F.element_at("case.heads", (F.pmod(F.xxhash64(F.lit(91), F.col("i")), F.size("case.heads")) + 1).cast("int"))
    lead = F.element_at(F.array(*map(F.lit, HEADS["none"])), (h(92, len(HEADS["none"])) + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, (" ", ": ", " no ", "\n"))), (h(93, 4) + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, (" a", ". ", ", ", "\n", " (", ""))), (h(94, 6) + 1).cast("int"))
    lines = spark.range(n, numPartitions=4).withColumnRenamed("id", "i").withColumn("case", F.element_at(fixed, (h(90, len(cases)) + 1).cast("int")))
    return lines.select(
        "i", "case.kind", value.alias("value"), F.right(F.concat(lead, F.lit(" "), word, mark), F.lit(CONTEXT)).alias("before"), F.left(tail, F.lit(2)).alias("after"), "case.label",
    )


def _tree(node, names: list[str], scale: float) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(scale * node.prediction())
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= F.lit(split.threshold()), _tree(node.leftChild(), names, scale)).otherwise(_tree(node.rightChild(), names, scale))


def fitted(spark: SparkSession) -> tuple[Column, dict[str, float]]:
    """The boosted trees' probability as an expression over the feature columns, and a threshold for each kind."""
    key = spark.sparkContext.applicationId
    if key not in _fitted:
        table, names = _training_table(spark)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=5, labelCol="label").fit(VectorAssembler(inputCols=names, outputCol="features").transform(table.filter("i % 4 < 2")))
        margin = F.lit(0.0)
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            margin = margin + _tree(tree._java_obj.rootNode(), names, weight)
        probability = 1 / (1 + F.exp(-2 * margin))
        scored = table.filter("i % 4 = 2").select("kind", "label", F.ceil(probability * 100).alias("step"))
        steps = scored.groupBy("kind", "step").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
        _fitted[key] = probability, {name: _threshold([(r["step"], r["good"], r["n"]) for r in steps if r["kind"] == k]) for k, name in enumerate(KINDS)}
    return _fitted[key]


def _training_table(spark: SparkSession) -> tuple[DataFrame, list[str]]:
    made = _features(F.struct("kind", "value", "before", "after"))
    return cut(cut(training_lines(spark)).select("i", "kind", "label", *[c.alias(f"f_{k}") for k, c in made.items()])), [f"f_{k}" for k in made]


def report(spark: SparkSession) -> DataFrame:
    """(kind, n, positive, precision, recall) of the additional spans on the lines that neither trees nor thresholds saw."""
    probability, thresholds = fitted(spark)
    limit = F.element_at(F.array(*[F.lit(thresholds[k]) for k in KINDS]), F.col("kind") + 1)
    hit = (probability > limit).cast("double")
    rows = _training_table(spark)[0].filter("i % 4 = 3").select(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"), "label", hit.alias("hit"))
    right = F.sum(F.col("hit") * F.col("label"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("label").alias("positive"), F.try_divide(right, F.sum("hit")).alias("precision"), F.try_divide(right, F.sum("label")).alias("recall"))


def _threshold(steps: list[tuple[int, float, int]]) -> float:
    """Where the precision asked for ends: halfway, in hundredths, between the least step that holds it and the next
    step down; 1 if none holds it."""
    ordered = sorted(steps, reverse=True)
    least, good, n = 1.0, 0.0, 0
    for k, (step, g, m) in enumerate(ordered):
        good, n = good + g, n + m
        if good >= PRECISION * n:
            below = ordered[k + 1][0] if k + 1 < len(ordered) else 0
            least = (step + below) / 200
    return least


def _scanned(rows: DataFrame) -> DataFrame:
    """(id, did, th, base, added, spans) of rows as of keyed()."""
    probability, thresholds = fitted(rows.sparkSession)
    text = F.col("text")
    bare = lambda spans: F.transform(spans, lambda x: x.dropFields("value"))
    base = F.concat(*[bare(labelled(k, KINDS[k], spans)) for k, spans in enumerate(base_spans(text))])
    rows = cut(rows.select("id", "did", "th", base.alias("base"), _candidates(text).alias("found")))
    each = rows.filter(F.size("found") > 0).dropDuplicates(["did", "th"])
    none = F.lit(None).cast("string")
    known = F.transform("base", lambda b: F.struct(b["start"], b["kind"], b["end"], b["name"], *[none.alias(c) for c in ("value", "before", "after")]))
    each = each.select("did", "th", F.explode(F.concat("found", known)).alias("x"))
    so_far = Window.partitionBy("did", "th").orderBy("x.start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("x.value").isNull(), F.col("x.end"))).over(so_far)
    each = each.withColumn("reach", F.coalesce(reach, F.lit(-1))).filter("x.value is not null and x.end > reach")
    scored = each.select("did", "th", "x", *[c.alias(f"f_{k}") for k, c in _features(F.col("x")).items()])
    limit = F.element_at(F.array(*[F.lit(thresholds[k]) for k in KINDS]), F.col("x.kind") + 1)
    # the score is a column of its own: a filter would be pushed below the features and take them in, node by node
    judged = scored.select("did", "th", F.when(probability > limit, F.col("x").dropFields("value", "before", "after")).alias("x"))
    added = judged.groupBy("did", "th").agg(F.array_sort(F.collect_set("x")).alias("added"))
    joined = rows.join(added, ["did", "th"], "left").withColumn("added", F.coalesce("added", F.expr("filter(base, x -> false)")))
    by_kind = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"], x["start"], x["end"], x["name"]))), lambda x: F.struct(x["start"], x["kind"], x["end"], x["name"]))
    return joined.select("id", "did", "th", by_kind(F.col("base")).alias("base"), "added", by_kind(F.concat("base", "added")).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added, spans): base spans, those the trees add, and both, as array<struct<start,kind,end,name>> in
    code points. base and spans sort by kind, then start.

    An added span that lies within a base span is part of it and not reported; others may overlap. Null texts are
    empty; a null id keeps its row; equal rows get equal spans; rows of one id with different texts are told apart; an
    empty table gives no rows. Other columns are not read.
    """
    return _scanned(keyed(docs, id_col, text_col)).select("id", "base", "added", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The scan's findings as counts, a SHA-256 of the base spans and a list of all spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every reported span replaced by its kind in brackets, overlapping spans by that of the first.

    Rows are known by id and text, so each gets its own spans whatever ids repeat or are null; null texts come out
    empty; equal rows come out alike; an empty table gives no rows. A text with spans is replaced block by block, so
    the work grows with its length.
    """
    rows = keyed(docs, id_col, text_col)
    spans = _scanned(rows).filter(F.size("spans") > 0).dropDuplicates(["did", "th"]).select("did", "th", F.explode("spans").alias("x"))
    row = Window.partitionBy("did", "th")
    so_far = row.orderBy("x.start", "x.end", "x.name")
    reach = F.coalesce(F.max("x.end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = spans.withColumn("new", (F.col("x.start") >= reach).cast("int")).withColumn("group", F.sum("new").over(so_far))
    whole = heads.groupBy("did", "th", "group").agg(F.min("x.start").alias("start"), F.max("x.end").alias("end"), F.max(F.when(F.col("new") == 1, F.col("x.name"))).alias("name"))
    part = whole.select("did", "th", "start", "end", "name", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))).alias("block"))
    low = F.col("block") * CHUNK
    inside = F.struct(F.greatest(F.lit(0), F.col("start") - low).alias("start"), F.least(F.lit(CHUNK), F.col("end") - low).alias("end"), F.when(F.col("start") >= low, F.concat(F.lit("["), "name", F.lit("]"))).otherwise("").alias("to"))
    part = part.groupBy("did", "th", "block").agg(F.array_sort(F.collect_list(inside)).alias("cuts"))
    blocks = rows.join(whole.select("did", "th").distinct(), ["did", "th"], "left_semi").dropDuplicates(["did", "th"])
    blocks = blocks.select("did", "th", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("block", "piece"))
    cuts = F.concat(F.col("cuts"), F.array(F.struct(F.length("piece").cast("long").alias("start"), F.length("piece").cast("long").alias("end"), F.lit("").alias("to"))))
    kept = lambda x, i: F.concat(F.substring("piece", (F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(0) + 1).cast("int"), (x["start"] - F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(0)).cast("int")), x["to"])
    done = blocks.join(part, ["did", "th", "block"], "left").withColumn("cuts", F.when(F.col("cuts").isNotNull(), cuts))
    done = done.withColumn("piece", F.when(F.col("cuts").isNull(), F.col("piece")).otherwise(F.array_join(F.transform("cuts", kept), "")))
    texts = done.groupBy("did", "th").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("redacted"))
    return rows.join(texts, ["did", "th"], "left").select("id", F.coalesce("redacted", "text").alias("text"))
