"""URL filter: fixed host and path rules first, then association rules mined by FP-growth.

A labelled page's URL is a transaction of tokens: host labels with the registered end joined, path
segments with digits folded, query keys, and its label. Tokens that occur on the very same labelled pages
always go together and count as one, so that their combinations are not mined one by one. FP-growth mines
the frequent combinations; those that imply a label, ``block`` or ``allow``, with enough support, confidence and lift become
rules, unless a rule of fewer tokens for that label is as confident. A rule is filed in an inverted index under its
rarest token; a page looks up its tokens there and tests whether it holds the whole rule. Of the rules
that it holds the most confident one decides, of equals one that blocks, then the first by name. A page
without one is allowed.

Scale: FP-growth runs on short token arrays of labelled pages alone, in parallel by item groups. Matching
joins exploded tokens with those that rules name; no other token shuffles. All of it is DataFrame code
on the JVM.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed;
without labels nothing is mined; repeated pages are judged alone; extra columns are ignored; several
labels of a page count as the worst; a null label says nothing bad; a page whose id has no label is not learned from.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.durable import durable

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SUPPORT = 0.002
#: A rule's pages, with its label, are at least so many.
LEAST = 20
CONFIDENCE = 0.6
LIFT = 1.1
BLOCK, ALLOW = "label=block", "label=allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest() -> Column:
    return F.when(F.col("url").contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def host() -> Column:
    return F.translate(F.regexp_extract(_rest(), "^[^/?#]*", 0), _UPPER, _LOWER)


def path() -> Column:
    return F.regexp_extract(_rest(), "^[^/?#]*([^?#]*)", 1)


def fixed(rules=RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``, as struct<rule, verdict>, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    """Distinct tokens of ``url`` with ``host`` and ``path`` given."""
    labels = F.split("host", r"\.")
    named = F.concat(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.concat(F.lit("host="), x)), F.array(F.concat(F.lit("end="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))))
    parts = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("path="), F.regexp_replace(F.translate(x, _UPPER, _LOWER), "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(_rest(), F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    return F.array_distinct(F.filter(F.concat(named, parts, keys), lambda x: ~x.isin("path=", "host=", "end=")))


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> tuple[DataFrame, DataFrame]:
    """Rules (need, label, confidence, rarest) in names of token classes, and (token, name) of their tokens."""
    bad = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    known = pages.join(bad, pages.page_id == bad.doc_id).select(F.xxhash64("page_id", "url").alias("h"), "tokens", F.when(F.col("bad") == 1, BLOCK).otherwise(ALLOW).alias("label"))
    known = durable(known.withColumn("id", F.monotonically_increasing_id()))
    total = known.count()
    # Tokens of the same pages agree in their number and in the sums of both halves of the pages' hashes.
    half = lambda h: (F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))))
    one, two = half(F.xxhash64("id"))
    of = known.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), one.alias("one"), two.alias("two")).filter(F.col("n") >= LEAST)
    name = of.groupBy("n", "one", "two").agg(F.min("token").alias("name"))
    name = durable(of.join(name, ["n", "one", "two"]).select("token", "name", "n"))
    items = known.select("id", "label", F.explode("tokens").alias("token")).join(name, "token").groupBy("id").agg(F.collect_set("name").alias("names"), F.first("label").alias("label"))
    # Pages without a frequent token count too: lift compares with the share of the label among all.
    items = known.select("id", "label").join(items.select("id", "names"), "id", "left").select(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, LEAST / max(total, 1))), minConfidence=confidence).fit(durable(items))
    label = F.col("consequent")[0]
    rules = model.associationRules.filter(label.isin(BLOCK, ALLOW) & (F.col("lift") >= lift) & ~F.arrays_overlap("antecedent", F.array(F.lit(BLOCK), F.lit(ALLOW))))
    rules = durable(rules.select(F.array_sort("antecedent").alias("need"), label.alias("label"), "confidence"))
    # A rule falls if one of its proper parts is a rule of no less confidence; parts meet it on their first token.
    parts = rules.select("label", F.col("need").alias("part"), F.col("confidence").alias("part_confidence"), F.get("need", F.lit(0)).alias("token"))
    longer = rules.filter(F.size("need") > 1).withColumn("token", F.explode("need"))
    beaten = longer.join(parts, ["label", "token"]).filter((F.size("part") < F.size("need")) & (F.size(F.array_except("part", "need")) == 0) & (F.col("part_confidence") >= F.col("confidence"))).select("need", "label").distinct()
    kept = rules.join(beaten, ["need", "label"], "left_anti").withColumn("token", F.explode("need"))
    often = name.select(F.col("name").alias("token"), "n").distinct()
    ranked = kept.join(often, "token").groupBy("need", "label").agg(F.max("confidence").alias("confidence"), F.min_by("token", F.struct("n", "token")).alias("rarest"))
    ranked = durable(ranked)
    named = name.select("token", "name").join(ranked.select(F.explode("need").alias("name")).distinct(), "name", "left_semi")
    return ranked, durable(named)


def judge(pages: DataFrame, labels: DataFrame, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the mined rule, if that decides)."""
    split = pages.select("page_id", "url").withColumns({"host": host(), "path": path()}).withColumn("tokens", tokens())
    rules, named = mine(split, labels, **mining)
    told = split.withColumn("__fixed", fixed())
    held = told.filter("__fixed IS NULL").select("url", F.explode("tokens").alias("token")).join(named, "token").groupBy("url").agg(F.collect_set("name").alias("held"))
    found = held.select("url", "held", F.explode("held").alias("rarest")).join(rules, "rarest").filter(F.size(F.array_except("need", "held")) == 0)
    first = F.struct(-F.col("confidence"), F.col("label") != BLOCK, F.array_join("need", " & ").alias("need"), F.regexp_replace("label", "^label=", "").alias("label"))
    best = found.groupBy("url").agg(F.min(first).alias("best")).select("url", "best.need", "best.label")
    told = told.join(best, "url", "left")
    free = F.col("__fixed").isNull()
    verdict = F.when(~free, F.col("__fixed.verdict")).otherwise(F.coalesce("label", F.lit("allow")))
    return told.select("page_id", "host", "path", F.col("__fixed.rule").alias("rule"), verdict.alias("verdict"), F.when(free, F.col("need")).alias("mined"))
