"""URL filters: base rules by host and path, and association rules mined from the URLs that the base rules label.

``parts`` splits a URL into host and path. ``base_rule`` gives the longest base rule that fits. Every URL that a base rule
fits is a labelled transaction: its tokens (labels of its host, segments of its path) and the verdict as one more item.
Tokens that occur in just the same labelled URLs are one item, any of which stands for it, so a template of many constant
segments makes one rule, not one for each of their combinations. Spark's FP-growth mines combinations of items; those that
imply a verdict with enough confidence and support become rules, and a rule that drops one item of another without losing
confidence replaces it. Rules are matched through an inverted index: each is filed under its rarest item, a URL looks its
items up, and the rules found are checked item by item. The most confident rule wins (then the one with more support, then
the shorter, then the lower by the URL's tokens for its items); without any, the default verdict stands.

The support threshold bounds frequent tokens (a URL's tokens / support of them) and so the items, whatever the size of the input. Only distinct host and path
pairs that no base rule fits are looked up. Null URLs and those without ``://`` have an empty host and path, so no tokens,
and get the default verdict. Repeated rows keep their count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.llm.words import ascii_lower
from evidara.llm.workspace import Workspace

#: Verdict, host, path.
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host + path``, and its verdict; both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, at, under in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is asked first
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(under))
        rule, verdict = F.when(fits, F.lit(at + under)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens, sorted: h: and a host label; p: and a path segment, where a segment that starts with a digit is cut
    to that digit."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"(?s)^([0-9]).*$", "$1")))
    return F.array_sort(F.array_distinct(F.concat(labels, segments)))


def items_of(labelled: DataFrame, support: float) -> DataFrame:
    """token, item and n of the tokens of ``labelled`` (host, path, tokens) that may be frequent enough for a rule. The item is the
    smallest token that occurs in the same URLs, told by their number and two sums of their hashes."""
    least = F.lit(support) * labelled.count()
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "host", "path").cast("decimal(20,0)"))
    each = labelled.select("host", "path", F.explode("tokens").alias("token"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), hashed(1).alias("one"), hashed(2).alias("two")).filter(F.col("n") >= F.ceil(least))
    return found.withColumn("item", F.min("token").over(Window.partitionBy("n", "one", "two"))).select("token", "item", "n")


def with_items(urls: DataFrame, items: DataFrame) -> DataFrame:
    """``urls`` (tokens and others) with items: (item, the smallest of its tokens that the URL has), sorted."""
    named = items.agg(F.map_from_entries(F.collect_list(F.struct("token", "item"))).alias("named"))  # one row of a bounded map
    known = lambda c: F.transform(F.filter("tokens", lambda t: F.map_contains_key("named", t)), c)
    pairs = known(lambda t: F.struct(F.element_at("named", t).alias("item"), t.alias("token")))
    held = urls.crossJoin(F.broadcast(named)).withColumn("pairs", F.array_sort(pairs))
    first = F.filter("pairs", lambda p, i: (i == 0) | (F.get("pairs", i - 1)["item"] != p["item"]))
    return held.withColumn("items", first).drop("named", "pairs")


def mine(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """Rules (tokens: items, verdict, confidence, support) from ``labelled`` (items, verdict)."""
    names = F.transform("items", lambda p: p["item"])
    baskets = labelled.select(F.array_append(names, F.concat(F.lit("v:"), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    said = F.element_at("consequent", 1)
    return model.associationRules.filter(F.startswith(said, F.lit("v:")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("v:")))).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(said, 3, 100).alias("verdict"), "confidence", "support"
    )


def prune(rules: DataFrame) -> DataFrame:
    """Drops rules that imply what a rule with one token fewer implies with no less confidence."""
    wider = rules.select(F.col("tokens").alias("w_tokens"), F.col("verdict").alias("w_verdict"), F.col("confidence").alias("w_confidence"))
    less = rules.filter(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("out")).withColumn("w_tokens", F.array_remove("tokens", F.col("out")))
    idle = less.join(wider, "w_tokens").filter("verdict = w_verdict and w_confidence >= confidence").select("tokens", "verdict")
    return rules.join(idle, ["tokens", "verdict"], "left_anti")


def indexed(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Files each rule under its rarest item among the labelled URLs (ties: the lower item)."""
    count = items.filter("token = item").select("item", "n")
    rarest = rules.select("*", F.explode("tokens").alias("item")).join(count, "item")
    return rarest.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("n", "item"))["item"].alias("item")).withColumnRenamed("tokens", "rule_items")


def judge(pages: DataFrame, rules=BASE_RULES, support: float = 0.02, confidence: float = 0.7, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    space = Workspace(pages.sparkSession, "urls")
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = base_rule(F.col("host"), F.col("path"), rules)
    split = space.save(split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")), "split")
    known = split.filter("verdict is not null")
    open_ = split.filter("verdict is null")
    if known.isEmpty():
        return split.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    labelled = space.save(known.select("host", "path", tokens(F.col("host"), F.col("path")).alias("tokens"), "verdict"), "labelled")
    items = space.save(items_of(labelled, support), "items")
    mined = space.save(mine(with_items(labelled, items), support, confidence), "mined")
    index = space.save(indexed(prune(mined), items), "index")
    urls = open_.select("host", "path").distinct().withColumn("tokens", tokens(F.col("host"), F.col("path")))
    urls = with_items(urls, items).drop("tokens").withColumn("own", F.map_from_entries("items"))
    hits = urls.select("host", "path", "own", F.explode(F.map_keys("own")).alias("item")).join(index, "item").filter(F.expr("forall(rule_items, x -> map_contains_key(own, x))"))
    by = F.array_sort(F.transform("rule_items", lambda x: F.element_at("own", x)))
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("rule_items").alias("n"), by.alias("by"), F.col("verdict").alias("v"))
    best = hits.groupBy("host", "path").agg(F.min(order)["v"].alias("found"))
    told = open_.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
    return known.unionByName(told)
