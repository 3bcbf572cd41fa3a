"""URL verdicts: a rule list first, then association rules that Spark's FP-growth mines from what the list decides.

A URL's items are the labels of its host and the segments of its path, with digits folded. The URLs that the list
decides are the labelled ones. Items that enough of them hold are kept, and those that the very same URLs hold make one
class, so that long equal URLs are no long itemsets. FP-growth gets the classes of a labelled URL and its verdict as a
basket, and its rules from one class or two to a verdict are kept. Its work may grow as the subsets of a basket: where
a URL has over WIDEST classes, the baskets are a class or a pair of classes with the verdict, so that work grows with the
square of a URL's classes; the rules are the same. Rules that are frequent and
confident enough stand in an inverted index under their rarer class; a URL looks up its classes there, and of the rules
whose classes it all has (a class by any of its items), the most confident gives the verdict. All of it is DataFrame
operations.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import materialise

#: (host, path, verdict), in the form of the published list.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT, LEAST_PAGES, MIN_CONFIDENCE = 0.01, 5, 0.6
#: Classes of the longest URL up to which FP-growth gets whole baskets.
WIDEST = 16
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty for null or without `://`."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def items(host: Column, path: Column) -> Column:
    """Distinct items of a URL, sorted: `h:` with a host label, `p:` with a path segment, runs of digits as 0."""
    fold = lambda c, mark: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_sort(F.array_distinct(F.concat(fold(F.split(host, r"\."), "h:"), fold(F.split(path, "/"), "p:"))))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits a host or a parent domain of it and starts the path, as struct (rule, verdict)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def classes(occurrences: DataFrame, least: int) -> DataFrame:
    """(item, class, freq) of the items that at least so many URLs hold, from occurrences (rid, item) without repeats.
    Items with the same URLs (by number and two sums of hashes) have the least of them as their class."""
    urls = F.xxhash64("rid")
    found = occurrences.groupBy("item").agg(F.count("*").alias("freq"), F.sum(urls.cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("mix")).where(F.col("freq") >= least)
    return found.select("item", F.min("item").over(Window.partitionBy("freq", "sum", "mix")).alias("class"), "freq")


def mine(held: DataFrame, n: int, least: int, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (needs, verdict, confidence, support) from held (classes, verdict) of n labelled URLs. needs has one class
    or two; support is the share of the n URLs with them and the verdict, which at least `least` are."""
    shape = "needs array<string>, verdict string, confidence double, support double"
    size = F.size("classes").cast("long")
    whole, pairs, longest = held.where(size > 0).agg(F.count("*"), F.sum(size * (size + 1) / 2).cast("long"), F.max(size)).first()
    if not whole:
        return held.sparkSession.createDataFrame([], shape)
    verdict = F.concat(F.lit("="), "verdict")  # no class starts so
    if longest <= WIDEST:
        baskets, needs = whole, F.array_sort("antecedent")
        items = held.where(size > 0).select(F.concat("classes", F.array(verdict)).alias("items"))
    else:
        baskets, needs = pairs, F.from_json(F.col("antecedent")[0], "array<string>")
        first = held.select("verdict", "classes", F.posexplode("classes").alias("at", "first"))
        rest = F.slice("classes", F.col("at") + 2, F.size("classes"))
        both = F.explode(F.concat(F.array(F.array("first")), F.transform(rest, lambda x: F.array(F.col("first"), x))))
        items = first.select("verdict", both.alias("needs")).select(F.array(F.to_json("needs"), verdict).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / baskets, minConfidence=min_confidence).fit(items).associationRules
    rules = rules.where(F.startswith(F.col("consequent")[0], F.lit("=")) & (F.size("antecedent") <= 2))
    return rules.select(needs.alias("needs"), F.substr(F.col("consequent")[0], F.lit(2)).alias("verdict"), "confidence", (F.round(F.col("support") * baskets) / n).alias("support"))


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url; others aren't read).

    Null and empty URLs, and those without `://`, have an empty host and path, no items and no rule. A URL that no
    listed and no mined rule fits gets DEFAULT. Of mined rules that fit, the greatest confidence wins, then support,
    then `block`. Very long URLs are read whole: their items are exploded to rows, and only frequent classes are paired.
    Repeated rows give repeated rows.
    """
    host, path = host_and_path("url")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("rid"))
    parsed = materialise(parsed.withColumn("listed", listed(F.col("host"), F.col("path"), rules)).withColumn("items", items(F.col("host"), F.col("path"))))
    decided, rest = parsed.where("listed is not null"), parsed.where("listed is null")
    n = decided.where(F.size("items") > 0).count()
    least = max(math.ceil(min_support * n), least_pages)
    known = materialise(classes(decided.select("rid", F.explode("items").alias("item")), least))
    has = parsed.select("rid", F.explode("items").alias("item")).join(known.select("item", "class"), "item")
    held = materialise(has.groupBy("rid").agg(F.array_sort(F.collect_set("class")).alias("classes")))
    mined = mine(held.join(decided.select("rid", F.col("listed.verdict").alias("verdict")), "rid"), max(n, 1), least)
    freq = known.select("class", "freq").distinct()
    each = mined.select("*", F.explode("needs").alias("class")).join(freq, "class")
    index = each.groupBy("needs", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "class"))["class"].alias("key"))
    mine_of = held.join(rest.select("rid"), "rid")
    hits = mine_of.select("classes").distinct().select("classes", F.explode("classes").alias("key")).join(materialise(index), "key")
    hits = hits.where(F.forall("needs", lambda x: F.array_contains("classes", x)))
    best = hits.groupBy("classes").agg(F.max(F.struct("confidence", "support", "verdict"))["verdict"].alias("mined"))
    rest = rest.join(mine_of.join(best, "classes").select("rid", "mined"), "rid", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit(DEFAULT)).alias("verdict"))
    return decided.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("verdict")).unionByName(rest)
