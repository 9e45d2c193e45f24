"""URL filters: given host and path rules first, else association rules that FP-growth mines from labelled pages.

A page is the set of tokens of its URL. Combinations of tokens that go with bad labels often enough (support) and
surely enough (confidence) become rules; a rule goes if a part of it is as sure. Rules are held in an inverted index
under their rarest token and match the pages that have all of their tokens.

Tokens that occur in the very same labelled pages are one item to FP-growth: of a URL that many pages copy, whatever
its length, one item is left in place of all combinations of its segments. Any of an item's tokens stands for it, as
a rule with one of them is as sure as with all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from lapline.llm.shared import Scratch, narrowed

BAD = "!bad"
#: Rules up to which their table is broadcast.
SMALL = 100_000


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host with its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that go before all others.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)


def lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host and path; both are empty for a null url or one without ``://``."""
    after = F.when(F.instr("url", "://") > 0, F.substring(
        "url", F.instr("url", "://") + 3, F.length("url"))).otherwise("")
    whole = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(whole, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", "url", lower(host).alias("host"), path.alias("path"))


def fitting(rules: tuple[HostRule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits host and path, else null."""
    host, path, found = F.col("host"), F.col("path"), F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
                       ).otherwise(found)
    return found


def tokens() -> Column:
    """Distinct tokens of a URL: labels of the host, segments of the path with digits as ``0``, names in the query."""
    url = F.coalesce("url", F.lit(""))

    def marked(mark: str, items: Column) -> Column:
        return F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    segments = F.split(F.regexp_replace("path", "[0-9]+", "0"), "/")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "[&;]"), lambda x: F.regexp_extract(x, r"(?s)\A([^=]*)", 1))
    scheme = F.when(F.instr("url", "://") > 0, lower(F.substring_index("url", "://", 1))).otherwise("")
    return F.array_sort(F.array_distinct(F.concat(
        marked("host:", F.split("host", "[.]")), marked("path:", segments), marked("query:", names),
        marked("scheme:", F.array(scheme)))))


def itemised(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens that ``least`` rows of ``labelled`` (page, tokens) have: the item is the smallest
    of the tokens with the same pages, which a count and two hashes of the pages stand for."""
    pages = labelled.select("page", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("often"), F.bit_xor(F.xxhash64("page")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("two"), "page")).alias("two")).where(F.col("often") >= least)
    return pages.select("token", F.min("token").over(Window.partitionBy("often", "one", "two")).alias("item"))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it where it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def mined(labelled: DataFrame, support: float, least: int, confidence: float, lift: float) -> DataFrame:
    """Rules (tokens, size, confidence, anchor) from ``labelled`` (items, with BAD among them for a bad page)."""
    count = labelled.count()
    empty = labelled.sparkSession.createDataFrame(
        [], "tokens array<string>, size int, confidence double, anchor string")
    if not count:
        return empty
    # a token in fewer pages than this is in no rule, so at most (tokens of a page) / share are counted further
    share = min(1.0, max(support, least / count))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(labelled)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(
        F.col("lift") >= lift).select(F.array_sort("antecedent").alias("tokens"), "confidence")
    often = labelled.select(F.explode("items").alias("token")).groupBy("token").count()
    by_token = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(often, "token")
    anchored = by_token.groupBy("tokens").agg(
        F.max("confidence").alias("confidence"), F.min(F.struct("count", "token"))["token"].alias("anchor"))
    return anchored.select("tokens", F.size("tokens").alias("size"), "confidence", "anchor")


def pruned(rules: DataFrame) -> DataFrame:
    """Rules of which no smaller part is as sure."""
    parts_ = rules.select(F.col("tokens").alias("part"), F.col("size").alias("part_size"),
                          F.col("confidence").alias("part_confidence"), F.col("anchor").alias("token"))
    spare = rules.select("tokens", "size", "confidence", F.explode("tokens").alias("token")).join(
        parts_, "token").where((F.col("part_size") < F.col("size")) & (
            F.col("part_confidence") >= F.col("confidence")) & (
            F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(spare, "tokens", "left_anti")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[HostRule, ...] = HOST_RULES,
                support: float = 0.002, least: int = 8, confidence: float = 0.6, lift: float = 1.5) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of each row of ``pages`` (page_id, url).

    The longest of ``rules`` that fits decides. Else a page is blocked if a mined rule matches it; confidence is that
    of the surest one (null if none does). Rules are mined from all pages with a label in ``labels`` (doc_id,
    quality, toxic; doc_id is the page's id): bad is quality 0 or toxic 1. A rule needs the share ``support`` of the
    labelled pages and ``least`` of them, ``confidence``, and ``lift`` times the rate of bad pages.

    A null or odd url has empty host and path, no rule, and is allowed unless mined rules say otherwise. Repeated
    pages come out repeated; a page with several labels is bad if one says so; null labels count as not bad, null ids
    have no label; without labels nothing is mined and pages without a given rule are allowed. An empty table gives
    no row; other columns are left out. A URL of many segments that many labelled pages copy is one item.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    pages = parts(narrowed(pages, page_id="long", url="string"))
    pages = scratch.write(pages.withColumn("given", fitting(rules)).withColumn("tokens", tokens()).drop("url"), "pages")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    labels = narrowed(labels, doc_id="long", quality="int", toxic="int").groupBy(
        F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    labelled = scratch.write(pages.join(labels, "page_id").select(
        F.monotonically_increasing_id().alias("page"), "tokens", "bad"), "labelled")
    # the count that the share of FP-growth comes to
    count = max(1, labelled.count())
    items = small(scratch.write(itemised(labelled, math.ceil(min(1.0, max(support, least / count)) * count)), "items"))
    held = labelled.select("page", F.explode("tokens").alias("token")).join(items, "token").groupBy("page").agg(
        F.collect_set("item").alias("items"))
    none = F.array().cast("array<string>")
    labelled = scratch.write(labelled.join(held, "page", "left").select(F.concat(
        F.coalesce("items", none), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none)).alias("items")), "mining")
    rules_ = scratch.write(mined(labelled, support, least, confidence, lift), "mined")
    rules_ = scratch.write(pruned(rules_), "rules")
    # pages of the same tokens are judged once
    kinds = scratch.write(
        pages.where("given is null").select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
        .join(items, "token").groupBy("tokens").agg(F.collect_set("item").alias("items")), "kinds")
    index = small(rules_.select(F.col("tokens").alias("needed"), "confidence", F.col("anchor").alias("item")))
    hits = scratch.write(
        kinds.select("tokens", "items", F.explode("items").alias("item")).join(index, "item")
        .where(F.size(F.array_except("needed", "items")) == 0)
        .groupBy("tokens").agg(F.max("confidence").alias("confidence")), "hits")
    given = pages.where("given is not null").select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("verdict"),
        F.lit(None).cast("double").alias("confidence"))
    rest = pages.where("given is null").join(hits, "tokens", "left").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(F.col("confidence").isNull(), "allow").otherwise("block").alias("verdict"), "confidence")
    return given.unionByName(rest)


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
