"""Secret scans over a ledger of blobs, in DataFrame operations only.

Every version of every path is named by the SHA-256 of its text. The ledger says which blobs were scanned under which
version of the rules; a run scans one copy of each blob that isn't there yet, adds what it found, and joins the
findings of all blobs back to all paths that hold them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.utils import AnalysisException

from lapline.llm.shared import Scratch, free_prefix

SEEN = "blob string, rules string"
FOUND = "blob string, rules string, kind int, start long, `end` long"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has fewer than ``least`` characters go.

    ``trigger`` is a pattern that every text with a match that stays has; only such texts are taken apart.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    trigger: str = ""
    base: bool = False


RULES = (
    # fixed values: the base rules
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         12, 2, r"""(?i:passw|secret|token|api_?key)[a-zA-Z]{0,3}["']?\x20*[:=]""", True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, r"AKIA[A-Z0-9]{14}", True),
    Rule("hex", r"[0-9a-f]+", 16, 0, r"[0-9a-f]{16}", True),
    # what is added to them
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def matches(text: Column, rule: Rule) -> Column:
    """Array of (gap, size, measured) of the matches of a rule, null if there are none.

    ``gap`` is the number of characters between the match before and this one. Each match is taken from where the
    last one ended (\\G), so the text is walked once.
    """
    pattern = F.lit(r"(?s)\G(.*?)(" + rule.pattern + ")")

    def lengths(group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length)

    measured = lengths(rule.group + 2) if rule.group else lengths(2)
    return F.when(text.rlike(rule.trigger or rule.pattern),
                  F.arrays_zip(lengths(1).alias("gap"), lengths(2).alias("size"), measured.alias("measured")))


def spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, start, end) of all matches in ``blobs`` (blob, text); code points, end exclusive."""
    text = F.col("text")
    found = F.filter(F.array(*(
        F.struct(F.lit(k).alias("kind"), matches(text, rule).alias("found")) for k, rule in enumerate(rules))),
        lambda x: x["found"].isNotNull())
    by_kind = blobs.select("blob", F.explode(found).alias("x"))
    rows = by_kind.select("blob", "x.kind", F.posexplode("x.found").alias("i", "m")).select(
        "blob", "kind", "i", F.col("m.gap").alias("gap"), F.col("m.size").alias("size"),
        F.col("m.measured").alias("measured")).distinct()
    along = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(along)
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind") + 1)
    return rows.withColumn("end", end).where(F.col("measured") >= least).select(
        "blob", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


class Ledger:
    """Two tables below a folder: ``seen`` (blob, rules) and ``found`` (blob, rules, kind, start, end)."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self.table("seen", SEEN)

    def found(self) -> DataFrame:
        return self.table("found", FOUND)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the unseen blobs of ``docs`` (doc_id, text), and give (doc_id, blob) of all its rows.

        Findings are added before the blobs are noted as seen: a run that breaks off is made up for by the next one,
        and what both found is one when it is read.
        """
        scratch, mark = Scratch(self.spark, "ledger"), version_of(rules)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        named = docs.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
        paths = scratch.write(named.select("doc_id", "blob"), "paths")
        seen = self.seen().where(F.col("rules") == mark).select("blob")
        unseen = scratch.write(
            paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left_anti"), "unseen")
        # one row of each unseen blob; equal rows of one path are the same blob and count once
        here = unseen.withColumnRenamed("blob", "unseen_blob").withColumnRenamed("doc_id", "at")
        texts = named.join(here, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("unseen_blob")),
                           "left_semi")
        found = spans(texts.select("blob", "text"), rules)
        found.select("blob", F.lit(mark).alias("rules"), "kind", "start", "end").write.mode("append").parquet(
            f"{self.folder}/found")
        unseen.select("blob", F.lit(mark).alias("rules")).write.mode("append").parquet(f"{self.folder}/seen")
        return paths

    def by_blob(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans) of the blobs with findings: spans is an array of (start, kind, end) in order."""
        return self.found().where(F.col("rules") == version_of(rules)).groupBy("blob").agg(
            F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))


def named_spans(column: str, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    names = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def counted(column: str, kind: int) -> Column:
    return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of ``docs`` (doc_id, text).

    The ledger lies in ``folder`` (a new one if none is given); blobs that it holds aren't scanned again. A null text
    is empty, and a text without findings has counts 0 and empty spans. Repeated rows come out repeated, a null
    doc_id stays null, an empty table gives no row; other columns are left out. Whole texts are scanned. Spans may
    overlap between kinds, never within one; they are ordered by start, then kind as the rules are listed.
    """
    ledger = Ledger(docs.sparkSession, folder or Scratch(docs.sparkSession, "blobs").folder)
    paths = ledger.scan(docs, rules)
    base = [k for k, rule in enumerate(rules) if rule.base]
    listed = ledger.by_blob(rules).withColumn(
        "base", F.filter("spans", lambda x: x["kind"].isin(base)))
    counts = [counted("base", k).alias(f"n_{rules[k].kind}") for k in base]
    listed = listed.select("blob", *counts, named_spans("base", rules).alias("base"),
                           named_spans("spans", rules).alias("spans"))
    joined = paths.join(listed, "blob", "left")
    return joined.select(
        "doc_id", *(F.coalesce(f"n_{rules[k].kind}", F.lit(0).cast("long")).alias(f"n_{rules[k].kind}") for k in base),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))


def redact_secrets(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES,
                   mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; spans that overlap become one mask.

    ``text`` and, where there is one, ``n_chars`` are made anew for documents with findings; other columns and all
    other documents stay as they are.
    """
    spark, own = docs.sparkSession, free_prefix(docs)
    ledger = Ledger(spark, folder or Scratch(spark, "blobs").folder)
    ledger.scan(docs, rules)
    listed = ledger.by_blob(rules).select(F.col("blob").alias(own + "blob"), F.col("spans").alias(own + "spans"))
    text = F.col("text").cast("string")
    joined = docs.withColumn(own + "of", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).join(
        listed, F.col(own + "of") == F.col(own + "blob"), "left")
    state = F.aggregate(
        own + "spans", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(
            x["end"].alias("at"),
            F.when(x["start"] < s["at"], s["parts"]).otherwise(F.concat(s["parts"], F.array(
                F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask)))
            ).alias("parts"))),
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(
            text, (s["at"] + 1).cast("int"), F.length(text))))
    out = joined.withColumn("text", F.when(F.col(own + "spans").isNull(), F.col("text")).otherwise(state))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(own + "spans").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(kind)))
    return out.select(*(f"`{c}`" for c in docs.columns))


def op10_secret_ledger(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op10_sql() -> str:
    """The same by splitting at the matches: a match starts after all gaps and matches before it."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    kinds = []
    for k, rule in enumerate(RULES):
        pattern, name = quoted(rule.pattern), quoted(rule.kind)
        kinds.append(
            f"SELECT doc_id, {k} AS k, {name} AS kind, {rule.least} AS least, "
            f"regexp_split_to_array(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}) AS found, "
            f"regexp_extract_all(t, {pattern}, {rule.group}) AS measured FROM d")
    base = ", ".join(quoted(rule.kind) for rule in RULES if rule.base)
    counts = ", ".join(
        f"coalesce(count(*) FILTER (WHERE kind = {quoted(rule.kind)}), 0) AS n_{rule.kind}"
        for rule in RULES if rule.base)
    totals = ", ".join(f"coalesce(n_{rule.kind}, 0)::BIGINT AS n_{rule.kind}" for rule in RULES if rule.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(kinds)}),
i AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
p AS (
  SELECT doc_id, k, kind, length(found[i]) AS size, length(measured[i]) AS counted, least,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start FROM i),
s AS (SELECT doc_id, k, kind, start::BIGINT AS start, (start + size)::BIGINT AS stop FROM p WHERE counted >= least),
g AS (
  SELECT doc_id, {counts},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE kind IN ({base})) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {totals}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


OP10_SQL = _op10_sql()
