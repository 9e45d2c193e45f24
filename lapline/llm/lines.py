"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are near when one becomes the other by one character inserted, deleted or changed. Deleting that character
leaves both the same text around the same place, so each line gives, for every place, the hash of what deletion there
leaves (and, to meet longer lines, of itself with a gap there): all lines with an equal variant are near each other,
and the earliest of them stands for them. Variants are emitted from coarse to fine: with half of the line deleted,
then, where another line has the same rest, with a short piece of that half deleted, and only where that meets
another line again, with one character deleted. An edit lies in one half and in one piece of it, so nothing is lost,
and hardly a line comes to the last step that has no near one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapline.llm.shared import Scratch, free_prefix

#: Pieces that the deleted half is cut into.
PIECES = 16
#: Slots of the filter that the join of halves begins with: at most so many rows are broadcast (8 MB of longs).
SLOTS = 1 << 20
#: Something besides ASCII white space.
SOLID = r"[^ \t\r\f\x0B]"
#: A place is doc_id * LINES + line_no as one number, so that the earliest is a plain minimum.
LINES = 1 << 31
PLACE = "decimal(38,0)"
NO_DOC = -(2**63) - 1


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, version (hash of the whole text), line_no from 0, line."""
    return docs.select("doc_id", F.xxhash64("text").alias("version"),
                       F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def place() -> Column:
    doc = F.coalesce(F.col("doc_id").cast(PLACE), F.lit(str(NO_DOC)).cast(PLACE))
    return (doc * F.lit(LINES).cast("decimal(11,0)") + F.col("line_no").cast("decimal(11,0)")).cast(PLACE)


def doc_of(at: str) -> Column:
    step = f"cast({LINES} as decimal(11,0))"
    return F.when(F.col(at) >= F.lit(str(-(2**63) * LINES)).cast(PLACE), F.expr(f"({at} - pmod({at}, {step})) div {step}"))


def line_of(at: str) -> Column:
    return F.expr(f"cast(pmod({at}, cast({LINES} as decimal(11,0))) as int)")


def halves() -> Column:
    """Hashes of what is left of ``line`` (``size`` characters) with a half deleted.

    A tile is the length of the shorter line of a pair: a line stands in the tile of its own length and in that of
    one less. In each first the left half is kept, then the right one.
    """
    found = []
    for shorter in (0, 1):
        tile = F.col("size") - shorter
        left = F.shiftright(tile, 1)
        found.append(F.xxhash64(tile, F.lit(0), F.substring("line", F.lit(1), left)))
        found.append(F.xxhash64(tile, F.lit(1), F.substring("line", left + 1 + shorter, F.col("size"))))
    return F.array(*found)


def deleted_half() -> Column:
    """The half that the variant numbered ``which`` lacks."""
    left = F.shiftright(F.col("size") - F.col("shorter"), 1)
    return F.when(F.col("which") % 2 == 0, F.substring("line", left + 1, F.col("size"))).otherwise(
        F.substring("line", F.lit(1), left + F.col("shorter")))


def pieces() -> Column:
    """(rest, cut) for each piece that can be deleted from ``cut``: the hash of the rest, and the piece."""
    size = F.length("cut")
    tile = size - F.col("shorter")

    def piece(k: Column) -> Column:
        start = F.floor(tile * k / PIECES).cast("int")
        stop = F.floor(tile * (k + 1) / PIECES).cast("int")
        return F.struct(
            F.xxhash64("rest", k, F.substring("cut", F.lit(1), start),
                       F.substring("cut", stop + 1 + F.col("shorter"), size)).alias("rest"),
            F.substring("cut", start + 1, stop - start + F.col("shorter")).alias("cut"))

    return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece)


def variants() -> Column:
    """Hashed variants of a piece: each deletion, and each gap where a longer line may have one character more."""
    size = F.length("cut")

    def kept(at: Column, drop: int, kind: str) -> Column:
        return F.xxhash64("rest", F.lit(kind), at, F.substring("cut", F.lit(1), at),
                          F.substring("cut", at + 1 + drop, size))

    deletions = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(
        F.col("shorter") == 1, F.transform(deletions, lambda q: kept(q, 1, "gap"))
    ).otherwise(F.concat(F.transform(deletions, lambda q: kept(q, 1, "same")),
                         F.transform(F.sequence(F.lit(0), size), lambda q: kept(q, 0, "gap"))))


def met(rows: DataFrame, key: str) -> DataFrame:
    """The keys that two different lines have."""
    return rows.groupBy(key).agg(F.min("one").alias("low"), F.max("one").alias("high")).where(
        "low <> high").select(key)


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``: by slots first, which are few enough to broadcast, then exactly."""
    slot = F.pmod(key, F.lit(SLOTS)).alias("slot")
    slots = F.broadcast(keys.select(slot).distinct())
    return rows.withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot").join(keys, key, "left_semi")


def near_lines(scratch: Scratch, docs: DataFrame, every: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """(one, two, earliest) of the distinct lines with an earlier line within one edit: its place is ``earliest``."""
    keys = every.where(F.col("size") >= least).select(
        "one", "two", F.posexplode("halves").alias("which", "rest")).withColumn("shorter", F.shiftright("which", 1))
    shared = scratch.write(met(keys, "rest"), "shared")
    chosen = scratch.write(
        among(keys, shared, "rest").distinct().join(firsts, ["one", "two"]), "chosen")
    lines = lines_of(docs).select("line", F.xxhash64("line").alias("one"), F.xxhash64("line", F.lit(1)).alias("two"))
    wanted = chosen.select("one", "two").distinct().withColumn("key", F.col("one"))
    texts = scratch.write(among(lines.withColumn("key", F.col("one")), scratch.write(
        wanted.select("key").distinct(), "wanted"), "key").drop("key").distinct(), "texts")
    members = chosen.join(texts, ["one", "two"]).withColumn("size", F.length("line")).select(
        "one", "two", "first", "rest", "shorter", deleted_half().alias("cut"))
    cut = scratch.write(
        members.select("one", "two", "first", "shorter", F.explode(pieces()).alias("x")).select(
            "one", "two", "first", "shorter", "x.rest", "x.cut"), "cut")
    fine = among(cut, scratch.write(met(cut, "rest"), "fine"), "rest")
    spread = scratch.write(
        fine.select("one", "two", "first", "cut", F.explode(variants()).alias("variant")), "spread")
    groups = scratch.write(
        spread.groupBy("variant").agg(F.min("first").alias("earliest"), F.max("first").alias("last"))
        .where("earliest < last").select("variant", "earliest"), "groups")
    near = spread.join(groups, "variant")
    own = spread.select("variant", F.col("first").alias("earliest"), F.col("cut").alias("other"))
    near = near.where("first > earliest").join(own, ["variant", "earliest"]).where(F.levenshtein("cut", "other", 1) >= 0)
    out = scratch.write(near.groupBy("one", "two").agg(F.min("earliest").alias("earliest")), "near")
    scratch.drop("shared", "chosen", "wanted", "texts", "cut", "fine", "spread", "groups")
    return out


def near_within(scratch: Scratch, docs: DataFrame, firsts: DataFrame, least: int, edits: int) -> DataFrame:
    """What ``near_lines`` gives, for any bound: of the shorter of two lines within ``edits`` edits, cut into edits + 1
    parts, one part lies in the other line, moved by at most ``edits`` characters."""
    lines = lines_of(docs).where((F.length("line") >= least) & F.col("line").rlike(SOLID)).select(
        "line", F.xxhash64("line").alias("one"), F.xxhash64("line", F.lit(1)).alias("two")).distinct()
    texts = scratch.write(lines.join(firsts, ["one", "two"]).withColumn("size", F.length("line")), "texts")

    def part(tile: Column, k: int, moved: int) -> Column:
        start = F.floor(tile * k / (edits + 1)).cast("int")
        stop = F.floor(tile * (k + 1) / (edits + 1)).cast("int")
        return F.when((start + moved >= 0) & (stop + moved <= F.col("size")), F.xxhash64(
            tile, F.lit(k), F.substring("line", start + moved + 1, stop - start)))

    size, parts, moves = F.col("size"), range(edits + 1), range(-edits, edits + 1)
    own = F.array(*(part(size, k, 0) for k in parts))
    sought = F.array_distinct(F.array(*(part(size - less, k, by) for less in parts for k in parts for by in moves)))
    left = texts.select("one", "two", F.explode(own).alias("rest"))
    right = texts.select(F.col("one").alias("one_b"), F.col("two").alias("two_b"), F.explode(sought).alias("rest"))
    pairs = left.join(right, "rest").where("one <> one_b or two <> two_b").drop("rest").distinct()
    other = texts.select(F.col("one").alias("one_b"), F.col("two").alias("two_b"), F.col("line").alias("line_b"),
                         F.col("first").alias("first_b"))
    near = pairs.join(texts, ["one", "two"]).join(other, ["one_b", "two_b"]).where(
        (F.levenshtein("line", "line_b", edits) >= 0) & (F.col("first") != F.col("first_b")))
    later = F.col("first") > F.col("first_b")
    near = near.select(F.when(later, F.col("one")).otherwise(F.col("one_b")).alias("one"),
                       F.when(later, F.col("two")).otherwise(F.col("two_b")).alias("two"),
                       F.least("first", "first_b").alias("earliest"))
    out = scratch.write(near.groupBy("one", "two").agg(F.min("earliest").alias("earliest")), "near")
    scratch.drop("texts")
    return out


def line_decisions(docs: DataFrame, least: int = 16, scratch: Scratch | None = None, edits: int = 1) -> DataFrame:
    """One row per line of ``docs`` (doc_id, text): doc_id, version, line_no, kept, earliest_doc_id, earliest_line_no.

    A line is dropped if an earlier line is equal, or, for lines of ``least`` characters or more, within ``edits``
    characters inserted, deleted or changed; whether that one is kept itself makes no difference. Earlier is the
    smaller (doc_id, line_no), a null doc_id first. Rows that share a doc_id are one document: lines equal at the
    same place of two of them are both kept or both dropped; version, a hash of the whole text, tells them apart.
    Lines of white space are always kept. Lines end at a line feed; an empty text is one empty line, a null text has
    none, an empty table gives no row; other columns are left out. Whole texts are read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    docs = texts_of(docs)
    solid = F.col("line").rlike(SOLID)
    sized = lines_of(docs).withColumn("size", F.length("line"))
    every = scratch.write(
        sized.select("doc_id", "version", "line_no", "size", place().alias("at"),
                     F.when(solid, F.xxhash64("line")).alias("one"), F.xxhash64("line", F.lit(1)).alias("two"),
                     F.when(F.col("size") >= least, halves()).alias("halves")), "every")
    lines = every.where("one is not null")
    firsts = scratch.write(lines.groupBy("one", "two").agg(F.min("at").alias("first")), "firsts")
    near = (near_lines(scratch, docs, lines, firsts, least) if edits == 1
            else near_within(scratch, docs, firsts, least, edits))
    stands = scratch.write(
        firsts.join(near, ["one", "two"], "left").select(
            "one", "two", "first", F.coalesce("earliest", "first").alias("earliest")), "stands")
    scratch.drop("firsts", "near")
    judged = lines.join(stands, ["one", "two"])
    return judged.select(
        "doc_id", "version", "line_no", ((F.col("at") == F.col("first")) & (F.col("at") == F.col("earliest"))).alias("kept"),
        doc_of("earliest").alias("earliest_doc_id"), line_of("earliest").alias("earliest_line_no")
    ).unionByName(every.where("one is null").select(
        "doc_id", "version", "line_no", F.lit(True).alias("kept"), F.col("doc_id").alias("earliest_doc_id"),
        F.col("line_no").alias("earliest_line_no")))


def dedup_lines(docs: DataFrame, least: int = 16, edits: int = 1) -> DataFrame:
    """``docs`` without the lines that ``line_decisions`` drops; a document of which no line with a sign is left goes.

    ``text`` and, where there is one, ``n_chars`` are made anew for documents that lost lines; other columns and all
    other documents, also those with a null or blank text, stay as they are.
    """
    own = free_prefix(docs)
    scratch = Scratch(docs.sparkSession, "dedup")
    decided = scratch.write(line_decisions(docs, least, scratch, edits), "decided")
    scratch.drop("every", "stands")
    flags = decided.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("line_no", "kept"))).alias("flags"), F.min("kept").alias("whole")
    ).where("not whole").select(F.col("doc_id").alias(own + "doc"), F.col("version").alias(own + "version"),
                                F.transform("flags", lambda x: x["kept"]).alias(own + "keep"))
    flags = scratch.write(flags, "flags")
    scratch.drop("decided")
    joined = docs.withColumn(own + "hash", F.xxhash64(F.col("text").cast("string"))).join(
        flags,
        F.col("doc_id").cast("long").eqNullSafe(F.col(own + "doc")) & (
            F.col(own + "hash") == F.col(own + "version")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"),
                                 lambda line, i: F.element_at(own + "keep", (i + 1).cast("int"))), "\n")
    out = joined.withColumn("text", F.when(F.col(own + "keep").isNull(), F.col("text")).otherwise(left)).where(
        F.col(own + "keep").isNull() | F.col("text").rlike(SOLID))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(own + "keep").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(kind)))
    return out.select(*(f"`{c}`" for c in docs.columns))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_decisions(docs).drop("version")


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, (unnest(range(len(string_split(text, chr(10))))))::INTEGER AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents),
solid AS (SELECT * FROM l WHERE regexp_matches(line, '[^ \t\r\f\v]')),
firsts AS (
  SELECT line, length(line) AS n, min({'d': doc_id, 'k': line_no}) AS first FROM solid GROUP BY line),
long AS (SELECT * FROM firsts WHERE n >= 16),
half AS (
  SELECT line, n, first, tile, 'left' AS side, left(line, tile // 2) AS part
  FROM long, LATERAL (SELECT unnest([n, n - 1]) AS tile)
  UNION ALL
  SELECT line, n, first, tile, 'right', right(line, tile - tile // 2)
  FROM long, LATERAL (SELECT unnest([n, n - 1]) AS tile)),
pairs AS (
  SELECT DISTINCT a.line, a.n, b.line AS other, b.n AS m, b.first
  FROM half a JOIN half b ON a.tile = b.tile AND a.side = b.side AND a.part = b.part
    AND a.line <> b.line AND b.first < a.first AND abs(a.n - b.n) <= 1),
near AS (
  SELECT line, min(first) AS earliest FROM pairs
  WHERE CASE
    WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: substr(line, i, 1) <> substr(other, i, 1))) = 1
    WHEN n < m THEN len(list_filter(range(0, m), lambda i: left(other, i) || substr(other, i + 2) = line)) > 0
    ELSE len(list_filter(range(0, n), lambda i: left(line, i) || substr(line, i + 2) = other)) > 0 END
  GROUP BY line)
SELECT s.doc_id, s.line_no,
  near.line IS NULL AND f.first = {'d': s.doc_id, 'k': s.line_no} AS kept,
  coalesce(near.earliest, f.first).d AS earliest_doc_id, coalesce(near.earliest, f.first).k AS earliest_line_no
FROM solid s JOIN firsts f ON s.line = f.line LEFT JOIN near ON near.line = s.line
UNION ALL
SELECT doc_id, line_no, true, doc_id, line_no FROM l WHERE NOT regexp_matches(line, '[^ \t\r\f\v]')
"""
