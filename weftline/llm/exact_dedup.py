"""Exact duplicates by content-defined chunk recipes.

A text is normalised (every blank deleted) and cut where its own characters
say so: after three characters from three fixed sets, between ``LEAST`` and
``MOST`` characters from the last cut, or at ``MOST``. Equal stretches of text
therefore give equal chunks wherever they stand. Each distinct chunk is moved
once: chunks are grouped by hash *and* content, so a hash that stands for two
contents is found there, and its contents get numbered identifiers. A
document's recipe is the ordered list of its chunks' identifiers, and two
documents are equal when their recipes are; the texts themselves don't travel.

Cases: a null text counts as empty; a very long text is cut whole, in one task; empty texts are equal to each other; of
equal texts the row with the most code points, then the smallest doc_id stays
(a null doc_id comes last); of wholly equal rows one stays; an empty table
gives an empty result; further columns of the input are ignored, whatever
their names. Texts in scripts without letters in the sets above are cut at
``MOST`` alone: their groups are right, but shifted passages share no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, saved, table

LEAST, MOST = 256, 8192
#: A cut follows three characters, one of each set, by ranges of Latin and its digits, then of other scripts. Some
#: one in 200 places is a cut, fewer than ``LEAST``, so that shifted texts soon fall into step again.
SETS = (
    "aeo0-4\u00e0-\u00ff" "\u03b1-\u03b5" "\u0430-\u0438" "\u05d0-\u05d4" "\u0627-\u062e" "\u0915-\u0922" "\u0e01-\u0e0e" "\u3041-\u3064\u30a1-\u30c4" "\u4e00-\u5fff" "\uac00-\ubc67",
    "bcghkmpw5-9,;" "\u03b6-\u03ba" "\u0439-\u043c" "\u05d5-\u05d9" "\u062f-\u0634" "\u0923-\u0928" "\u0e0f-\u0e15" "\u3065-\u306e\u30c5-\u30ce" "\u6000-\u6fff" "\ubc68-\uc7ff",
    "aidlrs1-3." "\u03c0-\u03c4" "\u043d-\u0441" "\u05e8-\u05ea" "\u0635-\u0639" "\u0930-\u0936" "\u0e19-\u0e23" "\u3081-\u308d\u30e1-\u30ed" "\u7000-\u7fff" "\uc800-\ucfff",
)
CUT = "(?<=" + "".join(f"[{x}]" for x in SETS) + ")"
CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?{CUT}|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def chunks(text: Column) -> Column:
    """The chunks of a normalised text, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def clashes(pieces: DataFrame) -> DataFrame:
    """Of ``(hash, chunk)`` rows, those distinct ones whose hash has several contents, with a number each."""
    distinct = pieces.groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    return distinct.join(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "hash", "left_semi")


def recipes(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """``docs`` (with ``text``) plus ``recipe``, the ordered identifiers of its chunks.

    An identifier is the chunk's hash, and for a hash with several contents the
    hash of that chunk's rank among them follows it, so equal identifiers mean
    equal chunks. The check runs over all chunks before any recipe is used.
    """
    body = normalised(F.col("text"))
    pieces = docs.select(F.explode(chunks(body)).alias("chunk")).select(hashed(F.col("chunk")).alias("hash"), "chunk")
    plain = docs.withColumn("recipe", F.transform(chunks(body), lambda c: F.struct(hashed(c).alias("hash"), F.lit(0).alias("rank"))))
    shared = clashes(pieces)
    if shared.isEmpty():
        return plain
    # Only chunks of these hashes are compared by content; each is ranked among its hash's contents.
    a, b = shared.select("hash", "chunk"), shared.select("hash", F.col("chunk").alias("other"))
    ranks = a.join(b, "hash").filter("other <= chunk").groupBy("hash", "chunk").agg(F.count(F.lit(1)).cast("int").alias("rank"))
    keyed = docs.withColumn("_row", F.expr("uuid()")) if "_row" not in docs.columns else docs
    keyed = saved(keyed)
    cut = keyed.select("_row", F.posexplode(chunks(normalised(F.col("text")))).alias("at", "chunk")).withColumn("hash", hashed(F.col("chunk")))
    named = cut.join(ranks, ["hash", "chunk"], "left").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", F.struct("hash", F.coalesce("rank", F.lit(0)).alias("rank")).alias("id")))).alias("ids"))
    return keyed.join(named, "_row", "left").withColumn("recipe", F.coalesce(F.transform("ids", lambda x: x["id"]), F.array().cast("array<struct<hash:bigint,rank:int>>"))).drop("ids", "_row")


def groups(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    source = docs.select("doc_id", "text")
    rows = recipes(source, hashed).select(
        "doc_id",
        "recipe",
        F.length(F.coalesce("text", F.lit(""))).alias("points"),
        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
    )
    # Rows alike in all this are counted first; one that repeats stays once.
    # Both uses below read what is written here, so texts are cut and hashed once.
    alike = saved(rows.groupBy("doc_id", "recipe", "points", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    rank = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"))
    # Written, so that adaptive execution can split the other side's rows of a large group.
    best = saved(alike.groupBy("recipe").agg(F.min(rank).alias("best"), F.sum("copies").alias("group_size")))
    return (
        alike.join(best, "recipe")
        .select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best") == rank).alias("_top"), "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("_top") & (F.col("_copy") == 1)).alias("kept"), "text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group."""
    return groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id)
"""
