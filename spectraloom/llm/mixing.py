"""Mixing sources to target weights.

Words are summed for each source, every source gets a target, and a document is taken
``floor(rate)`` times plus once more if a hash of its id falls below the fraction of the rate,
with ``rate = target / words of its source``. All of it is built-in column functions: one
aggregation to a row for each source, window sums over those rows, and a join back.

Cases: a null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0 and none of it is taken; equal rows are taken equally; an empty
table gives an empty table. Other columns pass through ``mix`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import WORD, Tables, pick, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Sources are broadcast up to this many rows (about 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (source, size): source, source_size, target. Water filling: with sources in order of
    cap / weight, the level is the first (total - caps before) / (weights before taken off) that
    does not exceed its own cap / weight; a target is the smaller of cap and level * weight."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1).cast("long")
    by = by.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy(F.lit(1))
    up = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    by = by.withColumn("level", rest / left).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("w")))
    return by.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def copies(docs: DataFrame, seed: str = "mix:", **settings) -> DataFrame:
    """Adds _size, _source_size, _target and _copies to the columns _id, _text and _source of docs."""
    sized = docs.withColumn("_size", size_of(F.col("_text")))
    store = Tables(docs.sparkSession, "mixing")
    targets = store.save(source_targets(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size")), **settings), "targets")
    targets = targets.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    more = (draw(F.col("_id"), seed) < rate - F.floor(rate)).cast("long")
    return sized.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_copies", F.floor(rate) + more).drop("_s")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(names)))}
    named = plain.withColumns({"_id": F.col(at[doc_id]), "_text": F.col(at[text]), "_source": F.col(at[source])})
    taken = copies(named, **settings).where("_copies > 0")
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return taken.select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the document)."""
    named = pick(docs, _id=doc_id, _text=text, _source=source)
    c = F.col
    return copies(named, **settings).select(c("_id").alias("doc_id"), c("_size").alias("size"), c("_source_size").alias("source_size"), c("_target").alias("target"), (c("_copies") * c("_size")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM by_source),
levels AS (
  SELECT source, source_size, cap, w, cap / w AS ratio,
    (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
      - coalesce(CAST(sum(cap) OVER up AS BIGINT), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level
  FROM weighed
  WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN (SELECT count(*) FROM chosen) = 0 THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), (SELECT level FROM chosen) * w) END AS target
  FROM levels),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
