"""Mix sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its integral gives
the words the source supplies; the cumulative demand, inverted, gives each
document its position, and documents are range-sorted by position. All of it
is DataFrame expressions.

Defined results: a null text has size 0, and a source of such texts only has target 0 and is not taken; a null source is a source of its own,
ordered last; rows that agree in doc_id, size and text are alike, so it does
not matter which of them is taken first; an empty table gives an empty mix.
Columns the operator adds start with ``mix_`` and replace any of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.llm.text import WORD

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (1, 2, 3)
#: Passes over a source at most.
PASSES = 3
#: Weight at the start and at the end of training, by the source's weight.
SCHEDULES = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}
#: Runs that a source's order is cut into; each is summed by itself.
RUNS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per source: size, weight and target.

    ``weight * level`` words, at most ``passes`` times the source. Sources in
    the order of the level at which they are used up are either used up by the
    level that what is left of the total allows, or set the final level.
    """
    sums = sized.groupBy("source").agg(F.sum("mix_size").alias("mix_source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    ranked = sums.select("*", place.alias("_place"), weight.cast("long").alias("mix_weight")).withColumn(
        "_cap", F.col("mix_source_size") * passes
    )
    order = Window.orderBy(F.col("_cap") / F.col("mix_weight"), "_place")
    every = Window.partitionBy()
    used = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("mix_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide(F.sum("mix_source_size").over(every) - used, open_weight)
    leveled = ranked.withColumn("_level", level).withColumn(
        "_full", F.col("_cap") <= F.col("_level") * F.col("mix_weight")
    )
    final = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(final * F.col("mix_weight"))
    return leveled.withColumn("mix_target", target).select(
        F.col("source").alias("_source"), "mix_source_size", "mix_weight", "mix_target"
    )


def position(share: Column, weight: Column, schedules=SCHEDULES) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its whole."""
    out = F.lit(None).cast("double")
    for value, (start, end) in schedules.items():
        if start == end:
            time = share
        else:
            time = (F.sqrt(F.lit(start * start) + F.lit(end * end - start * start) * share) - start) / F.lit(
                end - start
            )
        out = F.when(weight == value, time).otherwise(out)
    return out


def assign(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, schedules=SCHEDULES, runs: int = RUNS) -> DataFrame:
    """Each document with its source's size and target, the words taken and its positions.

    A source's documents lie in an order drawn from md5 of the doc_id. Whole
    passes over it and one begun pass add up to the target; the document at
    the end of the begun pass is cut, so the words taken equal the target
    rounded to a word. ``mix_copies`` has the words and the position of each pass.
    A source's running sum is the sum of earlier runs plus a sum inside a run, so a
    source with a third of all rows is spread over ``runs`` groups.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.withColumn("mix_size", n_words(F.col("text"))).withColumn("_key", key)
    sized = sized.withColumn("_run", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % runs)
    targets = source_targets(sized, weights, passes)
    per_run = sized.groupBy(F.col("source").alias("_source"), F.col("_run").alias("_r")).agg(
        F.sum("mix_size").alias("_sum")
    )
    earlier = Window.partitionBy("_source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_run.select("_source", "_r", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    starts = starts.alias("a").join(targets.alias("b"), F.expr("a._source <=> b._source")).select("a.*", "mix_source_size", "mix_weight", "mix_target")
    inside = (
        Window.partitionBy("source", "_run")
        .orderBy("_key", F.col("doc_id").asc_nulls_first(), "mix_size", F.md5(F.coalesce("text", F.lit(""))))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = sized.withColumn("_upto", F.sum("mix_size").over(inside))
    joined = placed.join(
        starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_run") == F.col("_r")), "left"
    )
    size, whole = F.col("mix_size"), F.col("mix_source_size")
    before = F.col("_start") + F.col("_upto") - size
    quota = F.round("mix_target").cast("long")

    def words_of(number: int) -> Column:
        return F.greatest(F.lit(0), F.least(size, quota - F.lit(number) * whole - before)).cast("long")

    copies = F.array(
        *[
            F.struct(
                F.lit(number).alias("pass"),
                words_of(number).alias("words"),
                position(F.try_divide(F.lit(number) * whole + before, quota), F.col("mix_weight"), schedules).alias("position"),
            )
            for number in range(passes)
        ]
    )
    return (
        joined.withColumn("mix_copies", F.filter(copies, lambda c: c["words"] > 0))
        .withColumn("mix_taken", sum((words_of(n) for n in range(passes)), F.lit(0)).cast("long"))
        .drop("_key", "_run", "_source", "_r", "_start", "_upto")
    )


def head(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: a row per copy, range-sorted by position, cut where its pass ends.

    The columns are those of ``docs`` and ``mix_position``; a given ``n_chars``
    is kept true to the text.
    """
    copies = assign(docs, **settings).withColumn("_copy", F.explode("mix_copies"))
    cut = F.col("_copy.words") < F.col("mix_size")
    out = copies.withColumn("text", F.when(cut, head(F.col("text"), F.col("_copy.words"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    kept = [c for c in docs.columns if not c.startswith("mix_")]
    return out.select(*kept, F.col("_copy.position").alias("mix_position")).orderBy("mix_position", "doc_id")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(coalesce(text, '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
  FROM sized GROUP BY source),
ranked AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sums),
leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, place)),
marked AS (SELECT *, cap <= level * weight AS used FROM leveled),
targets AS (
  SELECT source, source_size, weight, CASE WHEN used THEN CAST(cap AS DOUBLE)
         ELSE (max(level) FILTER (WHERE NOT used) OVER ()) * weight END AS target FROM marked),
placed AS (
  SELECT s.doc_id, size, t.source_size, t.weight, t.target, CAST(round(t.target) AS BIGINT) AS quota,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY CAST('0x' || k[1:8] AS BIGINT) % 4096, k, s.doc_id NULLS FIRST, size, h
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(0, least(size, quota - before)) AS a, greatest(0, least(size, quota - source_size - before)) AS b,
         greatest(0, least(size, quota - 2 * source_size - before)) AS c, before / quota AS share FROM placed)
SELECT doc_id, size, source_size, target, CAST(a + b + c AS BIGINT) AS taken,
       CASE WHEN a > 0 THEN round(CASE weight WHEN 1 THEN (sqrt(2.25 - 2.0 * share) - 1.5) / -1.0 WHEN 2 THEN share
                 ELSE (sqrt(0.25 + 2.0 * share) - 0.5) / 1.0 END, 9) END AS first_position
FROM taken
"""


def query(spark, sf_dir: str) -> DataFrame:
    """All documents mixed; one row each, in training order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    first = F.round(F.get("mix_copies", F.lit(0))["position"], 9)
    return (
        assign(docs)
        .select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), first.alias("first_position"))
        .orderBy("first_position", "doc_id")
    )
