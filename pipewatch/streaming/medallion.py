"""Silver, quarantine and gold kept up to date batch by batch, each row written once.

A reading may come late by ``allowed`` seconds of event time. Until then it and its copies wait in a pool,
where the copy to keep is settled; then it goes to the silver table for good, so nobody has to
remove copies from history. Silver grows in time order, so the gold features of new rows need
the last few rows of each sensor only, which are carried along with them. A gold row is written when
the rows its target looks ahead to are there.

What is carried from batch to batch: the pool, the carried rows (a fixed number per sensor) and
the time that silver is complete up to. It lies in two folders in turn, so a batch that is run again finds the state
it began with; output folders are named by batch and overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipewatch.operators import gold as go
from pipewatch.operators import silver as sv

#: Folder of the rows written when a stream is closed.
CLOSING = -1


@dataclass(frozen=True)
class Medallion:
    """Where the tables lie, and what their rows are joined with."""

    root: str
    nodes: DataFrame | None = None
    metadata: DataFrame | None = None
    links: DataFrame | None = None
    allowed: int = 3600
    horizon: int = 1

    def folder(self, table: str, number: int) -> str:
        return f"{self.root}/{table}/batch={number}"

    def state(self, name: str, number: int) -> str:
        return f"{self.root}/state/{name}-{number % 2}"


def _micros() -> Column:
    return F.unix_micros(F.col(sv.TIME))


def _put(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_neighbours(rows: DataFrame, horizon: int) -> DataFrame:
    """Gold features, whether a row's target is known, and whether later rows will reach back to it."""
    reach = go.LOOKBACK + horizon

    def follow(w: WindowSpec) -> dict[str, Column]:
        there = lambda n: F.lead(F.lit(True), n).over(w)
        return {"_known": there(horizon).isNotNull(), "_carried": there(reach).isNull()}

    return go.series_features(rows, horizon, follow, reach)


def _gold(tables: Medallion, settled: DataFrame, carried: DataFrame | None, number: int, closing: bool) -> None:
    """Write the gold rows that became complete, and what the next batch has to know."""
    fresh = settled.withColumn("_done", F.lit(False))
    context = fresh if carried is None else carried.unionByName(fresh)
    seen = _put(with_neighbours(context, tables.horizon), f"{tables.root}/state/features")
    ready = F.lit(True) if closing else F.col("_known")
    names = [c for c in seen.columns if c not in ("_known", "_carried", "_done")]
    out = seen.filter(ready & ~F.col("_done")).select(*names).withColumns(go.calendar())
    _put(go.fill_gaps(go.attach_degree(out, tables.links)), tables.folder("gold", number))
    if not closing:
        keep = seen.filter("_carried").select(*settled.columns, (F.col("_done") | F.col("_known")).alias("_done"))
        _put(keep, tables.state("carried", number))


def advance(tables: Medallion, bronze: DataFrame, number: int) -> None:
    """Take in one batch of bronze rows."""
    spark = bronze.sparkSession
    curated = sv.curate(bronze, tables.nodes)
    _put(sv.align_labels(sv.quarantine(curated), tables.metadata), tables.folder("rejected", number))
    fresh = sv.complete(curated)
    carried = None
    upto = None
    if number > 0:
        upto = spark.read.parquet(tables.state("mark", number - 1)).first()["upto"]
        waiting = spark.read.schema(fresh.schema).parquet(tables.state("pool", number - 1)).filter(_micros() > upto)
        _put(fresh.filter(_micros() <= upto), tables.folder("late", number))
        fresh = waiting.unionByName(fresh.filter(_micros() > upto))
        carried = spark.read.parquet(tables.state("carried", number - 1))
    else:
        _put(fresh.limit(0), tables.folder("late", number))
    pool = _put(sv.deduplicate(fresh), tables.state("pool", number))
    latest = pool.agg(F.max(_micros())).first()[0]
    marks = [m for m in (upto, latest - tables.allowed * 1_000_000 if latest is not None else None) if m is not None]
    mark = max(marks, default=-(1 << 62))
    settled = _settle(tables, pool.filter(_micros() <= mark), number)
    _gold(tables, settled, carried, number, closing=False)
    _put(spark.createDataFrame([(number, mark)], "number long, upto long"), tables.state("mark", number))


def _settle(tables: Medallion, rows: DataFrame, number: int) -> DataFrame:
    return _put(sv.tag_units(sv.align_labels(rows, tables.metadata)), tables.folder("silver", number))


def medallion_stream(bronze_rows: DataFrame, tables: Medallion, checkpoint: str) -> StreamingQuery:
    """Take in all bronze rows that are new."""
    return (
        bronze_rows.writeStream.foreachBatch(lambda batch, number: advance(tables, batch, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def close(spark: SparkSession, tables: Medallion) -> None:
    """Write what still waits: no more readings will come. Targets that nothing follows fall back to the row's own label."""
    last = spark.read.parquet(f"{tables.root}/state/mark-*").orderBy(F.col("number").desc()).first()
    number = last["number"]
    waiting = spark.read.parquet(tables.state("pool", number)).filter(_micros() > last["upto"])
    settled = _settle(tables, waiting, CLOSING)
    _gold(tables, settled, spark.read.parquet(tables.state("carried", number)), CLOSING, closing=True)


def read_table(spark: SparkSession, tables: Medallion, name: str) -> DataFrame:
    """The silver, gold, rejected or late table as it is now; every row is there once."""
    return spark.read.parquet(f"{tables.root}/{name}").drop("batch")
