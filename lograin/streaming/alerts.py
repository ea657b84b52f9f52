"""Burst alerts of an unbounded feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lograin.functions.text import extract_level, first_ip
from lograin.functions.times import from_micros, micros
from lograin.operators.bursts import Bursts, burst_category
from lograin.params import Params
from lograin.session import materialize


def entry_counts(entries: DataFrame, params: Params) -> DataFrame:
    """Events per category and microsecond, with the first event's address."""
    category = burst_category(extract_level(F.col("content")), params)
    return (
        entries.select(micros(F.col("ts")).alias("us"), "event_id", category.alias("category"), first_ip(F.col("content")).alias("ip"))
        .groupBy("category", "us")
        .agg(F.count("*").alias("n"), F.min_by(F.struct("event_id", "ip"), "event_id").alias("head"))
    )


def _merged(counts: DataFrame) -> DataFrame:
    merged = counts.groupBy("category", "us").agg(F.sum("n").alias("n"), F.min_by("head", "head.event_id").alias("head"))
    return merged.select(*counts.columns)


def alert_writer(entries: DataFrame, params: Params, path: str, delay: str) -> DataStreamWriter:
    """Write alerts to ``path/alerts`` as soon as they are certain.

    A time is certain once the feed has gone on by ``delay`` beyond it, the most by which
    events may come out of order. What is not certain waits in ``path/pending``; call
    :func:`flush_alerts` when a feed has ended. Events that come later than that can
    no longer change the alerts given: they are set aside in ``path/late``, see
    :func:`late_counts`, and never dropped.

    Every micro-batch goes through the partitioned batch detection, which starts
    from the windows the batch before left open: one row per category below
    ``path/windows``. A repeated batch starts from the same rows and overwrites
    its own folders.
    """
    delay_us = entries.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {delay})")).first()[0]

    def detect(rows: DataFrame, batch_id: int) -> None:
        _advance(rows.sparkSession, entry_counts(rows, params), params, path, batch_id, delay_us)

    return entries.writeStream.outputMode("append").foreachBatch(detect)


def flush_alerts(spark: SparkSession, params: Params, path: str) -> None:
    """Treat all times waiting below ``path`` as certain, after the last micro-batch."""
    last = spark.read.parquet(f"{path}/progress").agg(F.max("batch")).first()[0]
    pending = spark.read.parquet(f"{path}/pending/batch={last}")
    _advance(spark, pending.limit(0), params, path, last + 1, None)


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts that came too late for the alerts: category, us, n, head, batch."""
    return spark.read.parquet(f"{path}/late")


def _advance(spark: SparkSession, counts: DataFrame, params: Params, path: str, batch_id: int, delay_us: int | None) -> None:
    counts, newest, certain = materialize(counts), None, None
    if batch_id:
        newest, certain = spark.read.parquet(f"{path}/progress/batch={batch_id - 1}").first()
        if certain is not None:
            counts.filter(F.col("us") <= certain).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            counts = counts.filter(F.col("us") > certain)
        counts = materialize(_merged(counts.unionByName(spark.read.parquet(f"{path}/pending/batch={batch_id - 1}"))))
    times = [us for us in (newest, counts.agg(F.max("us")).first()[0]) if us is not None]
    newest = max(times, default=None)
    if newest is not None:
        reached = newest if delay_us is None else newest - delay_us
        certain = reached if certain is None else max(certain, reached)
    ready = F.lit(False) if certain is None else F.col("us") <= certain
    counts.filter(~ready).write.mode("overwrite").parquet(f"{path}/pending/batch={batch_id}")
    _detect(spark, materialize(counts.filter(ready)), params, path, batch_id)
    progress = spark.createDataFrame([(newest, certain)], "newest long, certain long").coalesce(1)
    progress.write.mode("overwrite").parquet(f"{path}/progress/batch={batch_id}")


def _detect(spark: SparkSession, counts: DataFrame, params: Params, path: str, batch_id: int) -> None:
    carried = _carried(spark, path, batch_id)
    bursts = Bursts.of_counts(counts.select("category", "us", "n"), params, carried)
    ips = {row["category"]: row["ip"] for row in _head_ips(counts, params).collect()}
    ips |= {row["category"]: row["ip"] for row in carried}

    points = materialize(bursts.severity_points().unionByName(bursts.overall_points()))
    alerts = points.select(
        "category",
        from_micros(F.col("start_us")).alias("window_start"),
        from_micros(F.col("us")).alias("ts"),
        "count",
        _of_category(ips).alias("ip"),
    )
    alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")

    windows = bursts.open_windows(points).withColumn("ip", _of_category(ips))
    idle = spark.createDataFrame(carried, _schema(windows)).join(windows, "category", "left_anti")
    windows.unionByName(idle).coalesce(1).write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")


def _schema(windows: DataFrame) -> str:
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in windows.schema)


def _carried(spark: SparkSession, path: str, batch_id: int) -> list[Row]:
    if batch_id == 0:
        return []
    return spark.read.parquet(f"{path}/windows/batch={batch_id - 1}").collect()


def _head_ips(counts: DataFrame, params: Params) -> DataFrame:
    """Address in the first event of each category and, for overall, of all."""
    categories = F.array_distinct(F.array(F.col("category"), F.lit(params.overall_category)))
    return (
        counts.withColumn("category", F.explode(categories))
        .filter("category <> ''")
        .groupBy("category")
        .agg(F.min_by("head.ip", F.struct("us", "head.event_id")).alias("ip"))
    )


def _of_category(ips: dict[str, str | None]) -> Column:
    ip = F.lit(None).cast("string")
    for name, value in ips.items():
        ip = F.when(F.col("category") == name, value).otherwise(ip)
    return ip


def stream_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts written so far."""
    return spark.read.parquet(f"{path}/alerts").drop("batch")
