"""Writers. All but the two for small reports are distributed and can be run again."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from judgelake.runtime import Stage


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites only the partitions that df holds, so that a step can be repeated."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def csv_table(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns as JSON."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small report as one pretty array."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write lines instead")
    Path(path).write_text(json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False), encoding="utf-8")


def markdown(df: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small report as a table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    Path(path).write_text("\n".join(out) + "\n", encoding="utf-8")


def markdown_chunks(df: DataFrame, order: str, text: str, path: str, size: int) -> None:
    """size items a file, in order. Rows are put in ranges of the order and numbered by the sizes of the ranges before, so
    that neither a text nor a sort of all rows meets one task."""
    ranges = Stage(df.sparkSession).keep(df.select(F.col(order).alias("o"), F.col(text).alias("t")).repartitionByRange("o").withColumn("r", F.spark_partition_id()))
    sizes = ranges.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("r", (F.sum("n").over(W.orderBy("r")) - F.col("n")).alias("base"))
    place = F.col("base") + F.row_number().over(W.partitionBy("r").orderBy("o", "t")) - 1
    chunks = ranges.join(before, "r").withColumn("chunk", F.floor(place / size)).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("o", "t")))["t"].alias("ts"))
    chunks.select("chunk", F.array_join("ts", "\n\n---\n\n").alias("value")).write.mode("overwrite").partitionBy("chunk").text(path)


def report_set(report: DataFrame, predictions: DataFrame, config: dict[str, object], path: str) -> None:
    """Report, its alias, predictions with raw output cut to 1000 characters, and the run's settings."""
    csv_table(report, f"{path}/report")
    csv_table(report, f"{path}/overall_metrics")
    csv_table(predictions.withColumn("raw_output", F.substring("raw_output", 1, 1000)), f"{path}/predictions")
    spark = report.sparkSession
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/run_config")


def manifest(members: DataFrame, key: str, split: str, answers: str | None = None, ids: bool = True) -> DataFrame:
    """(split, questions, answers, ids): counts and, unless left out, sorted ids of each split. Of splits too large for
    one cell the ids belong in a table of their own."""
    n = F.sum(F.size(answers)) if answers else F.lit(None).cast("bigint")
    listed = [F.sort_array(F.collect_set(key)).alias("ids")] if ids else []
    return members.groupBy(split).agg(F.count_distinct(key).alias("questions"), n.alias("answers"), *listed)
