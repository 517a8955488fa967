"""Queries over usage logs, feature vectors and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.functions.num import six
from judgelake.operators import flatten, probe
from judgelake.runtime import read_table
from judgelake.streaming import usage


def usage_window(spark: SparkSession, d: str) -> DataFrame:
    return usage.windowed(read_table(spark, d, "usage_log"))


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Calls and mean tokens of each backend and model, repeated records once."""
    rows = usage.distinct_calls(usage.calls(read_table(spark, d, "usage_log")))
    return rows.groupBy("backend", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"), six(F.avg("prompt_chars")).alias("mean_chars"), F.count("total_tokens").alias("with_usage")
    )


def feature_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = probe.feature_scale(read_table(spark, d, "embeddings"), "embedding")
    return rows.select("feature", six(F.col("mean")).alias("mean"), six(F.col("std")).alias("std"))


def probe_score(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of a fixed head: alternating weights on unscaled vectors."""
    rows = read_table(spark, d, "embeddings")
    w = [0.5 if i % 2 == 0 else -0.5 for i in range(64)]
    return rows.select("vec_id", six(probe.probe_probability(F.col("embedding"), w, 0.1, [0.0] * 64, [1.0] * 64)).alias("p"))


def probe_train(spark: SparkSession, d: str) -> DataFrame:
    """A head that tells labels below 5 from the others, trained on even vectors, with its accuracy on odd ones."""
    rows = read_table(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") < 5, 1).otherwise(0).alias("y"))
    head = probe.train_probe(rows.filter("vec_id % 2 = 0"), "embedding", "y")
    p = probe.probe_probability(F.col("embedding"), head["weights"], head["bias"], head["mean"], head["std"])
    return rows.filter("vec_id % 2 = 1").agg(F.count(F.lit(1)).alias("n"), F.count_if((p >= 0.5) == (F.col("y") == 1)).alias("right"))


def probe_network(spark: SparkSession, d: str) -> DataFrame:
    """The same task by a hidden layer: dev loss chooses the epoch, accuracy is that of vectors seen in neither part."""
    rows = read_table(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") < 5, 1).otherwise(0).alias("y"))
    known = rows.filter("vec_id % 4 <> 3").withColumn("dev", F.col("vec_id") % 4 == 1)
    head = probe.train_network(known, "embedding", "y", "dev", hidden=16, epochs=25)
    scored = probe.network_probability(rows.filter("vec_id % 4 = 3"), "embedding", head)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("right"), F.lit(head["best_epoch"]).alias("best_epoch"))


def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each distinct text."""
    rows = read_table(spark, d, "documents").filter("length(text) > 0").select("doc_id", F.sha2("text", 256).alias("h"))
    return flatten.first_of_each(rows, ["h"], ["doc_id"]).select("doc_id")


QUERIES = {f.__name__: f for f in (usage_window, usage_totals, feature_scale, probe_score, probe_train, probe_network, first_documents)}

_U = """u AS (SELECT DISTINCT make_timestamp(CAST(floor(ts * 1000000) AS BIGINT)) AS moment, backend, model, prompt_chars, num_messages, TRY_CAST(usage['prompt_tokens'] AS BIGINT) AS prompt_tokens,
    TRY_CAST(usage['completion_tokens'] AS BIGINT) AS completion_tokens, TRY_CAST(usage['total_tokens'] AS BIGINT) AS total_tokens FROM usage_log)"""

ORACLE = {
    "usage_window": f"""WITH {_U} SELECT date_trunc('hour', moment) AS start, model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
        CAST(sum(prompt_chars) AS BIGINT) AS prompt_chars FROM u WHERE moment IS NOT NULL GROUP BY 1, 2""",
    "usage_totals": f"WITH {_U} SELECT backend, model, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(avg(prompt_chars), 6) AS mean_chars, count(total_tokens) AS with_usage FROM u GROUP BY 1, 2",
    "feature_scale": """SELECT i - 1 AS feature, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS std FROM
        (SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1""",
    "probe_score": """SELECT vec_id, round(1 / (1 + exp(-z)), 6) AS p FROM (SELECT vec_id, 0.1 + list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CASE WHEN i % 2 = 1 THEN 0.5 ELSE -0.5 END)) AS z FROM embeddings)""",
    "first_documents": "SELECT min(doc_id) AS doc_id FROM documents WHERE length(text) > 0 GROUP BY text",
}
