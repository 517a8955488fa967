"""Readers of the formats in which banks, predictions and id lists come; schemas are declared, never inferred."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANK = (
    "record_id bigint, question_id string, split_role string, data_source string, question string, reference_answer string, "
    "rubric array<struct<title string, description string, weight double>>, prompt array<struct<role string, content string>>, "
    "candidates array<struct<candidate_id string, model_name string, model_path string, generation_mode string, temperature double, top_p double, response string, score double, "
    "num_parse_failures bigint, reward_result struct<score double, binary_score double, criterion_scores array<double>, criterion_weights array<double>, "
    "criterion_parse_ok array<boolean>, num_parse_failures bigint, raw_num_parse_failures bigint, raw_parse_success boolean, fallback_used boolean, judge_attempts bigint, "
    "parse_source string, raw_judge_response string, raw_judge_responses array<string>, criterion_yes_probs array<double>, "
    "raw_judge_responses_by_group array<struct<group_index bigint, group_start bigint, group_end bigint, parse_source string, raw_judge_response string>>>>>"
)
BENCH = (
    "question_id string, question string, original_rubric string, refined_rubric array<struct<question_id string, rule_id string, type string, rubric string>>, "
    "answers array<struct<answer_id bigint, model string, answer_text string, total_score bigint, grade array<struct<rule_id bigint, type string, justification string, verdict string>>>>"
)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped, a bad line is an error unless strict is off."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header; quoted cells may hold line ends and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def vector_cells(df: DataFrame, *columns: str) -> DataFrame:
    """Cells such as "[1, 0]" as arrays; blank ones become null."""
    return df.withColumns({c: F.from_json(F.nullif(F.trim(F.col(c)), F.lit("")), "array<int>") for c in columns})


def id_list(spark: SparkSession, path: str, keys: tuple[str, ...] = ("question_ids", "ids", "train", "dev", "test", "full")) -> DataFrame:
    """Distinct ids of a list: lines with # comments, a JSON array, or a JSON object with one of the known keys; an object
    without any of them is an error."""
    text = spark.read.option("wholetext", True).text(path).withColumn("value", F.trim("value"))
    listed = F.from_json("value", "array<string>")
    known = F.from_json("value", ", ".join(f"`{k}` array<string>" for k in keys))
    unknown = F.raise_error(F.lit(f"none of the keys {', '.join(keys)} in the id list")).cast("array<string>")
    of_key = F.coalesce(*[known[k] for k in keys], unknown)
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, "#.*$", ""))), lambda s: s != "")
    ids = F.when(F.col("value").startswith("["), listed).when(F.col("value").startswith("{"), of_key).otherwise(lines)
    return text.select(F.explode(ids).alias("id")).filter("id is not null").distinct()


def required_ids(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Distinct ids of a field that every object of a file of lines must have; an error names the first line without it."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    ids = lines.select("value", F.get_json_object("value", f"$.{field}").alias("id"))
    missing = F.coalesce(F.trim("id"), F.lit("")) == ""
    bad = ids.filter(missing).select("value").limit(1).collect()
    if bad:  # only now are lines numbered
        at = spark.read.text(path).rdd.zipWithIndex().filter(lambda x: x[0][0] == bad[0]["value"]).map(lambda x: x[1] + 1).min()
        raise ValueError(f"no {field} in line {at}")
    return ids.select("id").distinct()


def template(spark: SparkSession, path: str) -> str:
    """Text of one template file."""
    return spark.read.option("wholetext", True).text(path).first()[0]


def artifact(spark: SparkSession, path: str, required: list[str]) -> dict:
    """One JSON object with keys that must be there."""
    made = json.loads(template(spark, path))
    missing = [k for k in required if k not in made]
    if missing:
        raise ValueError(f"the artifact lacks {', '.join(missing)}")
    return made


def run_summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON objects of many result folders with the folder's name."""
    return json_array(spark, pattern, schema).withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def first_present(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first source that exists, in whatever file system its path names."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            return json_lines(spark, path, schema) if path.endswith((".jsonl", ".json")) else spark.read.schema(schema).parquet(path)
    raise FileNotFoundError(", ".join(paths))


def settings(text: str, aliases: dict[str, str] | None = None) -> dict[str, str]:
    """key=value lines with export, quotes, comments and a byte-order mark; the first value of a key stays."""
    out: dict[str, str] = {}
    for line in text.lstrip("﻿").splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if not m:
            continue
        key, value = m.groups()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out.setdefault((aliases or {}).get(key, key), value)
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
