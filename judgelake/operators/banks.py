"""Response banks: built from questions and generated answers, and put back together from long scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.functions.text import slug
from judgelake.operators.score import weighted_score

SPEC = "candidate_id string, model_name string, model_path string, generation_mode string, temperature double, top_p double, place int"


def spec_matrix(spark: SparkSession, models: list[tuple[str, str]], sampled: list[tuple[str, str, float, float]] = ()) -> DataFrame:
    """Ways of answering: each model (name, path) greedily, then each sampled one (name, path, temperature, top_p)."""
    rows = [(name, path, "greedy", 0.0, 1.0) for name, path in models] + [(name, path, "sampled", float(t), float(p)) for name, path, t, p in sampled]
    made = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "model_name string, model_path string, generation_mode string, temperature double, top_p double, place int")
    return made.select(F.concat_ws("_", slug(F.col("model_name")), "generation_mode").alias("candidate_id"), "model_name", "model_path", "generation_mode", "temperature", "top_p", "place")


def bank_build(questions: DataFrame, responses: DataFrame, specs: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions with candidates: the reference answer first, then one candidate for each spec in order.

    responses: (key, candidate_id, response). They are joined by key and never by position; a question without a
    response of some spec, or with a response of an unknown one, is an error when the rows are read.
    """
    shape = ["candidate_id", "model_name", "model_path", "generation_mode", "temperature", "top_p"]
    told = responses.join(F.broadcast(specs), "candidate_id", "left")  # specs are a few ways of answering
    each = told.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("place", *shape, "response")), asc=True).alias("made"), F.count(F.lit(1)).alias("given"),
        F.count_if(F.col("place").isNull()).alias("unknown"), F.count_distinct("place").alias("known"),
    )
    n = specs.count()
    rows = questions.join(each, key, "left")
    bad = (F.coalesce("unknown", F.lit(0)) > 0) | (F.coalesce("given", F.lit(0)) != n) | (F.coalesce("known", F.lit(0)) != n)
    none = F.lit("reference_answer")
    first = F.struct(none.alias("candidate_id"), none.alias("model_name"), F.lit("").alias("model_path"), F.lit("reference").alias("generation_mode"), F.lit(0.0).alias("temperature"), F.lit(1.0).alias("top_p"),
                     F.coalesce("reference_answer", F.lit("")).alias("response"))
    others = F.transform("made", lambda c: F.struct(*[c[f].alias(f) for f in (*shape, "response")]))
    shape_type = "array<struct<candidate_id:string,model_name:string,model_path:string,generation_mode:string,temperature:double,top_p:double,response:string>>"
    made = F.concat(F.array(first).cast(shape_type), F.coalesce(others.cast(shape_type), F.array().cast(shape_type)))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("responses don't match the specs of "), F.col(key).cast("string"))).cast(shape_type)).otherwise(made)
    return rows.select(*questions.columns, checked.alias("candidates"))


def nested_bank(long: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Long scores (key, candidate_id, rule_index, prob, score, weight) as scored banks: candidates with score and
    reward_result. Another number of rules than the rubric has is an error when the rows are read; questions without
    a candidate are left out."""
    rules = long.groupBy(key, "candidate_id").agg(F.sort_array(F.collect_list(F.struct("rule_index", "score", "weight", "prob"))).alias("xs"))
    scores, weights = F.col("xs")["score"], F.transform("xs", lambda x: F.abs(F.coalesce(x["weight"], F.lit(1.0))))
    total = weighted_score(scores, weights)
    result = F.struct(
        total.alias("score"), scores.alias("criterion_scores"), weights.alias("criterion_weights"), F.transform("xs", lambda x: F.lit(True)).alias("criterion_parse_ok"),
        F.lit(0).cast("bigint").alias("num_parse_failures"), F.col("xs")["prob"].alias("criterion_yes_probs"),
    )
    each = rules.join(questions.select(key, F.size("rubric").alias("wanted")), key)
    fits = F.when(F.size("xs") != F.col("wanted"), F.raise_error(F.concat(F.lit("rules and rubric differ in number: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    made = each.filter(fits).select(key, F.struct("candidate_id", total.alias("score"), result.alias("reward_result")).alias("c"))
    return questions.drop("candidates").join(made.groupBy(key).agg(F.sort_array(F.collect_list("c")).alias("candidates")), key)
