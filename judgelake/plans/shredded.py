"""Queries over shredded records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.operators import shred
from judgelake.runtime import Stage, read_table

NARROW = "record_id bigint, candidates array<struct<reward_result struct<criterion_scores array<double>>>>"
WIDE = (
    "record_id bigint, candidates array<struct<candidate_id string, model_name string, model_path string, generation_mode string, temperature double, top_p double, "
    "response string, reward_result struct<parse_source string, judge_attempts bigint, fallback_used boolean>>>"
)
CANDIDATE_COLUMNS = {
    "candidate_id": "string", "model_name": "string", "model_path": "string", "generation_mode": "string", "temperature": "double", "top_p": "double", "response": "string",
    "parse_source": "string", "judge_attempts": "bigint", "fallback_used": "boolean",
}


def _nodes(spark: SparkSession, d: str, schema: str, lines: bool = True) -> DataFrame:
    bank = read_table(spark, d, "response_bank", schema)
    typed = shred.shred_columns(bank, "record_id", "response_bank", ["candidates"])
    return typed.unionByName(shred.shred_json(read_table(spark, d, "bank_lines"), "line_id", "line", "bank_lines")) if lines else typed


def _tables(spark: SparkSession, d: str, schema: str, fields: dict[str, str], lines: bool = True) -> dict[str, DataFrame]:
    nodes = _nodes(spark, d, schema, lines).filter(
        F.col("label").isin("record", "candidates", "criterion_scores", *fields)
    )
    return shred.entity_tables(Stage(spark).keep(nodes), fields)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.nodes_found(_tables(spark, d, NARROW, {}))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """Records and lines as the roots of the adjacency table."""
    return _tables(spark, d, NARROW, {})["records"].select("origin", "record_id", "node", "kind")


def _place(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def p2_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of both origins: object nodes joined with their scalar children and pivoted."""
    return _tables(spark, d, WIDE, CANDIDATE_COLUMNS)["candidates"].select("origin", "record_id", "node", *_place("cand_pos"), "kind", *CANDIDATE_COLUMNS)


def p2_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Criterion decisions of both origins with their candidate."""
    return _tables(spark, d, NARROW, {})["criteria"].select("origin", "record_id", "node", "candidate_node", *_place("cand_pos", "crit_pos"), "kind", "criterion_score")


def p2_typed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the typed table alone, which SQL can follow; no line is read."""
    return _tables(spark, d, WIDE, CANDIDATE_COLUMNS, lines=False)["candidates"].select("record_id", *_place("cand_pos"), *CANDIDATE_COLUMNS)


def p2_typed_criteria(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d, NARROW, {}, lines=False)["criteria"].select("record_id", *_place("cand_pos", "crit_pos"), "criterion_score")


FLAT_SCHEMA = (
    "record_id bigint, question_id string, split_role string, data_source string, question string, reference_answer string, ingested_at timestamp, "
    "candidates array<struct<candidate_id string, model_name string, model_path string, generation_mode string, temperature double, top_p double, response string, "
    "score double, num_parse_failures bigint, reward_result struct<score double, binary_score double, criterion_scores array<double>, criterion_weights array<double>, "
    "criterion_parse_ok array<boolean>, num_parse_failures bigint, raw_num_parse_failures bigint, raw_parse_success boolean, fallback_used boolean, judge_attempts bigint, "
    "parse_source string, raw_judge_response string, criterion_yes_probs array<double>>>>"
)


def _flat(spark: SparkSession, d: str, table: str) -> DataFrame:
    typed = shred.flat_columns(read_table(spark, d, "response_bank", FLAT_SCHEMA), "record_id", "response_bank", table)
    return typed.unionByName(shred.flat_json(read_table(spark, d, "bank_lines"), "line_id", "line", "bank_lines", table))


def p2_flat_records(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "records")


def p2_flat_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "candidates")


def p2_flat_criteria(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "criteria")


QUERIES = {"p2_found": p2_found, "p2_records": p2_records, "p2_candidates": p2_candidates, "p2_criteria": p2_criteria, "p2_typed_candidates": p2_typed_candidates, "p2_typed_criteria": p2_typed_criteria, "p2_flat_records": p2_flat_records, "p2_flat_candidates": p2_flat_candidates, "p2_flat_criteria": p2_flat_criteria}

ORACLE = {
    "p2_typed_candidates": """
        SELECT record_id, i - 1 AS cand_pos, c.candidate_id AS candidate_id, c.model_name AS model_name,
               c.model_path AS model_path, c.generation_mode AS generation_mode, c.temperature AS temperature, c.top_p AS top_p, c.response AS response,
               c.reward_result.parse_source AS parse_source, c.reward_result.judge_attempts AS judge_attempts, c.reward_result.fallback_used AS fallback_used
        FROM (SELECT record_id, unnest(candidates) AS c, generate_subscripts(candidates, 1) AS i FROM response_bank)""",
    "p2_typed_criteria": """
        SELECT record_id, cand_pos, j - 1 AS crit_pos, s AS criterion_score
        FROM (SELECT record_id, i - 1 AS cand_pos, unnest(c.reward_result.criterion_scores) AS s,
                     generate_subscripts(c.reward_result.criterion_scores, 1) AS j
              FROM (SELECT record_id, unnest(candidates) AS c, generate_subscripts(candidates, 1) AS i FROM response_bank))""",
}
