"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from judgelake.llm import cutoff, defects, leaks, overlap, splits, subjects, tokens
from judgelake.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]

TIE_SCHEMA = "record_id bigint, question_id string, data_source string, candidates array<struct<candidate_id string>>"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_groups(read_table(spark, d, "response_bank", TIE_SCHEMA), read_table(spark, d, "candidate_specs"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(
        read_table(spark, d, "response_bank", TIE_SCHEMA), read_table(spark, d, "candidate_specs"), read_table(spark, d, "split_plan")
    )


def p1_balance(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_balance(
        read_table(spark, d, "response_bank", TIE_SCHEMA), read_table(spark, d, "candidate_specs"), read_table(spark, d, "split_plan")
    )


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(read_table(spark, d, "documents"))


BANK_PAIRS = "record_id bigint, question string, candidates array<struct<response string>>"
BENCH_PAIRS = "record_id bigint, question string, answers array<struct<answer_text string>>"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.find_defects(read_table(spark, d, "response_bank", BANK_PAIRS), read_table(spark, d, "bench", BENCH_PAIRS))


BANK_RESPONSES = (
    "record_id bigint, data_source string, candidates array<struct<model_name string, response string, "
    "reward_result struct<raw_judge_responses array<string>>>>"
)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_cases(read_table(spark, d, "response_bank", BANK_RESPONSES))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_report(read_table(spark, d, "response_bank", BANK_RESPONSES))


BANK_QUESTIONS = "record_id bigint, split_role string, data_source string, question string"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(read_table(spark, d, "response_bank", BANK_QUESTIONS))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(read_table(spark, d, "response_bank", BANK_QUESTIONS))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.find_subjects(*(read_table(spark, d, t) for t in ("documents", "subject_labels", "subject_areas"))).select("doc_id", "subject")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_report(*(read_table(spark, d, t) for t in ("documents", "subject_labels", "subject_areas")))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_splits": p1_splits, "p1_balance": p1_balance, "p3_found": p3_found, "p4_found": p4_found, "p4_report": p4_report,
        "p5_found": p5_found, "p5_report": p5_report, "p6_ids": p6_ids,
        "p7_found": p7_found, "p8_found": p8_found, "p8_report": p8_report,
    }


def _canonical(raw: str, prefix: str) -> str:
    """SQL of splits.canonical_id."""
    plain = f"regexp_replace(regexp_replace(lower({raw}), '[\\s\\x00-\\x1f\\x{{a0}}\\x{{200b}}]+', '', 'g'), '^[^\\p{{L}}\\p{{N}}]*(?:{prefix})?[^\\p{{L}}\\p{{N}}]*', '')"
    number = f"regexp_replace(regexp_replace({plain}, '[,_'']', '', 'g'), '\\.0*$', '')"
    return f"nullif(CASE WHEN regexp_matches({number}, '^\\d+$') THEN regexp_replace({number}, '^0+(\\d)', '\\1') ELSE regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') END, '')"


def oracle_sql() -> dict[str, str]:
    question, candidate, spec = _canonical("question_id", "q"), _canonical("c.candidate_id", "resp"), _canonical("candidate_id", "resp")
    return {
        "p1_found": f"""WITH RECURSIVE s AS (SELECT {spec} AS k FROM candidate_specs),
            keys AS (SELECT record_id, 'q:' || {question} AS key FROM response_bank UNION
                SELECT record_id, 'c:' || k FROM (SELECT record_id, {candidate} AS k FROM (SELECT record_id, unnest(candidates) AS c FROM response_bank)) WHERE k NOT IN (SELECT k FROM s WHERE k IS NOT NULL)),
            tied AS (SELECT DISTINCT a.record_id AS a, b.record_id AS b FROM keys a JOIN keys b ON a.key = b.key AND a.record_id <> b.record_id),
            reached AS (SELECT a, b FROM tied UNION SELECT r.a, t.b FROM reached r JOIN tied t ON r.b = t.a)
            SELECT a AS record_id, least(a, min(b)) AS group_id FROM reached GROUP BY a""",
    }
