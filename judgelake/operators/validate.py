"""Checks of data contracts as rows (check, key, detail); no row means no violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.operators.score import weighted_score


def _rows(df: DataFrame, check: str, broken: Column, key: Column, detail: Column) -> DataFrame:
    return df.filter(broken).select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def ids_unique(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    blank = _rows(counts, "id_blank", F.coalesce(F.trim("k"), F.lit("")) == "", F.col("k"), F.col("n"))
    return blank.unionByName(_rows(counts, "id_repeated", (F.col("n") > 1) & (F.trim("k") != ""), F.col("k"), F.col("n")))


def scored_candidates(rows: DataFrame) -> DataFrame:
    """rows: record_id, cand_pos, result (reward result). Vector lengths, labels 0 or 1, stored score, finite numbers."""
    r = F.col("result")
    scores, weights, ok = r["criterion_scores"], r["criterion_weights"], r["criterion_parse_ok"]
    key = F.concat_ws(":", F.col("record_id"), F.col("cand_pos"))
    recomputed = weighted_score(scores, weights)
    checks = [
        ("vector_length", (F.size(scores) != F.size(weights)) | (F.size(scores) != F.size(ok)), F.concat_ws(",", F.size(scores), F.size(weights), F.size(ok))),
        ("label_not_binary", F.exists(scores, lambda s: ~s.isin(0.0, 1.0)), F.size(scores)),
        ("label_null", F.exists(scores, lambda s: s.isNull()), F.size(scores)),
        ("score_missing", r.isNotNull() & r["score"].isNull(), F.lit("")),
        ("not_parsed", ~F.forall(ok, lambda x: F.coalesce(x, F.lit(False))), F.size(ok)),
        ("score_not_finite", F.isnan(r["score"]) | (F.abs(r["score"]) == float("inf")), F.lit("")),
        ("weight_not_finite", F.exists(weights, lambda w: F.isnan(w) | (F.abs(w) == float("inf"))), F.size(weights)),
        ("score_differs", (F.size(scores) == F.size(weights)) & ~F.exists(scores, lambda s: s.isNull()) & (F.abs(r["score"] - recomputed) > 1e-12), F.size(scores)),
    ]
    return reduce(DataFrame.unionByName, (_rows(rows, name, broken, key, detail) for name, broken, detail in checks))


def splits_disjoint(members: DataFrame, key: str, split: str) -> DataFrame:
    """Ids in more than one split."""
    by = members.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_set(split)).alias("splits"))
    return _rows(by, "split_overlap", F.size("splits") > 1, F.col("k"), F.array_join("splits", ","))


def not_covered(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Ids expected but not found, and found but not expected."""
    a, b = (df.select(F.col(key).alias("k")).filter("k is not null").distinct() for df in (expected, found))
    missing = _rows(a.join(b, "k", "left_anti"), "id_missing", F.lit(True), F.col("k"), F.lit(""))
    return missing.unionByName(_rows(b.join(a, "k", "left_anti"), "id_unexpected", F.lit(True), F.col("k"), F.lit("")))


def expected_counts(members: DataFrame, split: str, expected: dict[str, int]) -> DataFrame:
    """Splits whose number of rows isn't the expected one, missing and unexpected splits included."""
    told = members.sparkSession.createDataFrame(list(expected.items()), "split string, wanted bigint")
    counts = members.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    rows = told.join(counts, "split", "full").select("split", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("n", F.lit(0)).alias("n"))
    return _rows(rows, "split_count", F.col("wanted") != F.col("n"), F.col("split"), F.concat_ws(",", "wanted", "n"))


def candidate_ids_equal(bank: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """Records whose candidate ids, in order, aren't the expected ones."""
    ids = F.transform("candidates", lambda c: F.coalesce(c["candidate_id"], F.lit("")))
    wanted = F.array(*map(F.lit, expected)) if expected else F.array().cast("array<string>")
    return _rows(bank, "candidate_ids", ~F.coalesce(ids, F.array().cast("array<string>")).eqNullSafe(wanted), F.col(key), F.array_join(F.coalesce(ids, F.array().cast("array<string>")), ","))


def role_consistent(rows: DataFrame, lookup: DataFrame, key: str, role: str) -> DataFrame:
    """Rows whose role isn't the one that the lookup (key, role) has for their id; an id it lacks has none."""
    told = lookup.select(F.col(key).alias("k"), F.col(role).alias("told")).dropDuplicates(["k"])
    joined = rows.join(told, F.col(key) == F.col("k"), "left")
    return _rows(joined, "role_differs", ~F.col(role).eqNullSafe(F.col("told")), F.col(key), F.concat_ws(",", F.coalesce(role, F.lit("-")), F.coalesce("told", F.lit("-"))))


def forbidden(df: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """Texts that hold a forbidden substring."""
    return reduce(DataFrame.unionByName, (_rows(df, "forbidden_text", F.col(text).contains(w), F.col(key), F.lit(w)) for w in words))


def unclosed_thoughts(df: DataFrame, key: Column, text: str) -> DataFrame:
    return _rows(df, "unclosed_think", F.col(text).contains("<think>") & ~F.col(text).contains("</think>"), key, F.lit(""))


def require_none(violations: DataFrame, most: int = 5) -> None:
    """Raise on the first few violations."""
    rows = violations.limit(most).collect()
    if rows:
        raise ValueError("; ".join(f"{r['check']} {r['key']} {r['detail']}" for r in rows))
