"""Agreement of two scored banks, overall and per candidate in one pass of grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.functions.num import pearson, ratio, six
from judgelake.operators.metrics import class_figures, question_figures, spearman
from judgelake.runtime import Stage


def keyed(bank: DataFrame) -> DataFrame:
    """(question_id, candidate_id, items, weights, failures, score) of each candidate; of repeated keys the last one, by
    record and place, counts. Items are whole numbers: what is between them is cut off. Only the figures are shuffled."""
    rows = bank.select("record_id", "question_id", F.posexplode("candidates").alias("pos", "c")).filter("c.candidate_id is not null and question_id is not null")
    r = F.col("c.reward_result")
    value = F.struct(
        F.transform(r["criterion_scores"], lambda s: s.cast("int")).alias("items"), r["criterion_weights"].alias("weights"),
        F.coalesce(r["num_parse_failures"], F.lit(0).cast("bigint")).alias("failures"), F.col("c.score").alias("score"),
    )
    last = rows.groupBy("question_id", F.col("c.candidate_id").alias("candidate_id")).agg(F.max_by(value, F.struct("record_id", "pos")).alias("v"))
    return last.select("question_id", "candidate_id", "v.*")


def shared_pairs(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Inner join of two scored banks on (question_id, candidate_id); no common key is an error.

    A pair is parsed if both sides have scores without nulls and failures, of equal length, as many as the reference
    has weights, and both have a total.
    """
    side = lambda df, p: keyed(df).select("question_id", "candidate_id", *[F.col(c).alias(f"{p}_{c}") for c in ("items", "weights", "failures", "score")])
    rows = side(reference, "ref").join(side(candidate, "cand"), ["question_id", "candidate_id"])
    n = F.size("ref_items")
    clean = (n > 0) & (n == F.size("cand_items")) & (n == F.size("ref_weights")) & (F.col("ref_failures") == 0) & (F.col("cand_failures") == 0)
    clean &= ~F.exists("ref_items", lambda x: x.isNull()) & ~F.exists("cand_items", lambda x: x.isNull()) & F.col("ref_score").isNotNull() & F.col("cand_score").isNotNull()
    # Kept, since sums, ranks and orders each read the pairs; they hold figures only.
    out = Stage(reference.sparkSession).keep(rows.withColumn("parsed", F.coalesce(clean, F.lit(False))))
    if out.limit(1).count() == 0:
        raise ValueError("the banks have no (question_id, candidate_id) in common")
    return out


def alignment(pairs: DataFrame) -> DataFrame:
    """One row for each candidate_id and one, with null, for all. Weights are the reference's, by absolute value."""
    zipped = F.arrays_zip(F.col("ref_items").alias("r"), F.col("cand_items").alias("c"), F.coalesce("ref_weights", F.expr("array()").cast("array<double>")).alias("w"))
    w = lambda x: F.coalesce(x["w"], F.lit(1.0))
    total = lambda keep: F.aggregate(F.filter(zipped, keep), F.lit(0.0), lambda s, x: s + F.abs(w(x)))
    count = lambda keep: F.size(F.filter(zipped, keep))
    equal = lambda x: x["r"] == x["c"]
    cells = {
        "items": count(lambda x: F.lit(True)), "same": count(equal), "pos": count(lambda x: w(x) > 0), "pos_same": count(lambda x: (w(x) > 0) & equal(x)),
        "pen": count(lambda x: w(x) < 0), "pen_same": count(lambda x: (w(x) < 0) & equal(x)), "wt": total(lambda x: F.lit(True)), "wt_same": total(equal),
        "wt_pos": total(lambda x: w(x) > 0), "wt_pos_same": total(lambda x: (w(x) > 0) & equal(x)), "wt_pen": total(lambda x: w(x) < 0), "wt_pen_same": total(lambda x: (w(x) < 0) & equal(x)),
        "tp": count(lambda x: (x["r"] == 1) & (x["c"] == 1)), "fp": count(lambda x: (x["r"] == 0) & (x["c"] == 1)),
        "fn": count(lambda x: (x["r"] == 1) & (x["c"] == 0)), "tn": count(lambda x: (x["r"] == 0) & (x["c"] == 0)),
    }
    judged = lambda c: F.when(F.size(c) > 0, F.size(c)).otherwise(1)
    rows = pairs.select(
        "candidate_id", "parsed", "ref_failures", "cand_failures", judged(F.col("ref_items")).alias("ref_judged"), judged(F.col("cand_items")).alias("cand_judged"),
        (F.col("ref_items") == F.col("cand_items")).alias("exact"), "ref_score", "cand_score", *[c.alias(k) for k, c in cells.items()],
    )
    ok = F.col("parsed")
    d = F.col("cand_score") - F.col("ref_score")
    when_ok = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    sums = rows.groupingSets([[], ["candidate_id"]], "candidate_id").agg(
        F.grouping("candidate_id").alias("overall"), F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("k"), F.sum("ref_failures").alias("rf"), F.sum("ref_judged").alias("rj"),
        F.sum("cand_failures").alias("cf"), F.sum("cand_judged").alias("cj"), F.count_if(ok & F.col("exact")).alias("exact_n"),
        *[when_ok(F.col(c)).alias(f"s_{c}") for c in cells], F.count_if(ok & (F.abs(d) <= 1e-12)).alias("score_same"), when_ok(F.abs(d)).alias("abs_d"),
        when_ok(d * d).alias("sq_d"), when_ok(d).alias("sum_d"), F.count_if(ok & (F.abs(d) <= 0.05)).alias("w05"), F.count_if(ok & (F.abs(d) <= 0.10)).alias("w10"),
        when_ok(F.col("ref_score")).alias("ref_sum"), when_ok(F.col("cand_score")).alias("cand_sum"),
        pearson(F.when(ok, F.col("ref_score")), F.when(ok, F.col("cand_score"))).alias("r"),
    )
    s = {c: F.col(f"s_{c}") for c in cells}
    figures = {
        "parse_success_rate": ratio("k", "n"), "reference_parse_success_rate": 1 - ratio("rf", "rj"), "candidate_parse_success_rate": 1 - ratio("cf", "cj"),
        "rule_exact_match_rate": ratio("exact_n", "k"), "rule_hamming_accuracy": ratio(s["same"], s["items"]), "rule_positive_accuracy": ratio(s["pos_same"], s["pos"]),
        "rule_penalty_accuracy": ratio(s["pen_same"], s["pen"]), "rule_weighted_accuracy_abs": ratio(s["wt_same"], s["wt"]),
        "rule_weighted_accuracy_positive": ratio(s["wt_pos_same"], s["wt_pos"]), "rule_weighted_accuracy_penalty_abs": ratio(s["wt_pen_same"], s["wt_pen"]),
        **class_figures(s["tp"], s["fp"], s["fn"], s["tn"]), "score_exact_match_rate": ratio("score_same", "k"), "score_mae": ratio("abs_d", "k"),
        "score_rmse": F.sqrt(ratio("sq_d", "k")), "score_mean_error_bias": ratio("sum_d", "k"), "score_within_0p05_rate": ratio("w05", "k"),
        "score_within_0p10_rate": ratio("w10", "k"), "score_pearson": F.col("r"), "reference_mean_score": ratio("ref_sum", "k"), "candidate_mean_score": ratio("cand_sum", "k"),
    }
    out = sums.select(
        "candidate_id", F.col("overall").cast("bigint").alias("overall"), F.col("n").alias("samples_total"), F.col("k").alias("samples_parse_ok"), (F.col("n") - F.col("k")).alias("samples_parse_failed"),
        s["items"].cast("bigint").alias("criterion_items_total"), *[six(c).alias(k) for k, c in figures.items()],
    )
    read = pairs.filter("parsed").select("candidate_id", F.lit(True).alias("all"), "question_id", "ref_score", "cand_score")
    ranks = spearman(read, "ref_score", "cand_score", "candidate_id").select(F.lit(0).cast("bigint").alias("o"), F.col("candidate_id").alias("c"), "spearman")
    ranks = ranks.unionByName(spearman(read, "ref_score", "cand_score", "all").select(F.lit(1).cast("bigint").alias("o"), F.lit(None).cast("string").alias("c"), "spearman"))
    both = out.join(ranks, (F.col("overall") == F.col("o")) & F.col("candidate_id").eqNullSafe(F.col("c")), "left")
    # Pairs of candidates of one question count over all candidates only.
    order = question_figures(
        read.select("all", "question_id", F.col("candidate_id").alias("answer_id"), F.lit(True).alias("parse_ok"), F.col("ref_score").alias("gold_total_score"), F.col("cand_score").alias("pred_total_score")), "all"
    ).groupBy("all").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairwise_pairs_total"), six(ratio(F.sum("right"), F.sum("pairs"))).alias("pairwise_order_accuracy"))
    both = both.join(F.broadcast(order), (F.col("overall") == 1) & F.col("all"), "left")
    both = both.withColumns({"criterion_item_agreement": F.col("rule_hamming_accuracy"), "score_mean_absolute_error": F.col("score_mae")})  # older names
    return both.withColumn("score_spearman", six(F.coalesce("spearman", F.lit(0.0)))).drop("o", "c", "spearman", "all")
