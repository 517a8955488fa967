"""Agreement of judges with gold labels: one aggregated pass per group, joined with ordering figures.

rows: judged samples (model, question_id, answer_id, parse_ok, num_rules, weight_sum, rule_matches,
weighted_rule_matches, vector_exact, score_exact, gold_total_score, pred_total_score, gold, pred as arrays of 0/1).
Ratios of nothing are 0, so an error rate of nothing is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from judgelake.functions.num import f1, mcc, pearson, ratio, six
from judgelake.runtime import Stage


#: Ranges of probability of a threshold sweep.
SLICES = 4096


def judged(predictions: DataFrame) -> DataFrame:
    """Prediction rows with their vectors as arrays."""
    vector = lambda c: F.from_json(F.nullif(F.trim(F.col(c)), F.lit("")), "array<int>")
    return predictions.withColumn("gold", vector("gold_verdicts")).withColumn("pred", vector("pred_verdicts"))


def confusion(gold: Column, pred: Column) -> dict[str, Column]:
    """Counts of one vector pair by (gold, pred)."""
    both = F.arrays_zip(gold.alias("g"), pred.alias("p"))
    count = lambda g, p: F.coalesce(F.size(F.filter(both, lambda x: (x["g"] == g) & (x["p"] == p))), F.lit(0))
    return {"tp": count(1, 1), "fp": count(0, 1), "fn": count(1, 0), "tn": count(0, 0)}


def class_figures(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    yes_p, yes_r, no_p, no_r = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    return {
        "yes_precision": yes_p, "yes_recall": yes_r, "yes_f1": f1(yes_p, yes_r), "no_precision": no_p, "no_recall": no_r,
        "no_f1": f1(no_p, no_r), "macro_f1": (f1(yes_p, yes_r) + f1(no_p, no_r)) / 2, "balanced_accuracy": (yes_r + no_r) / 2,
        "jaccard_yes": ratio(tp, tp + fp + fn), "mcc": mcc(tp, fp, fn, tn),
    }


def basic_metrics(rows: DataFrame, by: str = "model") -> DataFrame:
    """Parse, rule, class and score figures of each group."""
    ok = F.coalesce(F.col("parse_ok"), F.lit(False))
    each = confusion(F.col("gold"), F.col("pred"))
    when_ok = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    gap = F.col("pred_total_score").cast("double") - F.col("gold_total_score").cast("double")
    sums = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("k"), F.sum("num_rules").alias("rules_all"), F.sum("weight_sum").alias("weights_all"),
        when_ok(F.col("num_rules")).alias("rules"), when_ok(F.col("rule_matches")).alias("hits"), when_ok(F.col("weighted_rule_matches")).alias("whits"),
        when_ok(F.col("weight_sum")).alias("weights"), F.count_if(ok & F.col("vector_exact")).alias("exact"), F.count_if(ok & F.col("score_exact")).alias("same"),
        when_ok((F.col("num_rules") - F.col("rule_matches")) / F.greatest(F.lit(1), F.col("num_rules"))).alias("err"),
        when_ok((F.col("weight_sum") - F.col("weighted_rule_matches")) / F.greatest(F.lit(1), F.col("weight_sum"))).alias("werr"),
        *[when_ok(c).alias(k) for k, c in each.items()],
        when_ok(F.abs(gap)).alias("abs_gap"), when_ok(gap * gap).alias("sq_gap"), when_ok(gap).alias("gap"),
        F.count_if(ok & (F.abs(gap) <= 1)).alias("w1"), F.count_if(ok & (F.abs(gap) <= 2)).alias("w2"),
        pearson(F.when(ok, F.col("gold_total_score")), F.when(ok, F.col("pred_total_score"))).alias("r"),
    )
    n, k = F.col("n"), F.col("k")
    figures = {
        "parse_success_rate": ratio(k, n), "rule_exact_match_rate": ratio("exact", "k"), "rule_exact_match_rate_all_samples": ratio("exact", "n"),
        "rule_hamming_accuracy": ratio("hits", "rules"), "rule_hamming_accuracy_all_samples": ratio("hits", "rules_all"),
        "rule_hamming_error": 1 - ratio("hits", "rules"), "rule_hamming_error_per_sample": ratio("err", "k"),
        "rule_hamming_error_per_sample_all_samples": ratio(F.col("err") + n - k, n), "rule_weighted_accuracy": ratio("whits", "weights"),
        "rule_weighted_accuracy_all_samples": ratio("whits", "weights_all"), "rule_weighted_error": 1 - ratio("whits", "weights"),
        "rule_weighted_error_per_sample": ratio("werr", "k"), "rule_weighted_error_per_sample_all_samples": ratio(F.col("werr") + n - k, n),
        **class_figures(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))),
        "score_exact_match_rate": ratio("same", "k"), "score_exact_match_rate_all_samples": ratio("same", "n"), "score_mae": ratio("abs_gap", "k"),
        "score_rmse": F.sqrt(ratio("sq_gap", "k")), "score_mean_error_bias": ratio("gap", "k"), "score_within_1_rate": ratio("w1", "k"),
        "score_within_1_rate_all_samples": ratio("w1", "n"), "score_within_2_rate": ratio("w2", "k"), "score_within_2_rate_all_samples": ratio("w2", "n"),
        "score_pearson": F.col("r"),
    }
    return sums.select(
        by, n.alias("samples_total"), k.alias("samples_parse_ok"), (n - k).alias("samples_parse_failed"), *[six(c).alias(name) for name, c in figures.items()]
    )


def average_ranks(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, value, rank) with ties at their mean rank. Values are counted first, so a window sorts distinct values only."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(by, value, "c", (F.coalesce(before, F.lit(0)) + (F.col("c") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str, by: str, times: str | None = None) -> DataFrame:
    """(by, spearman): Pearson of average ranks, over counted pairs of values. times: how often each row counts."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(times) if times else F.lit(1)).alias("w"))
    grid = known.groupBy(by, "x", "y").agg(F.sum("w").alias("m"))
    total = lambda c: F.sum("m").over(W.partitionBy(by, c))
    below = lambda c: F.sum("m").over(W.partitionBy(by).orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow)) - total(c)
    ranked = grid.select(by, "m", (below("x") + (total("x") + 1) / 2).alias("rx"), (below("y") + (total("y") + 1) / 2).alias("ry"))
    m, rx, ry = F.col("m"), F.col("rx"), F.col("ry")
    s = ranked.groupBy(by).agg(F.sum(m).alias("n"), F.sum(m * rx).alias("sx"), F.sum(m * ry).alias("sy"), F.sum(m * rx * ry).alias("sxy"), F.sum(m * rx * rx).alias("sxx"), F.sum(m * ry * ry).alias("syy"))
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return s.select(by, ratio(cov, F.sqrt(vx) * F.sqrt(vy)).alias("spearman"))


def score_cells(rows: DataFrame, by: str = "model") -> DataFrame:
    """(by, question_id, answer_id, ok, g, p, m): how often each pair of totals occurs for an answer. Ordering figures and
    rank correlations need nothing else of the rows."""
    ok = F.coalesce(F.col("parse_ok"), F.lit(False)).alias("ok")
    return rows.groupBy(by, "question_id", "answer_id", ok, F.col("gold_total_score").cast("double").alias("g"), F.col("pred_total_score").cast("double").alias("p")).agg(F.count(F.lit(1)).alias("m"))


def question_figures(rows: DataFrame, by: str = "model") -> DataFrame:
    """Per group and question with two rows or more: pairs, pairs in the same order, whether the best and worst sets meet."""
    return figures_of_cells(score_cells(rows, by), by)


#: Distinct pairs of totals of a question that are compared with one another in its row.
FEW_CELLS = 128


def _ordered_few(cells: DataFrame, by: str) -> DataFrame:
    """(by, question_id, ordered): pairs in the same strict order, of questions with few cells: all are compared."""
    c = F.col("cells")
    same = lambda a, b: (a["g"] - b["g"]) * (a["p"] - b["p"]) > 0
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)
    cross = F.transform(c, lambda a, i: total(F.transform(F.slice(c, i + 2, F.size(c)), lambda b: F.when(same(a, b), a["m"] * b["m"]).otherwise(F.lit(0)).cast("bigint"))))
    return cells.groupBy(by, "question_id").agg(F.collect_list(F.struct("g", "p", "m")).alias("cells")).select(by, "question_id", total(cross).alias("ordered"))


def _ordered_many(cells: DataFrame, by: str) -> DataFrame:
    """The same without comparing all cells: two predicted totals differ at one highest bit of their ranks, so at each bit
    the cells with a 1 meet those with a 0 and the same higher bits in running counts by gold total."""
    rank = F.dense_rank().over(W.partitionBy(by, "question_id").orderBy("p")) - 1
    ranked = cells.filter("g is not null and p is not null").withColumn("r", rank)
    bits = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("n_cells"), F.lit(1)))).cast("int"))
    each = ranked.select(by, "question_id", "g", "m", "r", F.explode(bits).alias("bit"))
    each = each.select(by, "question_id", "g", "m", "bit", F.expr("shiftright(r, bit + 1)").alias("head"), (F.expr("shiftright(r, bit)") % 2).alias("high"))
    counts = each.groupBy(by, "question_id", "bit", "head", "g").agg(F.sum(F.when(F.col("high") == 0, F.col("m")).otherwise(0)).alias("low"), F.sum(F.when(F.col("high") == 1, F.col("m")).otherwise(0)).alias("up"))
    below = F.coalesce(F.sum("low").over(W.partitionBy(by, "question_id", "bit", "head").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("below", below).groupBy(by, "question_id").agg(F.sum(F.col("below") * F.col("up")).alias("ordered"))


def figures_of_cells(counted: DataFrame, by: str = "model", few: int = FEW_CELLS) -> DataFrame:
    """question_figures out of score_cells.

    Pairs come from counts of (gold, pred) values, not from a self join: a question's rows, however many, are first
    counted by value, and only distinct values are compared, many of them by running counts.
    """
    whole = counted.groupBy(by, "question_id").agg(F.sum("m").alias("n_all"), F.bool_and("ok").alias("full"))
    whole = whole.filter("n_all >= 2")
    read = counted.filter("ok").select(by, "question_id", "answer_id", "g", "p", "m")
    cells = read.groupBy(by, "question_id", "g", "p").agg(F.sum("m").alias("m"))
    floor_pairs = lambda n: F.floor(n * (n - 1) / 2).cast("bigint")
    per = cells.groupBy(by, "question_id").agg(
        F.sum("m").alias("n_ok"), F.sum(floor_pairs(F.col("m"))).alias("within"), F.count(F.lit(1)).alias("n_cells"), *[f(x).alias(f"{x}_{name}") for x in "gp" for name, f in (("max", F.max), ("min", F.min))]
    ).filter("n_ok >= 2")
    sized = cells.join(per.select(by, "question_id", "n_cells"), [by, "question_id"])
    ordered = _ordered_few(sized.filter(F.col("n_cells") <= few), by).unionByName(_ordered_many(sized.filter(F.col("n_cells") > few), by))
    # The best and worst sets meet if one answer is in both; answers are reduced to four marks each, no set is collected.
    marks = read.join(per.select(by, "question_id", "g_max", "p_max", "g_min", "p_min"), [by, "question_id"]).groupBy(by, "question_id", "answer_id").agg(
        *[F.max(F.when(F.col(x) == F.col(f"{x}_{e}"), 1).otherwise(0)).alias(f"{x}{e}") for x in "gp" for e in ("max", "min")]
    )
    edges = marks.groupBy(by, "question_id").agg(F.bool_or((F.col("gmax") == 1) & (F.col("pmax") == 1)).alias("top"), F.bool_or((F.col("gmin") == 1) & (F.col("pmin") == 1)).alias("bottom"))
    right = (F.coalesce("ordered", F.lit(0)) + F.col("within")).cast("bigint").alias("right")
    per = per.join(ordered, [by, "question_id"], "left").select(by, "question_id", floor_pairs(F.col("n_ok")).alias("pairs"), right).join(edges, [by, "question_id"])
    joined = whole.join(per, [by, "question_id"], "left")
    return joined.withColumn("pairs_all", F.floor(F.col("n_all") * (F.col("n_all") - 1) / 2).cast("bigint"))


def ordering_metrics(rows: DataFrame, policy: str = "partial", by: str = "model") -> DataFrame:
    """Pair, top and bottom agreement. policy "full": only fully parsed questions count for the *_all_questions figures."""
    if policy not in ("partial", "full"):
        raise ValueError("policy is partial or full")
    return _ordering(question_figures(rows, by), policy, by)


def _ordering(q: DataFrame, policy: str, by: str) -> DataFrame:
    judged_ = F.col("pairs").isNotNull()
    counted = judged_ if policy == "partial" else judged_ & F.col("full")
    s = q.groupBy(by).agg(
        F.count(F.lit(1)).alias("q_all"), F.count_if(judged_).alias("q"), F.count_if("full").alias("q_full"), F.sum("pairs_all").alias("pairs_all"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"),
        F.count_if(F.col("top")).alias("top"), F.count_if(F.col("bottom")).alias("bottom"),
        F.count_if(F.col("top") & counted).alias("top_all"), F.count_if(F.col("bottom") & counted).alias("bottom_all"),
    )
    figures = {
        "pairwise_order_accuracy": ratio("right", "pairs"), "pairwise_order_accuracy_all_pairs": ratio("right", "pairs_all"),
        "pairwise_parseable_coverage": ratio("pairs", "pairs_all"), "top1_set_accuracy": ratio("top", "q"),
        "top1_set_accuracy_all_questions": ratio("top_all", "q_all"), "bottom1_set_accuracy": ratio("bottom", "q"),
        "bottom1_set_accuracy_all_questions": ratio("bottom_all", "q_all"), "question_parseable_coverage": ratio("q", "q_all"),
        "question_full_parse_rate": ratio("q_full", "q_all"),
    }
    return s.select(
        by, F.col("q").alias("questions_with_parseable_answers"), F.col("q_all").alias("questions_total_with_multiple_answers"),
        F.col("q_full").alias("questions_fully_parseable"), *[six(c).alias(k) for k, c in figures.items()],
    )


def metric_suite(rows: DataFrame, policy: str = "partial", by: str = "model") -> DataFrame:
    """All figures of each judge in one row: one pass for sums, one for the cells, which are kept for ranks and orders."""
    if policy not in ("partial", "full"):
        raise ValueError("policy is partial or full")
    cells = Stage(rows.sparkSession).keep(score_cells(rows, by))
    ranks = spearman(cells.filter("ok"), "g", "p", by, "m")
    order = _ordering(figures_of_cells(cells, by), policy, by)
    joined = basic_metrics(rows, by).join(ranks, by, "left").join(order, by, "left")
    return joined.withColumn("score_spearman", six(F.coalesce("spearman", F.lit(0.0)))).drop("spearman").na.fill(0)


def calibration_bins(items: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of equal bins; the last one is closed."""
    place = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return items.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"), F.avg(label).alias("accuracy"))


def calibration_error(items: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    cells = calibration_bins(items, prob, label, bins)
    return cells.agg(six(ratio(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n"))).alias("ece"), F.sum("n").alias("n"))


def threshold_sweep(items: DataFrame, prob: str, label: str) -> DataFrame:
    """Confusion counts at 0.05, 0.06, ..., 0.95 and every observed probability as threshold.

    Probabilities are counted first; running sums from the top give every threshold in one sort of distinct values.
    """
    counted = items.select(F.col(prob).alias("threshold"), F.col(label).alias("pos"), F.lit(1).alias("m"))
    grid = items.sparkSession.createDataFrame([(k / 100.0, 0, 0) for k in range(5, 96)], "threshold double, pos bigint, m int")
    cells = counted.unionByName(grid).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("m").alias("m"))
    # Sums of SLICES ranges of probability give each range its start; within a range a window sorts on its own.
    cells = cells.withColumn("slice", F.least(F.greatest(F.floor(F.col("threshold") * SLICES), F.lit(0)), F.lit(SLICES)).cast("int"))
    slices = cells.groupBy("slice").agg(F.sum("pos").alias("sp"), F.sum("m").alias("sm"))
    above = W.orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    slices = slices.select(
        "slice", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("sm").over(above), F.lit(0)).alias("m0"),
        F.sum("sp").over(every).alias("all_pos"), F.sum("sm").over(every).alias("all_m"),
    )
    down = W.partitionBy("slice").orderBy(F.col("threshold").desc()).rowsBetween(W.unboundedPreceding, 0)
    run = cells.join(slices, "slice").select(
        "threshold", "all_pos", "all_m", (F.col("p0") + F.sum("pos").over(down)).alias("tp"), (F.col("m0") + F.sum("m").over(down)).alias("called")
    )
    out = run.select(
        "threshold", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"),
        (F.col("all_m") - F.col("all_pos") - F.col("called") + F.col("tp")).alias("tn"),
    )
    figures = class_figures(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    accuracy = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return out.withColumns({k: figures[k] for k in ("macro_f1", "balanced_accuracy")} | {"accuracy": accuracy})


def best_threshold(sweep: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """The threshold with the best metric, then balanced accuracy, then accuracy; of equal ones 0.5, then the lowest."""
    return sweep.orderBy(F.desc(metric), F.desc("balanced_accuracy"), F.desc("accuracy"), F.col("threshold") != 0.5, "threshold").limit(1)


def best_layer(sweeps: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Of several layers' best thresholds (layer, threshold, figures, loss) the best: metric, balanced accuracy and
    accuracy downward, loss and layer upward."""
    return sweeps.orderBy(F.desc(metric), F.desc("balanced_accuracy"), F.desc("accuracy"), "loss", "layer").limit(1)
