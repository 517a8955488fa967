"""Queries over judges' predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from judgelake.functions import parse
from judgelake.functions import text as X
from judgelake.functions.num import ratio, six
from judgelake.operators import audit, flatten, metrics
from judgelake.plans.verdict_sql import first_shape, passes, reason_sql
from judgelake.runtime import read_table

PARSED = "model string, sample_id string, num_rules bigint, raw_output string"
BENCH_RULES = "record_id bigint, question_id string, refined_rubric array<struct<type:string>>"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.judged(read_table(spark, d, "predictions"))


def metric_suite(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_suite(_rows(spark, d))


def metric_suite_full_policy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ordering_metrics(_rows(spark, d), "full")


def pairwise_order(spark: SparkSession, d: str) -> DataFrame:
    q = metrics.question_figures(_rows(spark, d))
    return q.select("model", "question_id", "n_all", "pairs_all", "pairs", "right")


def top_bottom_sets(spark: SparkSession, d: str) -> DataFrame:
    return metrics.question_figures(_rows(spark, d)).filter("pairs is not null").select("model", "question_id", "top", "bottom")


def average_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_ranks(_rows(spark, d).filter("parse_ok"), "pred_total_score", "model")


def rule_type_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by hard and soft rules: predictions with the rules of their question."""
    bench = flatten.first_of_each(read_table(spark, d, "bench").filter("question_id is not null and size(refined_rubric) > 0"), ["question_id"], ["record_id"])
    rules = bench.select("question_id", F.transform("refined_rubric", lambda r: r["type"]).alias("types"))
    rows = _rows(spark, d).join(rules, "question_id").filter(F.size("types") == F.size("gold"))
    # Counts stay within the row; no row becomes one per rule.
    each = F.arrays_zip(F.col("types").alias("t"), F.col("gold").alias("g"), F.coalesce("pred", F.expr("array()").cast("array<int>")).alias("p"))
    count = lambda t, same: F.size(F.filter(each, lambda x: (x["t"] == t) & (F.coalesce(x["g"] == x["p"], F.lit(False)) if same else F.lit(True))))
    ok = F.coalesce(F.col("parse_ok"), F.lit(False))
    sums = rows.groupBy("model").agg(*[F.sum(count(t, same)).alias(f"{t}_{same}") for t in ("hard", "soft") for same in (True, False)], *[F.sum(F.when(ok, count(t, False)).otherwise(0)).alias(f"{t}_ok") for t in ("hard", "soft")])
    figures = [six(ratio(f"{t}_True", f"{t}_False")).alias(f"{t}_accuracy_all") for t in ("hard", "soft")] + [six(ratio(f"{t}_True", f"{t}_ok")).alias(f"{t}_accuracy_parsed") for t in ("hard", "soft")]
    return sums.select("model", *figures)


def verdict_parse_strict(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "predictions", PARSED)
    made = parse.strict(F.col("raw_output"), F.col("num_rules").cast("int"))
    return rows.select("model", "sample_id", F.col("raw_output").isNull().alias("no_output"), X.verdict_letters(made).alias("verdicts"))


def verdict_parse_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts as scoring reads them, and the pass that read them."""
    rows = read_table(spark, d, "predictions", PARSED)
    text, n = F.col("raw_output"), F.col("num_rules").cast("int")
    return rows.select("model", "sample_id", X.verdict_letters(parse.relaxed(text, n)).alias("verdicts"), parse.source(text, n).alias("source"))


def verdict_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Outputs whose lines name the rules one after the other."""
    rows = read_table(spark, d, "predictions", PARSED)
    made = parse.sequential(F.col("raw_output"), F.col("num_rules").cast("int"))
    return rows.select("model", "sample_id", F.col("raw_output").isNull().alias("no_output"), X.verdict_letters(made).alias("verdicts"))


def prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prediction rows made anew from the raw output: total, matches and exactness; unread outputs have no total.

    Weights are those of the rules of the question's rubric; where the bench lacks it, or it has another number of
    rules, each rule weighs 1.
    """
    rows = metrics.judged(read_table(spark, d, "predictions", f"{PARSED}, question_id string, gold_verdicts string, pred_verdicts string")).filter("gold is not null")
    rubrics = flatten.first_of_each(
        read_table(spark, d, "bench", BENCH_RULES).filter("question_id is not null and size(refined_rubric) > 0").select("question_id", "record_id", flatten.rule_weights(F.col("refined_rubric")).alias("weights")),
        ["question_id"], ["record_id"],
    ).drop("record_id")
    rows = rows.join(rubrics, "question_id", "left")
    rows = rows.withColumn("weights", F.when(F.size("weights") == F.size("gold"), F.col("weights")).otherwise(F.transform("gold", lambda g: F.lit(1))))
    rows = rows.withColumn("made", parse.strict(F.col("raw_output"), F.size("gold"))).withColumn("ok", F.col("made").isNotNull())
    same = F.zip_with("gold", "made", lambda a, b: F.when(a == b, 1).otherwise(0))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "model", "sample_id", "ok", F.when(F.col("ok"), flatten.dot(F.col("made"), F.col("weights"))).alias("total"),
        F.when(F.col("ok"), flatten.dot(same, F.transform("gold", lambda g: F.lit(1)))).otherwise(zero).alias("matches"),
        F.when(F.col("ok"), flatten.dot(same, F.col("weights"))).otherwise(zero).alias("weighted_matches"),
        F.coalesce(F.col("gold") == F.col("made"), F.lit(False)).alias("exact"),
    )


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "predictions", f"{PARSED}, parse_ok boolean").filter(~F.coalesce("parse_ok", F.lit(False)))
    return rows.select("model", parse.failure(F.col("raw_output"), F.col("num_rules").cast("int"))["reason"].alias("reason"))


def parse_failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Unread outputs by reason, overall and by judge, in one pass of grouping sets."""
    counts = _reasons(spark, d).groupingSets([["reason"], ["model", "reason"]], "model", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("model", "reason", "n")


def top_failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest reasons of each judge, by number and then name."""
    counts = parse_failure_reasons(spark, d).filter("model is not null")
    place = F.row_number().over(W.partitionBy("model").orderBy(F.desc("n"), "reason"))
    top = counts.withColumn("place", place).filter("place <= 3")
    return top.groupBy("model").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "reason")))["reason"], ",").alias("reasons"))


def vector_letters(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stored letters differ from their vectors'."""
    rows = _rows(spark, d).withColumns({"g": X.verdict_letters(F.col("gold")), "p": X.verdict_letters(F.col("pred"))})
    return rows.groupBy((F.col("g") == F.col("gold_vector_yn")).alias("gold_same"), (F.col("p") == F.coalesce("pred_vector_yn", F.lit(""))).alias("pred_same")).agg(F.count(F.lit(1)).alias("n"))


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "predictions")
    return rows.select("model", "sample_id", X.first_line(F.col("raw_output")).alias("first_line"))


def audit_agreement(spark: SparkSession, d: str) -> DataFrame:
    """One judge's verdicts as an audit of the gold labels: agreement per rule place and in all."""
    rows = _rows(spark, d).filter(F.size("pred") == F.size("gold"))
    each = rows.select(F.posexplode(F.arrays_zip(F.col("gold").alias("g"), F.col("pred").alias("p"))).alias("rule", "x"))
    sums = each.groupBy("rule", F.col("x.g").alias("g"), F.col("x.p").alias("p")).agg(F.count(F.lit(1)).alias("m"))  # a few cells
    out = sums.groupingSets([[], ["rule"]], "rule").agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("g") == F.col("p"), F.col("m")).otherwise(0)).alias("same"),
        F.sum(F.when((F.col("g") == 1) & (F.col("p") == 0), F.col("m")).otherwise(0)).alias("yes_no"),
        F.sum(F.when((F.col("g") == 0) & (F.col("p") == 1), F.col("m")).otherwise(0)).alias("no_yes"),
    )
    return out.select(F.col("rule").cast("bigint").alias("rule"), "n", "same", "yes_no", "no_yes", six(ratio("same", "n")).alias("agreement"))


def audit_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Preference of questions with exactly two parsed answers of a judge: agreement without ties, ties of each side."""
    rows = read_table(spark, d, "predictions", "model string, question_id string, answer_id bigint, gold_total_score bigint, pred_total_score double, parse_ok boolean").filter("parse_ok")
    items = rows.select(
        "model", F.col("question_id").alias("pair"), F.col("answer_id").alias("item"), F.lit(True).alias("complete"), F.col("pred_total_score").alias("judge_score"), F.col("gold_total_score").cast("double").alias("human_score")
    )
    return audit.preferences(items, "model")


def judge_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Judges by family, kind and checkpoint read from their labels, unknown kinds last, with their mean points."""
    base = F.regexp_replace("model", r"_(?:seed\d+_)?(?:dev|test|heldout)\d+$", "")
    family = F.regexp_extract(base, r"^judge-(.+?)-(?:probe|gen|logprob|ck\d+)$", 1)
    kind = F.regexp_extract(base, r"-(probe|gen|logprob|ck)\d*$", 1)
    order = F.coalesce(*[F.when(kind == k, i) for i, k in enumerate(("probe", "logprob", "gen", "ck"))], F.lit(999))
    rows = read_table(spark, d, "predictions").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("gold_total_score").alias("points"))
    return rows.select("model", family.alias("family"), kind.alias("kind"), order.cast("bigint").alias("kind_rank"), "n", six(ratio("points", "n")).alias("mean_points"))


def dedup_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows per judge: rows, distinct rows, samples."""
    rows = read_table(spark, d, "predictions")
    per = rows.groupBy("model", "sample_id", F.coalesce("raw_output", F.lit("")).alias("o")).agg(F.count(F.lit(1)).alias("m"))
    per = per.groupBy("model", "sample_id").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("k"))
    return per.groupBy("model").agg(F.sum("m").alias("rows"), F.sum("k").alias("distinct_rows"), F.count(F.lit(1)).alias("samples"))


def semi_anti_ids(spark: SparkSession, d: str) -> DataFrame:
    """Judged questions that the bench has and that it lacks."""
    judged = read_table(spark, d, "predictions").select("question_id").distinct()
    known = read_table(spark, d, "bench").select("question_id")
    return judged.join(known, "question_id", "left_semi").withColumn("known", F.lit(True)).unionByName(
        judged.join(known, "question_id", "left_anti").withColumn("known", F.lit(False))
    )


QUERIES = {
    f.__name__: f
    for f in (
        metric_suite, metric_suite_full_policy, pairwise_order, top_bottom_sets, average_rank, rule_type_accuracy, verdict_parse_strict, verdict_parse_relaxed, verdict_sequences, prediction_rows,
        parse_failure_reasons, top_failure_reasons, vector_letters, first_lines, audit_agreement, audit_pairwise, judge_ranking, dedup_predictions, semi_anti_ids,
    )
}

_P = """p AS (SELECT *, CASE WHEN trim(gold_verdicts) <> '' THEN CAST(gold_verdicts AS INT[]) END AS gold, CASE WHEN trim(pred_verdicts) <> '' THEN CAST(pred_verdicts AS INT[]) END AS pred,
        coalesce(parse_ok, false) AS ok, CAST(pred_total_score AS DOUBLE) - gold_total_score AS d FROM predictions)"""
_PAIRS = """
    k AS MATERIALIZED (SELECT model, question_id, answer_id, gold_total_score AS g, pred_total_score AS q, row_number() OVER () AS i FROM p WHERE ok),
    pr AS (SELECT a.model, a.question_id, count(*) AS pairs, CAST(sum(CASE WHEN sign(a.g - b.g) = sign(a.q - b.q) THEN 1 ELSE 0 END) AS BIGINT) AS rights
           FROM k a JOIN k b ON a.model = b.model AND a.question_id = b.question_id AND a.i < b.i GROUP BY 1, 2),
    m AS (SELECT model, question_id, max(g) AS g1, max(q) AS q1, min(g) AS g0, min(q) AS q0, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 2),
    e AS (SELECT m.model, m.question_id, len(list_intersect(list(answer_id) FILTER (k.g = g1), list(answer_id) FILTER (k.q = q1))) > 0 AS t,
                 len(list_intersect(list(answer_id) FILTER (k.g = g0), list(answer_id) FILTER (k.q = q0))) > 0 AS b FROM m JOIN k USING (model, question_id) GROUP BY 1, 2),
    w AS (SELECT model, question_id, count(*) AS n_all, bool_and(ok) AS f, count(*) * (count(*) - 1) // 2 AS pairs_all FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
    q AS (SELECT w.*, pairs, rights, t, b FROM w LEFT JOIN pr USING (model, question_id) LEFT JOIN e USING (model, question_id))"""


def _ordering(counted: str) -> str:
    r = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END, 6)"
    return f"""
    oq AS (SELECT model, count(*) AS q_all, count(pairs) AS q1, count(*) FILTER (f) AS q_full, sum(pairs_all) AS pa, coalesce(sum(pairs), 0) AS pp, coalesce(sum(rights), 0) AS rr,
             count(*) FILTER (t) AS tt, count(*) FILTER (b) AS bb, count(*) FILTER (t AND {counted}) AS ta, count(*) FILTER (b AND {counted}) AS ba FROM q GROUP BY 1),
    o AS (SELECT model, q1 AS questions_with_parseable_answers, q_all AS questions_total_with_multiple_answers, q_full AS questions_fully_parseable,
             {r('rr', 'pp')} AS pairwise_order_accuracy, {r('rr', 'pa')} AS pairwise_order_accuracy_all_pairs, {r('pp', 'pa')} AS pairwise_parseable_coverage,
             {r('tt', 'q1')} AS top1_set_accuracy, {r('ta', 'q_all')} AS top1_set_accuracy_all_questions, {r('bb', 'q1')} AS bottom1_set_accuracy,
             {r('ba', 'q_all')} AS bottom1_set_accuracy_all_questions, {r('q1', 'q_all')} AS question_parseable_coverage, {r('q_full', 'q_all')} AS question_full_parse_rate FROM oq)"""


def _suite() -> str:
    r = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"
    six_ = lambda x, name: f"round({x}, 6) AS {name}"
    cell = lambda g, p: f"coalesce(sum(len(list_filter(range(1, len(gold) + 1), lambda i: gold[i] = {g} AND pred[i] = {p}))) FILTER (ok), 0)"
    f = lambda a, b: f"CASE WHEN {a} + {b} = 0 THEN 0.0 ELSE 2 * {a} * {b} / ({a} + {b}) END"
    return f"""WITH {_P}, {_PAIRS}, {_ordering('true')},
    s AS (SELECT model, count(*) AS n, count(*) FILTER (ok) AS k, sum(num_rules) AS ra, sum(weight_sum) AS wa, coalesce(sum(num_rules) FILTER (ok), 0) AS r, coalesce(sum(rule_matches) FILTER (ok), 0) AS h,
            coalesce(sum(weighted_rule_matches) FILTER (ok), 0) AS wh, coalesce(sum(weight_sum) FILTER (ok), 0) AS wt, count(*) FILTER (ok AND vector_exact) AS ex, count(*) FILTER (ok AND score_exact) AS se,
            coalesce(sum((num_rules - rule_matches) / CAST(greatest(1, num_rules) AS DOUBLE)) FILTER (ok), 0) AS e1, coalesce(sum((weight_sum - weighted_rule_matches) / CAST(greatest(1, weight_sum) AS DOUBLE)) FILTER (ok), 0) AS e2,
            CAST({cell(1, 1)} AS DOUBLE) AS tp, CAST({cell(0, 1)} AS DOUBLE) AS fp, CAST({cell(1, 0)} AS DOUBLE) AS fn, CAST({cell(0, 0)} AS DOUBLE) AS tn,
            coalesce(sum(abs(d)) FILTER (ok), 0) AS ad, coalesce(sum(d * d) FILTER (ok), 0) AS sd, coalesce(sum(d) FILTER (ok), 0) AS sg, count(*) FILTER (ok AND abs(d) <= 1) AS w1, count(*) FILTER (ok AND abs(d) <= 2) AS w2,
            coalesce(CASE WHEN stddev_pop(gold_total_score) FILTER (ok) * stddev_pop(pred_total_score) FILTER (ok) > 0 THEN covar_pop(gold_total_score, pred_total_score) FILTER (ok) / (stddev_pop(gold_total_score) FILTER (ok) * stddev_pop(pred_total_score) FILTER (ok)) END, 0.0) AS rho FROM p GROUP BY 1),
    c AS (SELECT *, {r('tp', '(tp + fp)')} AS yp, {r('tp', '(tp + fn)')} AS yr, {r('tn', '(tn + fn)')} AS np, {r('tn', '(tn + fp)')} AS nr FROM s),
    x AS (SELECT *, {f('yp', 'yr')} AS yf, {f('np', 'nr')} AS nf FROM c),
    rk AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY gold_total_score) + (count(*) OVER (PARTITION BY model, gold_total_score) - 1) / 2.0 AS a,
             rank() OVER (PARTITION BY model ORDER BY pred_total_score) + (count(*) OVER (PARTITION BY model, pred_total_score) - 1) / 2.0 AS b FROM p WHERE ok AND pred_total_score IS NOT NULL),
    sp AS (SELECT model, coalesce(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 0.0) AS spear FROM rk GROUP BY 1)
    SELECT x.model, n AS samples_total, k AS samples_parse_ok, n - k AS samples_parse_failed, {', '.join(six_(e, name) for e, name in (
        (r('k', 'n'), 'parse_success_rate'), (r('ex', 'k'), 'rule_exact_match_rate'), (r('ex', 'n'), 'rule_exact_match_rate_all_samples'), (r('h', 'r'), 'rule_hamming_accuracy'),
        (r('h', 'ra'), 'rule_hamming_accuracy_all_samples'), (f"1 - {r('h', 'r')}", 'rule_hamming_error'), (r('e1', 'k'), 'rule_hamming_error_per_sample'),
        (r('(e1 + n - k)', 'n'), 'rule_hamming_error_per_sample_all_samples'), (r('wh', 'wt'), 'rule_weighted_accuracy'), (r('wh', 'wa'), 'rule_weighted_accuracy_all_samples'),
        (f"1 - {r('wh', 'wt')}", 'rule_weighted_error'), (r('e2', 'k'), 'rule_weighted_error_per_sample'), (r('(e2 + n - k)', 'n'), 'rule_weighted_error_per_sample_all_samples'),
        ('yp', 'yes_precision'), ('yr', 'yes_recall'), ('yf', 'yes_f1'), ('np', 'no_precision'), ('nr', 'no_recall'), ('nf', 'no_f1'), ('(yf + nf) / 2', 'macro_f1'),
        ('(yr + nr) / 2', 'balanced_accuracy'), (r('tp', '(tp + fp + fn)'), 'jaccard_yes'),
        ('CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END', 'mcc'),
        (r('se', 'k'), 'score_exact_match_rate'), (r('se', 'n'), 'score_exact_match_rate_all_samples'), (r('ad', 'k'), 'score_mae'), (f"sqrt({r('sd', 'k')})", 'score_rmse'),
        (r('sg', 'k'), 'score_mean_error_bias'), (r('w1', 'k'), 'score_within_1_rate'), (r('w1', 'n'), 'score_within_1_rate_all_samples'), (r('w2', 'k'), 'score_within_2_rate'),
        (r('w2', 'n'), 'score_within_2_rate_all_samples'), ('rho', 'score_pearson'), ('coalesce(spear, 0.0)', 'score_spearman')))}, {', '.join(f'coalesce(o.{c}, 0) AS {c}' for c in (
        'questions_with_parseable_answers', 'questions_total_with_multiple_answers', 'questions_fully_parseable', 'pairwise_order_accuracy', 'pairwise_order_accuracy_all_pairs', 'pairwise_parseable_coverage',
        'top1_set_accuracy', 'top1_set_accuracy_all_questions', 'bottom1_set_accuracy', 'bottom1_set_accuracy_all_questions', 'question_parseable_coverage', 'question_full_parse_rate'))}
    FROM x LEFT JOIN sp USING (model) LEFT JOIN o USING (model)"""


_LINES = """base AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM predictions),
    l AS (SELECT id, list_filter(list_transform(string_split_regex(coalesce(raw_output, ''), '[\\n\\r]'), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '') AS ls FROM base),
    l2 AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM l),
    hit AS (SELECT id, ln, TRY_CAST(regexp_extract(line, '(?i)^Rule\\s*(\\d+)\\s*:\\s*.*?\\bVerdict\\s*:\\s*(Yes|No|Y|N)$', 1) AS INT) AS rule,
              CASE WHEN lower(regexp_extract(line, '(?i)^Rule\\s*(\\d+)\\s*:\\s*.*?\\bVerdict\\s*:\\s*(Yes|No|Y|N)$', 2)) IN ('yes', 'y') THEN 1 ELSE 0 END AS v FROM l2),
    lastv AS (SELECT id, rule, arg_max(v, ln) AS v FROM hit WHERE rule IS NOT NULL GROUP BY 1, 2),
    vec AS (SELECT id, count(*) AS n, min(rule) AS lo, max(rule) AS hi, list(v ORDER BY rule) AS vs FROM lastv GROUP BY 1),
    made AS (SELECT base.*, CASE WHEN vec.n = base.num_rules AND lo = 1 AND hi = base.num_rules THEN vs END AS vs FROM base LEFT JOIN vec USING (id))"""

_REASONS = f"""w AS (SELECT model, {reason_sql('raw_output', 'num_rules')} AS reason FROM predictions WHERE NOT coalesce(parse_ok, false))"""

ORACLE = {
    "parse_failure_reasons": f"WITH {_REASONS} SELECT model, reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((reason), (model, reason))",
    "top_failure_reasons": f"""WITH {_REASONS}, c AS (SELECT model, reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, reason) AS k FROM c) SELECT model, string_agg(reason, ',' ORDER BY k) AS reasons FROM t WHERE k <= 3 GROUP BY 1""",
    "metric_suite": _suite(),
    "metric_suite_full_policy": f"WITH {_P}, {_PAIRS}, {_ordering('f')} SELECT * FROM o",
    "pairwise_order": f"WITH {_P}, {_PAIRS} SELECT model, question_id, n_all, pairs_all, pairs, rights AS \"right\" FROM q",
    "top_bottom_sets": f"WITH {_P}, {_PAIRS} SELECT model, question_id, t AS top, b AS bottom FROM q WHERE pairs IS NOT NULL",
    "average_rank": f"""WITH {_P} SELECT model, pred_total_score, count(*) AS c, min(r) + (count(*) - 1) / 2.0 AS rank FROM
        (SELECT model, pred_total_score, row_number() OVER (PARTITION BY model ORDER BY pred_total_score) AS r FROM p WHERE ok) GROUP BY 1, 2""",
    "rule_type_accuracy": f"""WITH {_P}, b AS (SELECT question_id, arg_min(refined_rubric, record_id) AS rb FROM bench WHERE question_id IS NOT NULL AND len(refined_rubric) > 0 GROUP BY 1),
        j AS (SELECT model, ok, gold, pred, rb FROM p JOIN b USING (question_id) WHERE len(rb) = len(gold)),
        u AS (SELECT model, ok, rb[i].type AS t, coalesce(gold[i] = pred[i], false) AS same FROM (SELECT *, unnest(range(1, len(gold) + 1)) AS i FROM j))
        SELECT model, {', '.join(f"round(CASE WHEN count(*) FILTER (t = '{t}'{c}) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (t = '{t}' AND same) AS DOUBLE) / count(*) FILTER (t = '{t}'{c}) END, 6) AS {t}_accuracy_{n}" for n, c in (('all', ''), ('parsed', ' AND ok')) for t in ('hard', 'soft'))} FROM u GROUP BY 1""",
    "verdict_parse_strict": f"""WITH {_LINES} SELECT model, sample_id, raw_output IS NULL AS no_output,
        coalesce(array_to_string(list_transform(vs, lambda v: CASE WHEN v = 1 THEN 'Y' ELSE 'N' END), ''), '') AS verdicts FROM made""",
    "verdict_parse_relaxed": f"""{passes('', 'SELECT model, sample_id, raw_output, num_rules FROM predictions')}
        SELECT model, sample_id, coalesce(array_to_string(list_transform(vs, lambda v: CASE WHEN v = 1 THEN 'Y' ELSE 'N' END), ''), '') AS verdicts, source FROM parsed""",
    "verdict_sequences": f"""WITH base AS MATERIALIZED (SELECT model, sample_id, raw_output, num_rules, row_number() OVER () AS id FROM predictions),
        l AS (SELECT id, list_filter(list_transform(string_split_regex(coalesce(raw_output, ''), '[\n\r]'), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '') AS ls FROM base),
        l2 AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM l),
        h AS MATERIALIZED (SELECT id, ln, TRY_CAST({first_shape('line', parse.SEQUENCE, 1)} AS INT) AS rule, CASE WHEN lower({first_shape('line', parse.SEQUENCE, 2)}) IN ('yes', 'y') THEN 1 ELSE 0 END AS v FROM l2),
        r AS (SELECT a.id, a.ln AS start, count(*) AS k, list(b.v ORDER BY b.ln) AS vs FROM (SELECT * FROM h WHERE rule = 1) a JOIN base USING (id) JOIN h b ON a.id = b.id AND b.ln BETWEEN a.ln AND a.ln + num_rules - 1 AND b.rule = b.ln - a.ln + 1 GROUP BY 1, 2),
        f AS (SELECT r.id, arg_min(vs, start) AS vs FROM r JOIN base USING (id) WHERE k = num_rules GROUP BY 1)
        SELECT model, sample_id, raw_output IS NULL AS no_output, coalesce(array_to_string(list_transform(vs, lambda v: CASE WHEN v = 1 THEN 'Y' ELSE 'N' END), ''), '') AS verdicts FROM base LEFT JOIN f USING (id)""",
    "prediction_rows": f"""WITH b AS (SELECT question_id AS qid, arg_min(list_transform(refined_rubric, lambda r: CASE WHEN r.type = 'hard' THEN 3 ELSE 1 END), record_id) AS ws FROM bench WHERE question_id IS NOT NULL AND len(refined_rubric) > 0 GROUP BY 1),
        {_LINES.replace('AS id FROM predictions)', "AS id FROM (SELECT * REPLACE (len(CAST(nullif(trim(gold_verdicts), '') AS INT[])) AS num_rules) FROM predictions WHERE trim(gold_verdicts) <> ''))")},
        g AS (SELECT made.*, CAST(gold_verdicts AS INT[]) AS gold, ws FROM made LEFT JOIN b ON question_id = qid),
        h AS (SELECT *, CASE WHEN len(ws) = len(gold) THEN ws ELSE list_transform(gold, lambda x: 1) END AS w FROM g)
        SELECT model, sample_id, vs IS NOT NULL AS ok, CASE WHEN vs IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(range(1, len(gold) + 1), lambda i: vs[i] * w[i])), 0) AS BIGINT) END AS total,
          CASE WHEN vs IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(range(1, len(gold) + 1), lambda i: CASE WHEN vs[i] = gold[i] THEN 1 ELSE 0 END)), 0) AS BIGINT) ELSE 0 END AS matches,
          CASE WHEN vs IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(range(1, len(gold) + 1), lambda i: CASE WHEN vs[i] = gold[i] THEN w[i] ELSE 0 END)), 0) AS BIGINT) ELSE 0 END AS weighted_matches, coalesce(vs = gold, false) AS exact FROM h""",
    "vector_letters": f"""WITH {_P} SELECT coalesce(array_to_string(list_transform(gold, lambda v: CASE WHEN v = 1 THEN 'Y' ELSE 'N' END), ''), '') = gold_vector_yn AS gold_same,
        coalesce(array_to_string(list_transform(pred, lambda v: CASE WHEN v = 1 THEN 'Y' ELSE 'N' END), ''), '') = coalesce(pred_vector_yn, '') AS pred_same, count(*) AS n FROM p GROUP BY 1, 2""",
    "first_lines": """SELECT model, sample_id, coalesce(list_filter(list_transform(string_split_regex(coalesce(raw_output, ''), '[\\n\\r]'), lambda s: trim(s, ' ' || chr(9))), lambda s: s <> '')[1], '') AS first_line FROM predictions""",
    "audit_agreement": f"""WITH {_P}, u AS (SELECT i - 1 AS rule, gold[i] AS g, pred[i] AS h FROM (SELECT gold, pred, unnest(range(1, len(gold) + 1)) AS i FROM p WHERE len(pred) = len(gold)))
        SELECT rule, count(*) AS n, count(*) FILTER (g = h) AS same, count(*) FILTER (g = 1 AND h = 0) AS yes_no, count(*) FILTER (g = 0 AND h = 1) AS no_yes,
          round(CAST(count(*) FILTER (g = h) AS DOUBLE) / count(*), 6) AS agreement FROM u GROUP BY GROUPING SETS ((), (rule))""",
    "audit_pairwise": f"""WITH {_P}, k AS (SELECT model, question_id, count(*) AS n, list({{'a': answer_id, 'h': pred_total_score, 'g': gold_total_score}} ORDER BY answer_id, pred_total_score, gold_total_score) AS x FROM p WHERE ok GROUP BY 1, 2 HAVING count(*) = 2),
        v AS (SELECT model, sign(x[1].g - x[2].g) AS g, sign(x[1].h - x[2].h) AS h FROM k)
        SELECT model, count(*) FILTER (g <> 0 AND h <> 0) AS pairs, count(*) FILTER (g <> 0 AND h <> 0 AND g = h) AS agree, count(*) FILTER (g = 0) AS human_ties, count(*) FILTER (h = 0) AS judge_ties FROM v GROUP BY 1""",
    "judge_ranking": """WITH b AS (SELECT model, regexp_replace(model, '_(?:seed\\d+_)?(?:dev|test|heldout)\\d+$', '') AS base, count(*) AS n, sum(gold_total_score) AS points FROM predictions GROUP BY 1),
        k AS (SELECT *, regexp_extract(base, '^judge-(.+?)-(?:probe|gen|logprob|ck\\d+)$', 1) AS family, regexp_extract(base, '-(probe|gen|logprob|ck)\\d*$', 1) AS kind FROM b)
        SELECT model, family, kind, CAST(CASE kind WHEN 'probe' THEN 0 WHEN 'logprob' THEN 1 WHEN 'gen' THEN 2 WHEN 'ck' THEN 3 ELSE 999 END AS BIGINT) AS kind_rank, n, round(CAST(points AS DOUBLE) / n, 6) AS mean_points FROM k""",
    "dedup_predictions": """SELECT model, CAST(sum(m) AS BIGINT) AS rows, CAST(sum(k) AS BIGINT) AS distinct_rows, count(*) AS samples FROM
        (SELECT model, sample_id, count(*) AS m, count(DISTINCT coalesce(raw_output, '')) AS k FROM predictions GROUP BY 1, 2) GROUP BY 1""",
    "semi_anti_ids": "SELECT question_id, question_id IN (SELECT question_id FROM bench WHERE question_id IS NOT NULL) AS known FROM (SELECT DISTINCT question_id FROM predictions)",
}
