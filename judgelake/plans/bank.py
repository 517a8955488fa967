"""Queries over response banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.functions import parse
from judgelake.functions import text as X
from judgelake.functions.num import ratio, sigmoid, six
from judgelake.operators import align, flatten, metrics, probe, reward, score, splitting, validate
from judgelake.plans.verdict_sql import binary_sql, likert_sql, passes
from judgelake.runtime import read_table


TOP = {
    "split_role": "string", "data_source": "string", "question": "string", "reference_answer": "string", "rubric": "array<struct<title:string,description:string,weight:double>>",
    "prompt": "array<struct<role:string,content:string>>",
}
CANDIDATE = {
    "candidate_id": "string", "model_name": "string", "model_path": "string", "generation_mode": "string", "temperature": "double", "top_p": "double", "response": "string", "score": "double",
    "num_parse_failures": "bigint",
}
RESULT = {
    "score": "double", "criterion_scores": "array<double>", "criterion_weights": "array<double>", "criterion_parse_ok": "array<boolean>", "num_parse_failures": "bigint", "raw_parse_success": "boolean",
    "fallback_used": "boolean", "judge_attempts": "bigint", "parse_source": "string", "raw_judge_response": "string", "raw_judge_responses": "array<string>", "criterion_yes_probs": "array<double>",
    "raw_judge_responses_by_group": "array<struct<group_index:bigint,group_start:bigint,group_end:bigint,parse_source:string,raw_judge_response:string>>",
}


def bank_schema(top: str = "", candidate: str = "", result: str = "") -> str:
    """Schema of a response bank with the named fields only, so that a scan reads no other column."""
    inner = [f"{c}:{CANDIDATE[c]}" for c in candidate.split()]
    if result:
        inner.append("reward_result:struct<" + ",".join(f"{c}:{RESULT[c]}" for c in result.split()) + ">")
    columns = ["record_id bigint", "question_id string", *(f"{c} {TOP[c]}" for c in top.split())]
    return ", ".join(columns + ([f"candidates array<struct<{','.join(inner)}>>"] if inner else []))


def _bank(spark: SparkSession, d: str, top: str = "", candidate: str = "", result: str = "") -> DataFrame:
    return read_table(spark, d, "response_bank", bank_schema(top, candidate, result))


def keyed_candidates(spark: SparkSession, d: str) -> DataFrame:
    return flatten.keyed_candidates(_bank(spark, d, "", "candidate_id")).select("record_id", "candidate_id", "cand_pos")


def bank_items(spark: SparkSession, d: str) -> DataFrame:
    return flatten.bank_items(_bank(spark, d, "rubric", "candidate_id", "criterion_scores num_parse_failures"))


def rubric_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten.rubric_groups(_bank(spark, d, "rubric"), 3)
    return rows.select("record_id", "group_index", "group_start", "group_end", F.size("rules").cast("bigint").alias("rules"))


def regrouped(spark: SparkSession, d: str) -> DataFrame:
    """Judge texts kept by group, parsed by group, put together again and scored anew."""
    bank = _bank(spark, d, "rubric", "", "raw_judge_responses_by_group")
    rows = flatten.candidates(bank, "rubric").select("record_id", "cand_pos", "rubric", F.size("rubric").alias("n"), F.explode("c.reward_result.raw_judge_responses_by_group").alias("g"))
    size = (F.col("g.group_end") - F.col("g.group_start")).cast("int")
    hits = parse.hits(X.lines(F.col("g.raw_judge_response")), parse.STRICT)
    vector = F.transform(hits, lambda h: h["verdict"])
    parts = rows.filter("g is not null and n > 0").select(
        "record_id", "cand_pos", "n", "rubric", F.col("g.group_start").cast("int").alias("group_start"), size.alias("size"), vector.alias("vector"),
        F.coalesce(F.size(vector) == size, F.lit(False)).alias("ok"), F.col("g.raw_judge_response").alias("text"),
    )
    out = flatten.regroup(parts)
    return out.select(
        "record_id", "cand_pos", "parsed", X.verdict_letters(F.col("vector")).alias("vector"), F.length("raw_text").cast("bigint").alias("chars"), "failures",
        six(score.weighted_score(F.col("vector"), score.rubric_weights(F.col("rubric")))).alias("score"),
    )


def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten.candidates(_bank(spark, d, "", "", "criterion_scores criterion_weights")).filter("c.reward_result is not null")
    return rows.select("record_id", "cand_pos", six(score.weighted_score(F.col("c.reward_result.criterion_scores"), F.col("c.reward_result.criterion_weights"))).alias("score"))


def reward_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Rewards made anew by each strategy: jointly from the judge's whole text, with the fallback by weight, criterion by
    criterion from its single texts, and as one rating; the test split earns nothing."""
    bank = _bank(spark, d, "rubric split_role", "response", "raw_judge_response raw_judge_responses")
    rows = flatten.candidates(bank, "rubric", "split_role").filter("c.reward_result is not null")
    split, rubric, r = F.lower(F.trim("split_role")), F.col("rubric"), F.col("c.reward_result")
    whole = F.when(r["raw_judge_response"].isNotNull(), F.array(r["raw_judge_response"]))
    joint = reward.compute_score(whole, rubric, split)
    kept = reward.compute_score(whole, rubric, split, fallback=True, threshold=3.0, score_test=True)
    single = reward.compute_score(r["raw_judge_responses"], rubric, split, "explicit_per_criterion", score_test=True)
    rating = reward.compute_score(F.when(F.col("c.response").isNotNull(), F.array("c.response")), rubric, split, "implicit", score_test=True)
    made = rows.select("record_id", "cand_pos", joint.alias("j"), kept.alias("k"), single.alias("s"), rating.alias("i"))
    return made.select(
        "record_id", "cand_pos", F.col("j.parse_source").alias("joint_source"), six(F.col("j.score")).alias("joint_score"), F.col("j.num_parse_failures").alias("joint_failures"),
        F.col("k.fallback_used").alias("fallback_used"), six(F.col("k.score")).alias("fallback_score"), six(F.col("s.score")).alias("single_score"), F.col("s.num_parse_failures").alias("single_failures"),
        six(F.col("i.score")).alias("rating"),
    )


def _scored_by_probability(bank: DataFrame) -> DataFrame:
    """The bank as another judge would have scored it, whose verdicts are those that the kept probabilities give."""
    def scored(c: Column) -> Column:
        r = c["reward_result"]
        verdicts = F.transform(r["criterion_yes_probs"], lambda p: F.when(p >= 0.5, 1.0).otherwise(0.0))
        total = score.weighted_score(r["criterion_yes_probs"], r["criterion_weights"])
        result = F.struct(verdicts.alias("criterion_scores"), r["criterion_weights"].alias("criterion_weights"), F.lit(0).cast("bigint").alias("num_parse_failures"))
        return F.struct(c["candidate_id"].alias("candidate_id"), total.alias("score"), result.alias("reward_result"))

    kept = F.filter("candidates", lambda c: c["reward_result"]["criterion_yes_probs"].isNotNull())
    return bank.withColumn("candidates", F.transform(kept, scored))


def alignment(spark: SparkSession, d: str) -> DataFrame:
    """Two scored banks against each other, overall and for every candidate id."""
    reference = _bank(spark, d, "", "candidate_id score", "criterion_scores criterion_weights num_parse_failures criterion_yes_probs")
    return align.alignment(align.shared_pairs(reference, _scored_by_probability(reference)))


def candidate_text_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten.candidates(_bank(spark, d, "", "candidate_id response")).filter("c.candidate_id is not null")
    t = F.col("c.response")
    opened, closed = t.contains("<think>"), t.contains("</think>")
    return rows.groupBy(F.col("c.candidate_id").alias("candidate_id")).agg(
        F.count(F.lit(1)).alias("n"), six(F.avg(F.length(t))).alias("mean_chars"), F.max(F.length(t)).cast("bigint").alias("max_chars"),
        F.count_if(opened).alias("think_open"), F.count_if(closed).alias("think_closed"), F.count_if(opened & ~closed).alias("think_unclosed"),
        F.sum(X.rough_tokens(t)).alias("rough_tokens"),
    )


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten.candidates(_bank(spark, d, "", "model_name score")).filter("c.score is not null").withColumn("model", F.lower(F.trim("c.model_name")))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), six(F.avg("c.score")).alias("mean"), six(F.min("c.score")).alias("min"), six(F.max("c.score")).alias("max"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Parse figures of a scoring run: by sample and by criterion, attempts, sources."""
    rows = flatten.candidates(_bank(spark, d, "", "", "parse_source num_parse_failures criterion_scores judge_attempts fallback_used criterion_parse_ok")).filter("c.reward_result is not null")
    r = F.col("c.reward_result")
    return rows.groupBy(F.coalesce(r["parse_source"], F.lit("none")).alias("parse_source")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.coalesce(r["num_parse_failures"], F.lit(0)) == 0).alias("clean"), F.sum(F.coalesce(r["num_parse_failures"], F.lit(0))).alias("failures"),
        F.sum(F.coalesce(F.size(r["criterion_scores"]), F.lit(0))).alias("criteria"),
        six(ratio(F.sum(F.size(F.filter(r["criterion_parse_ok"], lambda x: x))), F.sum(F.size(r["criterion_parse_ok"])))).alias("criterion_parse_rate"), six(F.avg(r["judge_attempts"])).alias("mean_attempts"), F.count_if(r["fallback_used"]).alias("fallbacks"),
    )


def format_criterion(spark: SparkSession, d: str) -> DataFrame:
    rows = _bank(spark, d, "rubric").select("record_id", F.posexplode("rubric").alias("pos", "r")).filter("r is not null")
    title, description = F.col("r.title"), F.col("r.description")
    return rows.select(
        "record_id", F.col("pos").cast("bigint").alias("pos"), X.kind(title, description).alias("kind"), *[X.criterion(title, description, form).alias(form) for form in X.FORMS],
        X.criterion(title, description, "description_only", 40).alias("short"), X.slug(title).alias("slug"),
    )


def criterion_listing(spark: SparkSession, d: str) -> DataFrame:
    return _bank(spark, d, "rubric").filter("size(rubric) > 0").select("record_id", X.criterion_listing(F.col("rubric")).alias("listing"))


def question_ids(spark: SparkSession, d: str) -> DataFrame:
    return _bank(spark, d, "question prompt").select("record_id", X.question_key(F.col("question"), F.to_json("prompt")).alias("key"))


def multiturn_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _bank(spark, d, "prompt reference_answer").filter("size(prompt) > 0")
    twice = F.concat("prompt", F.array(F.struct(F.lit("ASSISTANT").alias("role"), F.coalesce("reference_answer", F.lit("")).alias("content"))))
    return rows.select("record_id", X.dialogue(F.col("prompt")).alias("prompt"), X.dialogue(twice).alias("with_answer"))


def boxed_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten.candidates(_bank(spark, d, "", "response")).filter(F.col("c.response").contains("boxed{"))
    t = F.col("c.response")
    return rows.select(
        "record_id", "cand_pos", parse.boxed(t).alias("boxed"), six(parse.likert(t)).alias("likert"), six(parse.likert(t, strict=True)).alias("strict_likert"),
        parse.binary(t).alias("binary"), parse.binary(t, strict=True).alias("strict_binary"),
    )


def judge_text_sources(spark: SparkSession, d: str) -> DataFrame:
    """Which pass reads each judge text (relaxed shapes included), by how its source was noted."""
    rows = flatten.candidates(_bank(spark, d, "rubric", "", "raw_judge_response parse_source"), "rubric").filter("size(rubric) > 0 and c.reward_result.raw_judge_response is not null")
    made = parse.source(F.col("c.reward_result.raw_judge_response"), F.size("rubric"))
    return rows.groupBy(F.coalesce("c.reward_result.parse_source", F.lit("none")).alias("noted"), made.alias("read")).agg(F.count(F.lit(1)).alias("n"))


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the scored bank's contract, counted by check."""
    bank = _bank(spark, d, "", "", "criterion_scores criterion_weights criterion_parse_ok score")
    rows = flatten.candidates(bank).filter("c.reward_result is not null").select("record_id", "cand_pos", F.col("c.reward_result").alias("result"))
    ids = validate.ids_unique(bank, "question_id")
    return validate.scored_candidates(rows).unionByName(ids).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    members = _bank(spark, d, "split_role").select(F.trim("question_id").alias("id"), F.lower(F.trim("split_role")).alias("split")).filter("id <> '' and split in ('train', 'dev', 'heldout', 'test')")
    return validate.splits_disjoint(members, "id", "split").select("key", F.col("detail").alias("splits"))


def confusion_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    p, y = F.col("prob"), F.col("label")
    sums = _probs(spark, d).agg(*[F.count_if((y == g) & ((p >= 0.6) if c else (p < 0.6))).alias(k) for k, g, c in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    figures = metrics.class_figures(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return sums.select("tp", "fp", "fn", "tn", *[six(c).alias(k) for k, c in figures.items()])


def _probs(spark: SparkSession, d: str) -> DataFrame:
    """(prob, label) of every criterion that has both."""
    rows = flatten.candidates(_bank(spark, d, "", "", "criterion_yes_probs criterion_scores"))
    each = F.arrays_zip(F.col("c.reward_result.criterion_yes_probs").alias("p"), F.col("c.reward_result.criterion_scores").alias("s"))
    pairs = rows.filter(F.size("c.reward_result.criterion_yes_probs") == F.size("c.reward_result.criterion_scores")).select(F.inline(each))
    return pairs.filter("p is not null and s is not null").select(F.col("p").alias("prob"), F.when(F.col("s") >= 0.5, 1).otherwise(0).cast("bigint").alias("label"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    figures = ("macro_f1", "balanced_accuracy", "accuracy")
    return metrics.threshold_sweep(_probs(spark, d), "prob", "label").withColumns({c: six(F.col(c)) for c in figures})


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    best = metrics.best_threshold(metrics.threshold_sweep(_probs(spark, d), "prob", "label"))
    return best.select("threshold", *[six(F.col(c)).alias(c) for c in ("macro_f1", "balanced_accuracy", "accuracy")])


def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(_probs(spark, d), "prob", "label")


def losses(spark: SparkSession, d: str) -> DataFrame:
    return probe.losses(_probs(spark, d), "prob", "label")


def platt_fit(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated losses after a two-parameter fit on the logits."""
    rows = _probs(spark, d)
    q = F.least(F.greatest(F.col("prob"), F.lit(1e-3)), F.lit(1 - 1e-3))
    rows = rows.withColumn("z", F.log(q / (1 - q)))
    a, b = probe.platt(rows, "z", "label")
    out = probe.losses(rows.withColumn("fitted", sigmoid(F.lit(a) * F.col("z") + F.lit(b))), "fitted", "label")
    return out.withColumns({"a": F.lit(round(a, 6)), "b": F.lit(round(b, 6))})


def choice_probability(spark: SparkSession, d: str) -> DataFrame:
    """Probability of yes out of token log probabilities of four spellings on each side, two tokens each, as sum and as
    mean over the tokens. The first 16 numbers of an embedding, made negative, stand for a model's log probabilities."""
    rows = read_table(spark, d, "embeddings").filter(F.size("embedding") >= 16)
    spelling = lambda k: F.transform(F.slice("embedding", 2 * k + 1, 2), lambda x: -F.abs(x.cast("double")))
    sides = {side: F.array(*[spelling(k) for k in ks]) for side, ks in (("yes", range(4)), ("no", range(4, 8)))}
    out = []
    for mean, name in ((False, "sum"), (True, "mean")):
        yes, no = (score.log_sum_exp(reward.choice_log_probability(sides[s], mean)) for s in ("yes", "no"))
        p = sigmoid(yes - no)
        out += [six(p).alias(f"p_{name}"), F.when(p >= 0.5, 1).otherwise(0).cast("bigint").alias(f"verdict_{name}")]
    return rows.select("vec_id", *out)


def fallback_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _bank(spark, d, "rubric").filter("size(rubric) > 0").select("record_id", X.verdict_letters(score.fallback_verdicts(F.col("rubric"), 3.0)).alias("verdicts"))


def rl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows for reinforcement learning: nested structs with the prompt, the privileged text and the gate of the test
    split, flattened back to what they hold."""
    rubric = F.coalesce("rubric", F.array().cast(reward.rubric_type()))
    wrapped = F.when(F.size("prompt") > 0, F.col("prompt")).otherwise(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("question", F.lit("")).alias("content"))))
    info = F.struct(
        "question", rubric.alias("rubric"), F.lower(F.trim("split_role")).alias("split"), "reference_answer", X.privileged(F.col("rubric"), F.col("reference_answer")).alias("priv_info"), wrapped.alias("messages"),
    )
    rows = _bank(spark, d, "data_source question rubric split_role reference_answer prompt").select(
        "record_id", "data_source", F.lit("rubric").alias("ability"), wrapped.alias("prompt"), F.struct(F.lit("rubric").alias("style"), F.coalesce("reference_answer", F.lit("")).alias("ground_truth")).alias("reward_model"), info.alias("extra_info"),
    )
    gate = lambda opted: F.when((F.col("extra_info.split") == "test") & F.lit(not opted), 0.0)
    return rows.select(
        "record_id", "data_source", "ability", F.col("reward_model.style").alias("style"), F.length("reward_model.ground_truth").cast("bigint").alias("truth_chars"), F.col("extra_info.split").alias("split"),
        F.size("extra_info.rubric").cast("bigint").alias("criteria"), F.size("prompt").cast("bigint").alias("turns"), F.length("extra_info.priv_info").cast("bigint").alias("priv_chars"),
        gate(False).alias("gated_reward"), gate(True).alias("opted_reward"),
    )


def wide_items(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten.wide_items(flatten.bank_items(_bank(spark, d, "rubric", "candidate_id", "criterion_scores num_parse_failures")), ["record_id", "candidate_id"])
    return rows.select("record_id", "candidate_id", X.verdict_letters(F.col("labels")).alias("labels"), six(F.col("met")).alias("met"))


def privileged_text(spark: SparkSession, d: str) -> DataFrame:
    return _bank(spark, d, "rubric reference_answer").select("record_id", X.privileged(F.col("rubric"), F.col("reference_answer")).alias("text"))


def spec_coverage(spark: SparkSession, d: str) -> DataFrame:
    return flatten.spec_coverage(flatten.candidates(_bank(spark, d, "", "candidate_id model_name generation_mode temperature top_p")), read_table(spark, d, "candidate_specs"))


def split_fraction(spark: SparkSession, d: str) -> DataFrame:
    return splitting.fraction_split(_bank(spark, d), "question_id", {"train": 0.4, "dev": 0.1, "test": 0.5})


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return splitting.count_split(_bank(spark, d), "question_id", {"train": 30, "dev": 10}, "test")


def split_ratio(spark: SparkSession, d: str) -> DataFrame:
    return splitting.ratio_split(_bank(spark, d), "question_id", 0.05)


def split_nested(spark: SparkSession, d: str) -> DataFrame:
    return splitting.nested_split(_bank(spark, d), "question_id", [10, 20, 40], 5, 15)


def split_sets(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the bank and of the bench: in both, in one only, in all."""
    a = _bank(spark, d).select(F.trim("question_id").alias("id")).filter("id <> ''").distinct()
    b = read_table(spark, d, "bench").select(F.trim("question_id").alias("id")).filter("id <> ''").distinct()
    parts = {"both": a.intersect(b), "bank_only": a.exceptAll(b), "bench_only": b.exceptAll(a), "all": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = _bank(spark, d, "split_role question", "candidate_id").select(F.lower(F.trim("split_role")).alias("split"), "question_id", F.coalesce(F.size("candidates"), F.lit(0)).alias("k"), F.length("question").alias("chars"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("question_id").alias("questions"), F.sum("k").alias("candidates"), six(ratio(F.sum("chars"), F.count(F.lit(1)))).alias("mean_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        keyed_candidates, bank_items, rubric_groups, regrouped, weighted_score, reward_strategies, alignment, candidate_text_profile, score_summary, run_summary,
        format_criterion, criterion_listing, question_ids, multiturn_text, boxed_scores, judge_text_sources, violations, split_overlap, confusion_at_threshold,
        threshold_sweep, best_threshold, calibration_error, losses, platt_fit, choice_probability, fallback_verdicts, rl_rows, wide_items, privileged_text, spec_coverage, split_fraction, split_counts,
        split_ratio, split_nested, split_sets, split_manifest,
    )
}

_C = "c AS (SELECT record_id, question_id, rubric, i - 1 AS cand_pos, c FROM (SELECT *, unnest(candidates) AS c, generate_subscripts(candidates, 1) AS i FROM response_bank) WHERE c IS NOT NULL)"
_K = f"{_C}, k AS (SELECT * FROM (SELECT *, c.candidate_id AS candidate_id, row_number() OVER (PARTITION BY record_id, c.candidate_id ORDER BY cand_pos DESC) AS rn FROM c WHERE c.candidate_id IS NOT NULL) WHERE rn = 1)"
_PR = f"""{_C}, pr AS (SELECT ps[i] AS prob, CASE WHEN ss[i] >= 0.5 THEN 1 ELSE 0 END AS label FROM
    (SELECT c.reward_result.criterion_yes_probs AS ps, c.reward_result.criterion_scores AS ss, unnest(range(1, len(c.reward_result.criterion_yes_probs) + 1)) AS i FROM c
      WHERE len(c.reward_result.criterion_yes_probs) = len(c.reward_result.criterion_scores)) WHERE ps[i] IS NOT NULL AND ss[i] IS NOT NULL)"""
_WS = lambda s, w: f"""(CASE WHEN coalesce(list_sum(list_transform(range(1, least(len({s}), len({w})) + 1), lambda i: abs(coalesce({w}[i], 1.0)))), 0) = 0 THEN 0.0 ELSE
    list_sum(list_transform(range(1, least(len({s}), len({w})) + 1), lambda i: coalesce({s}[i], 0.0) * abs(coalesce({w}[i], 1.0)))) / list_sum(list_transform(range(1, least(len({s}), len({w})) + 1), lambda i: abs(coalesce({w}[i], 1.0)))) END)"""  # noqa: E731
_ORDER = "o AS (SELECT question_id, row_number() OVER (ORDER BY sha256('42:' || question_id), question_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT question_id FROM response_bank WHERE question_id IS NOT NULL))"
_R = lambda a, b: f"(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END)"
_STRICT = "(?i)^Rule\\s*(\\d+)\\s*:\\s*.*?\\bVerdict\\s*:\\s*(Yes|No|Y|N)$"
_KIND = "CASE WHEN t LIKE '%essential%' THEN 'essential' WHEN t LIKE '%important%' THEN 'important' WHEN t LIKE '%optional%' THEN 'optional' WHEN t LIKE '%pitfall%' THEN 'pitfall' END"


def _classes(exact: bool = False) -> str:
    f = lambda a, b: f"(CASE WHEN {a} + {b} = 0 THEN 0.0 ELSE 2 * {a} * {b} / ({a} + {b}) END)"
    yp, yr, np_, nr = _R("tp", "(tp + fp)"), _R("tp", "(tp + fn)"), _R("tn", "(tn + fn)"), _R("tn", "(tn + fp)")
    parts = {
        "yes_precision": yp, "yes_recall": yr, "yes_f1": f(yp, yr), "no_precision": np_, "no_recall": nr, "no_f1": f(np_, nr), "macro_f1": f"({f(yp, yr)} + {f(np_, nr)}) / 2",
        "balanced_accuracy": f"({yr} + {nr}) / 2", "jaccard_yes": _R("tp", "(tp + fp + fn)"),
        "mcc": "CASE WHEN CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END",
    }
    return ", ".join(f"{v if exact else f'round({v}, 6)'} AS {k}" for k, v in parts.items())


_SWEEP = f"""WITH {_PR}, g AS (SELECT prob AS threshold, sum(label) AS pos, sum(m) AS m FROM (SELECT prob, label, 1 AS m FROM pr UNION ALL SELECT CAST(k AS DOUBLE) / 100, 0, 0 FROM (SELECT unnest(range(5, 96)) AS k)) GROUP BY 1),
    u AS (SELECT threshold, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(m) OVER (ORDER BY threshold DESC) AS BIGINT) AS called, CAST(sum(pos) OVER () AS BIGINT) AS ap, CAST(sum(m) OVER () AS BIGINT) AS am FROM g),
    v AS (SELECT threshold, tp, called - tp AS fp, ap - tp AS fn, am - ap - called + tp AS tn FROM u),
    z AS (SELECT *, {_classes(exact=True)}, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy FROM v)"""

#: White space of any script, within brackets.
_BLANK = "\\s\\x0b\\pZ\\x{85}"
_PRIVILEGED = """concat_ws(chr(10) || chr(10), CASE WHEN len(rubric) > 0 THEN 'You should follow the given rubrics to answer the question. Positive weights indicate criteria you should satisfy. Negative weights indicate criteria you should avoid.'
          || chr(10) || chr(10) || array_to_string(list_transform(rubric, lambda r: '  - ' || coalesce(r.title, '') || ': ' || coalesce(r.description, '') || ' (weight: ' || CASE WHEN coalesce(r.weight, 1.0) > 0 THEN '+' ELSE '' END || CAST(coalesce(r.weight, CAST(1.0 AS DOUBLE)) AS VARCHAR) || ')'), chr(10)) END,
        CASE WHEN coalesce(reference_answer, '') <> '' THEN 'You should refer to the following reference answer:' || chr(10) || chr(10) || reference_answer END)"""

ORACLE = {
    "alignment": f"""WITH {_C}, x AS (SELECT record_id, cand_pos, question_id, c.candidate_id AS cid, c.reward_result AS r, c.score AS sc FROM c WHERE c.candidate_id IS NOT NULL AND question_id IS NOT NULL),
        a AS (SELECT * FROM (SELECT question_id, cid, list_transform(r.criterion_scores, lambda v: CAST(trunc(v) AS INT)) AS ra, r.criterion_weights AS w, coalesce(r.num_parse_failures, 0) AS f, sc AS rs, row_number() OVER (PARTITION BY question_id, cid ORDER BY record_id DESC, cand_pos DESC) AS rn FROM x) WHERE rn = 1),
        b AS (SELECT * FROM (SELECT question_id, cid, list_transform(r.criterion_yes_probs, lambda v: CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) AS cb, {_WS('r.criterion_yes_probs', 'r.criterion_weights')} AS cs, row_number() OVER (PARTITION BY question_id, cid ORDER BY record_id DESC, cand_pos DESC) AS rn
          FROM x WHERE r.criterion_yes_probs IS NOT NULL) WHERE rn = 1),
        j AS (SELECT a.question_id, a.cid AS candidate_id, ra, cb, a.w, a.f, rs, cs FROM a JOIN b USING (question_id, cid)),
        p AS (SELECT *, coalesce(len(ra) > 0 AND len(ra) = len(cb) AND len(ra) = len(w) AND f = 0 AND len(list_filter(ra, lambda v: v IS NULL)) = 0 AND rs IS NOT NULL AND cs IS NOT NULL, false) AS ok FROM j),
        q AS (SELECT *, CASE WHEN ok THEN list_transform(range(1, len(ra) + 1), lambda i: {{'r': ra[i], 'c': cb[i], 'w': coalesce(w[i], 1.0)}}) ELSE [] END AS z, cs - rs AS d FROM p),
        g AS (SELECT candidate_id, GROUPING(candidate_id) AS overall, count(*) AS n, count(*) FILTER (ok) AS kk, sum(f) AS rf, sum(CASE WHEN len(ra) > 0 THEN len(ra) ELSE 1 END) AS rj, sum(len(z)) AS items, count(*) FILTER (ok AND ra = cb) AS ex,
          {', '.join(f"coalesce(sum(len(list_filter(z, lambda e: {c}))), 0) AS {n}" for n, c in (('same', 'e.r = e.c'), ('pos', 'e.w > 0'), ('pos_same', 'e.w > 0 AND e.r = e.c'), ('pen', 'e.w < 0'), ('pen_same', 'e.w < 0 AND e.r = e.c'), ('tp', 'e.r = 1 AND e.c = 1'), ('fp', 'e.r = 0 AND e.c = 1'), ('fn', 'e.r = 1 AND e.c = 0'), ('tn', 'e.r = 0 AND e.c = 0')))},
          {', '.join(f"sum(coalesce(list_sum(list_transform(list_filter(z, lambda e: {c}), lambda e: abs(e.w))), 0)) AS {n}" for n, c in (('wt', 'true'), ('wt_same', 'e.r = e.c'), ('wp', 'e.w > 0'), ('wp_same', 'e.w > 0 AND e.r = e.c'), ('wn', 'e.w < 0'), ('wn_same', 'e.w < 0 AND e.r = e.c')))},
          count(*) FILTER (ok AND abs(d) <= 1e-12) AS ss, coalesce(sum(abs(d)) FILTER (ok), 0) AS ad, coalesce(sum(d * d) FILTER (ok), 0) AS sd, coalesce(sum(d) FILTER (ok), 0) AS sg, count(*) FILTER (ok AND abs(d) <= 0.05) AS w05, count(*) FILTER (ok AND abs(d) <= 0.10) AS w10,
          coalesce(sum(rs) FILTER (ok), 0) AS rsum, coalesce(sum(cs) FILTER (ok), 0) AS csum,
          coalesce(CASE WHEN stddev_pop(rs) FILTER (ok) * stddev_pop(cs) FILTER (ok) > 0 THEN covar_pop(rs, cs) FILTER (ok) / (stddev_pop(rs) FILTER (ok) * stddev_pop(cs) FILTER (ok)) END, 0.0) AS rho
          FROM q GROUP BY GROUPING SETS ((), (candidate_id))),
        y AS (SELECT question_id, candidate_id, rs, cs, 0 AS o FROM q WHERE ok UNION ALL SELECT question_id, NULL, rs, cs, 1 FROM q WHERE ok),
        rk AS (SELECT candidate_id, o, rank() OVER (PARTITION BY o, candidate_id ORDER BY rs) + (count(*) OVER (PARTITION BY o, candidate_id, rs) - 1) / 2.0 AS a, rank() OVER (PARTITION BY o, candidate_id ORDER BY cs) + (count(*) OVER (PARTITION BY o, candidate_id, cs) - 1) / 2.0 AS b FROM y),
        sp AS (SELECT candidate_id, o, CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS spear FROM rk GROUP BY 1, 2),
        pw AS (SELECT count(*) AS pairs, count(*) FILTER (sign(a.rs - b.rs) = sign(a.cs - b.cs)) AS rights FROM (SELECT * FROM y WHERE o = 0) a JOIN (SELECT * FROM y WHERE o = 0) b ON a.question_id = b.question_id AND a.candidate_id < b.candidate_id)
        SELECT g.candidate_id, CAST(overall AS BIGINT) AS overall, n AS samples_total, kk AS samples_parse_ok, n - kk AS samples_parse_failed, CAST(items AS BIGINT) AS criterion_items_total, {_classes()}, {', '.join(f"round({e}, 6) AS {n}" for n, e in (
          ('parse_success_rate', _R('kk', 'n')), ('reference_parse_success_rate', f"1 - {_R('rf', 'rj')}"), ('candidate_parse_success_rate', 'CAST(1 AS DOUBLE)'), ('rule_exact_match_rate', _R('ex', 'kk')), ('rule_hamming_accuracy', _R('same', 'items')), ('criterion_item_agreement', _R('same', 'items')), ('score_mean_absolute_error', _R('ad', 'kk')),
          ('rule_positive_accuracy', _R('pos_same', 'pos')), ('rule_penalty_accuracy', _R('pen_same', 'pen')), ('rule_weighted_accuracy_abs', _R('wt_same', 'wt')), ('rule_weighted_accuracy_positive', _R('wp_same', 'wp')), ('rule_weighted_accuracy_penalty_abs', _R('wn_same', 'wn')),
          ('score_exact_match_rate', _R('ss', 'kk')), ('score_mae', _R('ad', 'kk')),
          ('score_rmse', f"sqrt({_R('sd', 'kk')})"), ('score_mean_error_bias', _R('sg', 'kk')), ('score_within_0p05_rate', _R('w05', 'kk')), ('score_within_0p10_rate', _R('w10', 'kk')), ('score_pearson', 'rho'), ('score_spearman', 'coalesce(spear, 0.0)'), ('reference_mean_score', _R('rsum', 'kk')), ('candidate_mean_score', _R('csum', 'kk'))))},
          CASE WHEN overall = 1 THEN pairs END AS pairwise_pairs_total, CASE WHEN overall = 1 THEN round({_R('rights', 'pairs')}, 6) END AS pairwise_order_accuracy
        FROM g LEFT JOIN sp ON sp.o = overall AND sp.candidate_id IS NOT DISTINCT FROM g.candidate_id, pw""",
    "judge_text_sources": f"""{passes(_C, "SELECT record_id, cand_pos, coalesce(c.reward_result.parse_source, 'none') AS noted, c.reward_result.raw_judge_response AS raw_output, len(rubric) AS num_rules FROM c WHERE len(rubric) > 0 AND c.reward_result.raw_judge_response IS NOT NULL")}
        SELECT noted, source AS read, count(*) AS n FROM parsed GROUP BY 1, 2""",
    "reward_strategies": f"""{passes(_C, "SELECT record_id, cand_pos, rubric, lower(trim(split_role)) AS split, c.response AS response, c.reward_result AS r, c.reward_result.raw_judge_response AS raw_output, coalesce(len(rubric), 0) AS num_rules FROM (SELECT c.*, b.split_role FROM c JOIN (SELECT record_id, split_role FROM response_bank) b USING (record_id)) WHERE c.reward_result IS NOT NULL")},
        w AS (SELECT *, list_transform(rubric, lambda x: abs(coalesce(x.weight, 1.0))) AS ws, list_transform(rubric, lambda x: CASE WHEN coalesce(x.weight, 0.0) >= 3 THEN 1 ELSE 0 END) AS fb,
                list_transform(range(1, num_rules + 1), lambda i: {binary_sql("r.raw_judge_responses[i]")}) AS one, {likert_sql("response")} AS rate FROM parsed),
        t AS (SELECT *, coalesce(list_sum(ws), 0) AS wt FROM w)
        SELECT record_id, cand_pos,
          CASE WHEN split = 'test' THEN 'test_split' WHEN num_rules = 0 THEN 'no_rubric' WHEN raw_output IS NULL THEN 'no_judge_text' WHEN vs IS NOT NULL THEN 'judge' ELSE 'parse_failed' END AS joint_source,
          round(CASE WHEN coalesce(split = 'test', false) OR num_rules = 0 OR vs IS NULL OR wt = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, num_rules + 1), lambda i: vs[i] * ws[i])) / wt END, 6) AS joint_score,
          CASE WHEN coalesce(split = 'test', false) OR num_rules = 0 OR vs IS NOT NULL THEN 0 ELSE num_rules END AS joint_failures,
          num_rules > 0 AND raw_output IS NOT NULL AND vs IS NULL AS fallback_used,
          round(CASE WHEN num_rules = 0 OR raw_output IS NULL OR wt = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, num_rules + 1), lambda i: coalesce(vs, fb)[i] * ws[i])) / wt END, 6) AS fallback_score,
          round(CASE WHEN num_rules = 0 OR coalesce(len(r.raw_judge_responses), 0) = 0 OR wt = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, num_rules + 1), lambda i: coalesce(one[i], 0) * ws[i])) / wt END, 6) AS single_score,
          CASE WHEN num_rules = 0 THEN 0 WHEN coalesce(len(r.raw_judge_responses), 0) = 0 THEN num_rules ELSE len(list_filter(one, lambda x: x IS NULL)) END AS single_failures,
          round(CASE WHEN num_rules = 0 OR response IS NULL THEN 0.0 ELSE coalesce(rate, 0.0) END, 6) AS rating FROM t""",
    "regrouped": f"""WITH {_C}, g AS (SELECT record_id, cand_pos, rubric, len(rubric) AS n, unnest(c.reward_result.raw_judge_responses_by_group) AS g FROM c),
        h AS (SELECT *, row_number() OVER () AS id FROM g WHERE g IS NOT NULL AND n > 0),
        l AS (SELECT id, list_filter(list_transform(string_split_regex(coalesce(g.raw_judge_response, ''), '[\n\r]'), lambda s: trim(s, ' ' || chr(9))), lambda s: s <> '') AS ls FROM h),
        l2 AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM l),
        v AS (SELECT id, list(CASE WHEN lower(regexp_extract(line, '{_STRICT}', 2)) IN ('yes', 'y') THEN 1 ELSE 0 END ORDER BY ln) AS vs FROM l2 WHERE regexp_matches(line, '{_STRICT}') GROUP BY 1),
        p AS (SELECT record_id, cand_pos, n, rubric, CAST(g.group_start AS INT) AS st, CAST(g.group_end - g.group_start AS INT) AS sz, coalesce(vs, []) AS vs, coalesce(len(coalesce(vs, [])) = g.group_end - g.group_start, false) AS ok, g.raw_judge_response AS t FROM h LEFT JOIN v USING (id)),
        a AS (SELECT record_id, cand_pos, max(n) AS n, any_value(rubric) AS rubric, bool_and(ok) AS parsed, list({{'s': st, 'v': vs}} ORDER BY st, vs) AS gs, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY st), '') AS t, CAST(sum(CASE WHEN ok THEN 0 ELSE greatest(0, coalesce(sz, 0)) END) AS BIGINT) AS failures FROM p GROUP BY 1, 2),
        b AS (SELECT *, list_transform(range(0, n), lambda i: coalesce((list_filter(gs, lambda q: q.s <= i AND i < q.s + len(q.v))[-1]).v[i - (list_filter(gs, lambda q: q.s <= i AND i < q.s + len(q.v))[-1]).s + 1], 0)) AS vec, list_transform(rubric, lambda r: coalesce(r.weight, 1.0)) AS ws FROM a)
        SELECT record_id, cand_pos, parsed, array_to_string(list_transform(vec, lambda v: CASE WHEN v = 1 THEN 'Y' ELSE 'N' END), '') AS vector, length(t) AS chars, failures, round({_WS('vec', 'ws')}, 6) AS score FROM b""",
    "violations": f"""WITH {_C}, r AS (SELECT c.reward_result AS r FROM c WHERE c.reward_result IS NOT NULL), s AS (SELECT r, r.criterion_scores AS s, r.criterion_weights AS w, r.criterion_parse_ok AS o, r.score AS sc FROM r),
        i AS (SELECT question_id AS k, count(*) AS m FROM response_bank GROUP BY 1),
        a AS (SELECT 'vector_length' AS "check" FROM s WHERE len(s) <> len(w) OR len(s) <> len(o) UNION ALL SELECT 'label_not_binary' FROM s WHERE len(list_filter(s, lambda x: x <> 0 AND x <> 1)) > 0
          UNION ALL SELECT 'label_null' FROM s WHERE len(list_filter(s, lambda x: x IS NULL)) > 0 UNION ALL SELECT 'score_missing' FROM s WHERE sc IS NULL UNION ALL SELECT 'not_parsed' FROM s WHERE len(list_filter(o, lambda x: NOT coalesce(x, false))) > 0
          UNION ALL SELECT 'score_not_finite' FROM s WHERE isnan(sc) OR isinf(sc) UNION ALL SELECT 'weight_not_finite' FROM s WHERE len(list_filter(w, lambda x: isnan(x) OR isinf(x))) > 0
          UNION ALL SELECT 'score_differs' FROM s WHERE len(s) = len(w) AND len(list_filter(s, lambda x: x IS NULL)) = 0 AND abs(sc - {_WS('s', 'w')}) > 1e-12
          UNION ALL SELECT 'id_blank' FROM i WHERE coalesce(trim(k, ' '), '') = '' UNION ALL SELECT 'id_repeated' FROM i WHERE m > 1 AND trim(k, ' ') <> '')
        SELECT "check", count(*) AS n FROM a GROUP BY 1""",
    "keyed_candidates": f"WITH {_K} SELECT record_id, candidate_id, cand_pos FROM k",
    "bank_items": f"""WITH {_K}, u AS (SELECT record_id, candidate_id, rubric, c.reward_result.criterion_scores AS s, unnest(range(1, len(rubric) + 1)) AS i FROM k
        WHERE coalesce(c.reward_result.num_parse_failures, 0) = 0 AND len(c.reward_result.criterion_scores) = len(rubric) AND len(rubric) > 0 AND len(list_filter(c.reward_result.criterion_scores, lambda x: x IS NULL)) = 0)
        SELECT record_id, candidate_id, i - 1 AS rule_index, rubric[i].title AS title, coalesce({_KIND.replace("t LIKE", "lower(concat_ws(' ', rubric[i].title, rubric[i].description)) LIKE")}, 'unknown') AS kind, coalesce(rubric[i].weight, 1.0) AS weight, CAST(CASE WHEN s[i] >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS label FROM u""",
    "wide_items": f"""WITH {_K}, u AS (SELECT record_id, candidate_id, rubric, list_transform(c.reward_result.criterion_scores, lambda x: CASE WHEN x >= 0.5 THEN 1 ELSE 0 END) AS s FROM k
        WHERE coalesce(c.reward_result.num_parse_failures, 0) = 0 AND len(c.reward_result.criterion_scores) = len(rubric) AND len(rubric) > 0 AND len(list_filter(c.reward_result.criterion_scores, lambda x: x IS NULL)) = 0)
        SELECT record_id, candidate_id, array_to_string(list_transform(s, lambda v: CASE WHEN v = 1 THEN 'Y' ELSE 'N' END), '') AS labels,
          round(list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i] * abs(coalesce(rubric[i].weight, 1.0)))), 6) AS met FROM u""",
    "privileged_text": f"SELECT record_id, {_PRIVILEGED} AS text FROM response_bank",
    "spec_coverage": f"""WITH {_C}, m AS (SELECT lower(trim(c.candidate_id)) AS k, c FROM c)
        SELECT s.candidate_id, count(m.k) AS candidates, count(*) FILTER (m.k IS NOT NULL AND (m.c.model_name IS DISTINCT FROM s.model_name OR m.c.generation_mode IS DISTINCT FROM s.generation_mode
          OR m.c.temperature IS DISTINCT FROM s.temperature OR m.c.top_p IS DISTINCT FROM s.top_p)) AS different FROM candidate_specs s LEFT JOIN m ON m.k = lower(trim(s.candidate_id)) GROUP BY 1""",
    "rubric_groups": """SELECT record_id, g AS group_index, 3 * g AS group_start, least(3 * g + 3, n) AS group_end, least(3 * g + 3, n) - 3 * g AS rules FROM
        (SELECT record_id, len(rubric) AS n, unnest(range(0, (len(rubric) + 2) // 3)) AS g FROM response_bank WHERE len(rubric) > 0)""",
    "weighted_score": f"WITH {_C} SELECT record_id, cand_pos, round({_WS('s', 'w')}, 6) AS score FROM (SELECT *, c.reward_result.criterion_scores AS s, c.reward_result.criterion_weights AS w FROM c WHERE c.reward_result IS NOT NULL)",
    "candidate_text_profile": f"""WITH {_C} SELECT c.candidate_id AS candidate_id, count(*) AS n, round(avg(length(c.response)), 6) AS mean_chars, max(length(c.response)) AS max_chars, count(*) FILTER (contains(c.response, '<think>')) AS think_open,
        count(*) FILTER (contains(c.response, '</think>')) AS think_closed, count(*) FILTER (contains(c.response, '<think>') AND NOT contains(c.response, '</think>')) AS think_unclosed,
        CAST(sum(CASE WHEN c.response IS NULL THEN NULL WHEN regexp_replace(c.response, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') = '' THEN 0 ELSE floor(len(string_split_regex(regexp_replace(c.response, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), '[{_BLANK}]+')) * 1.3) END) AS BIGINT) AS rough_tokens
        FROM c WHERE c.candidate_id IS NOT NULL GROUP BY 1""",
    "score_summary": f"WITH {_C} SELECT lower(trim(c.model_name)) AS model, count(*) AS n, round(avg(c.score), 6) AS mean, round(min(c.score), 6) AS min, round(max(c.score), 6) AS max FROM c WHERE c.score IS NOT NULL GROUP BY 1",
    "run_summary": f"""WITH {_C} SELECT coalesce(c.reward_result.parse_source, 'none') AS parse_source, count(*) AS samples, count(*) FILTER (coalesce(c.reward_result.num_parse_failures, 0) = 0) AS clean,
        CAST(sum(coalesce(c.reward_result.num_parse_failures, 0)) AS BIGINT) AS failures, CAST(sum(coalesce(len(c.reward_result.criterion_scores), 0)) AS BIGINT) AS criteria,
        round(coalesce(CAST(sum(len(list_filter(c.reward_result.criterion_parse_ok, lambda x: x))) AS DOUBLE) / nullif(sum(len(c.reward_result.criterion_parse_ok)), 0), 0.0), 6) AS criterion_parse_rate, round(avg(c.reward_result.judge_attempts), 6) AS mean_attempts,
        count(*) FILTER (c.reward_result.fallback_used) AS fallbacks FROM c WHERE c.reward_result IS NOT NULL GROUP BY 1""",
    "format_criterion": f"""WITH u AS (SELECT record_id, i - 1 AS pos, rubric[i].title AS ti, rubric[i].description AS de, lower(concat_ws(' ', rubric[i].title, rubric[i].description)) AS t
          FROM (SELECT record_id, rubric, unnest(range(1, len(rubric) + 1)) AS i FROM response_bank) WHERE rubric[i] IS NOT NULL),
        v AS (SELECT *, coalesce(trim(regexp_replace(de, '\\s+', ' ', 'g')), '') AS d1, coalesce(trim(regexp_replace(ti, '\\s+', ' ', 'g')), '') AS t1, coalesce({_KIND}, 'unknown') AS kind FROM u),
        w AS (SELECT *, CASE WHEN t1 <> '' AND d1 <> '' THEN t1 || ': ' || d1 ELSE t1 || d1 END AS "full" FROM v),
        x AS (SELECT *, regexp_replace("full", '(?i)\\b(?:Essential|Important|Optional|Pitfall)\\s+Criteria\\s*:\\s*', '', 'g') AS c0, CASE WHEN d1 <> '' THEN d1 ELSE t1 END AS d2 FROM w)
        SELECT record_id, pos, kind, "full", trim(regexp_replace(c0, '\\s+', ' ', 'g')) AS compact, CASE WHEN t1 <> '' THEN t1 ELSE d1 END AS title_only, d2 AS description_only,
          trim(regexp_replace(CASE WHEN kind = 'pitfall' THEN 'The response avoids this pitfall: ' ELSE 'The response satisfies this criterion: ' END || c0, '\\s+', ' ', 'g')) AS canonical,
          CASE WHEN length(d2) <= 40 THEN d2 ELSE rtrim(substr(d2, 1, 37)) || '...' END AS short, regexp_replace(regexp_replace(lower(ti), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM x""",
    "criterion_listing": """SELECT record_id, array_to_string(list_transform(range(1, len(rubric) + 1), lambda i: i || '. ' || concat_ws(': ', nullif(trim(rubric[i].title), ''), nullif(trim(rubric[i].description), ''))), chr(10)) AS listing FROM response_bank WHERE len(rubric) > 0""",
    "question_ids": """SELECT record_id, 'q_' || substr(sha1(CASE WHEN coalesce(question, '') <> '' THEN question ELSE to_json(prompt)::VARCHAR END), 1, 16) AS key FROM response_bank""",
    "multiturn_text": """SELECT record_id, CASE WHEN len(prompt) = 1 THEN prompt[1].content ELSE array_to_string(list_transform(prompt, lambda m: upper(substr(m.role, 1, 1)) || lower(substr(m.role, 2)) || ': ' || m.content), chr(10)) END AS prompt,
        array_to_string(list_append(list_transform(prompt, lambda m: upper(substr(m.role, 1, 1)) || lower(substr(m.role, 2)) || ': ' || m.content), 'Assistant: ' || coalesce(reference_answer, '')), chr(10)) AS with_answer FROM response_bank WHERE len(prompt) > 0""",
    "boxed_scores": f"""WITH {_C}, u AS (SELECT record_id, cand_pos, c.response AS t, CASE WHEN regexp_matches(c.response, '\\\\boxed\\{{[^}}]+\\}}') THEN trim(regexp_extract(c.response, '\\\\boxed\\{{([^}}]+)\\}}', 1)) END AS b FROM c WHERE contains(c.response, 'boxed{{')),
        v AS (SELECT *, CASE WHEN regexp_matches(b, '(?i)^[+-]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:e[+-]?\\d+)?$') THEN TRY_CAST(b AS DOUBLE) END AS x, CASE WHEN regexp_matches(b, '^[+-]?\\d+$') THEN TRY_CAST(b AS INT) END AS i,
          list_filter(list_transform(regexp_extract_all(t, '(\\d+(?:\\.\\d+)?)', 1), lambda s: TRY_CAST(s AS DOUBLE)), lambda x: x >= 1 AND x <= 10)[1] AS y FROM u),
        w AS (SELECT *, CASE WHEN x IS NOT NULL THEN greatest(1.0, least(10.0, x)) END AS z, CASE WHEN i IN (0, 1) THEN i END AS k FROM v)
        SELECT record_id, cand_pos, b AS boxed, round((coalesce(z, y) - 1) / 9, 6) AS likert, round((z - 1) / 9, 6) AS strict_likert,
          CAST(coalesce(k, CASE WHEN regexp_matches(t, '\\b0\\b') THEN 0 WHEN regexp_matches(t, '\\b1\\b') THEN 1 END) AS INT) AS "binary", CAST(k AS INT) AS strict_binary FROM w""",
    "split_overlap": """SELECT id AS key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM (SELECT trim(question_id, ' ') AS id, lower(trim(split_role, ' ')) AS split FROM response_bank)
        WHERE id <> '' AND split IN ('train', 'dev', 'heldout', 'test') GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    "confusion_at_threshold": f"""WITH {_PR}, s AS (SELECT count(*) FILTER (label = 1 AND prob >= 0.6) AS tp, count(*) FILTER (label = 0 AND prob >= 0.6) AS fp, count(*) FILTER (label = 1 AND prob < 0.6) AS fn, count(*) FILTER (label = 0 AND prob < 0.6) AS tn FROM pr)
        SELECT tp, fp, fn, tn, {_classes()} FROM s""",
    "threshold_sweep": f"{_SWEEP} SELECT threshold, tp, fp, fn, tn, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(accuracy, 6) AS accuracy FROM z",
    "best_threshold": f"{_SWEEP} SELECT threshold, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(accuracy, 6) AS accuracy FROM z ORDER BY z.macro_f1 DESC, z.balanced_accuracy DESC, z.accuracy DESC, threshold <> 0.5, threshold LIMIT 1",
    "calibration_error": f"""WITH {_PR}, b AS (SELECT least(floor(prob * 10), 9) AS k, count(*) AS m, avg(prob) AS c, avg(label) AS a FROM pr GROUP BY 1)
        SELECT round(sum(m * abs(c - a)) / sum(m), 6) AS ece, CAST(sum(m) AS BIGINT) AS n FROM b""",
    "losses": f"""WITH {_PR}, q AS (SELECT *, ln(least(greatest(prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(prob, 1e-6), 1 - 1e-6))) AS z FROM pr)
        SELECT count(*) AS n, round(avg(greatest(z, 0.0) + ln(1 + exp(-abs(z))) - label * z), 6) AS nll, round(avg((prob - label) * (prob - label)), 6) AS brier, round(avg(prob), 6) AS mean_prob,
          round(avg(prob) FILTER (label = 1), 6) AS mean_prob_positive, round(avg(prob) FILTER (label = 0), 6) AS mean_prob_negative FROM q""",
    "choice_probability": f"""WITH e AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: -abs(CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) >= 16),
        l AS (SELECT vec_id, {', '.join(f"ln({' + '.join(f'exp((x[{2 * k + 1}] + x[{2 * k + 2}]) / {div})' for k in ks)}) AS {side}_{name}" for name, div in (('sum', '1.0'), ('mean', '2.0')) for side, ks in (('yes', range(4)), ('no', range(4, 8))))} FROM e)
        SELECT vec_id, {', '.join(f"round(1 / (1 + exp(no_{n} - yes_{n})), 6) AS p_{n}, CAST(CASE WHEN 1 / (1 + exp(no_{n} - yes_{n})) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS verdict_{n}" for n in ('sum', 'mean'))} FROM l""",
    "fallback_verdicts": "SELECT record_id, array_to_string(list_transform(rubric, lambda r: CASE WHEN coalesce(r.weight, 0.0) >= 3 THEN 'Y' ELSE 'N' END), '') AS verdicts FROM response_bank WHERE len(rubric) > 0",
    "rl_rows": f"""SELECT record_id, data_source, 'rubric' AS ability, 'rubric' AS style, length(coalesce(reference_answer, '')) AS truth_chars, lower(trim(split_role)) AS split, CAST(coalesce(len(rubric), 0) AS BIGINT) AS criteria,
        CASE WHEN len(prompt) > 0 THEN len(prompt) ELSE 1 END AS turns,
        length({_PRIVILEGED}) AS priv_chars,
        CASE WHEN lower(trim(split_role)) = 'test' THEN CAST(0.0 AS DOUBLE) END AS gated_reward, CAST(NULL AS DOUBLE) AS opted_reward FROM response_bank""",
    "split_fraction": f"WITH {_ORDER} SELECT question_id, CASE WHEN r < round_even(n * 0.4, 0) THEN 'train' WHEN r < round_even(n * 0.4, 0) + round_even(n * 0.1, 0) THEN 'dev' ELSE 'test' END AS split FROM o",
    "split_counts": f"WITH {_ORDER} SELECT question_id, CASE WHEN r < 30 THEN 'train' WHEN r < 40 THEN 'dev' ELSE 'test' END AS split FROM o",
    "split_ratio": f"WITH {_ORDER} SELECT question_id, CASE WHEN r < greatest(1, floor(n * 0.05)) THEN 'eval' ELSE 'train' END AS split FROM o",
    "split_nested": f"""WITH {_ORDER} SELECT question_id, train_size, split FROM (SELECT question_id, t AS train_size, CASE WHEN r < 5 THEN 'dev' WHEN r < 20 THEN 'heldout' WHEN r - 20 < t THEN 'train' END AS split
        FROM o, (SELECT CAST(unnest([10, 20, 40]) AS BIGINT) AS t)) WHERE split IS NOT NULL""",
    "split_sets": """WITH a AS (SELECT DISTINCT trim(question_id, ' ') AS id FROM response_bank WHERE trim(question_id, ' ') <> ''), b AS (SELECT DISTINCT trim(question_id, ' ') AS id FROM bench WHERE trim(question_id, ' ') <> '')
        SELECT 'both' AS part, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'bank_only', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
        UNION ALL SELECT 'bench_only', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'all', count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)""",
    "split_manifest": """SELECT lower(trim(split_role)) AS split, count(*) AS records, count(DISTINCT question_id) AS questions, CAST(sum(coalesce(len(candidates), 0)) AS BIGINT) AS candidates,
        round(CASE WHEN count(*) = 0 THEN 0.0 ELSE coalesce(CAST(sum(length(question)) AS DOUBLE) / count(*), 0.0) END, 6) AS mean_chars FROM response_bank GROUP BY 1""",
}
