"""Queries that build banks, prompts, audits, splits and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.functions import parse, prompt
from judgelake.functions import text as X
from judgelake.functions.num import ratio, six
from judgelake.operators import audit, banks, flatten, splitting, validate
from judgelake.plans.bank import bank_schema
from judgelake.plans.verdict_sql import reason_sql
from judgelake.runtime import read_table


def _bank(spark: SparkSession, d: str, top: str = "", candidate: str = "", result: str = "") -> DataFrame:
    return read_table(spark, d, "response_bank", bank_schema(top, candidate, result))


def failure_counters(spark: SparkSession, d: str) -> DataFrame:
    """Samples, parsed samples, fallbacks and reasons of failures: overall and by candidate id, in groups of rules overall
    and by their size, and the number of attempts. One pass over the candidates, one over the groups."""
    bank = _bank(spark, d, "rubric", "candidate_id", "raw_parse_success fallback_used raw_judge_response raw_judge_responses raw_judge_responses_by_group criterion_parse_ok")
    r = F.col("c.reward_result")
    rows = flatten.candidates(bank, "rubric").filter(r.isNotNull())
    attempts = F.coalesce(r["raw_judge_responses"], F.array(F.coalesce(r["raw_judge_response"], F.lit(""))))
    rows = rows.select(
        F.col("c.candidate_id").alias("key"), F.greatest(F.coalesce(F.size("rubric"), F.lit(0)), F.lit(0)).alias("n"), F.size(attempts).alias("attempts"), F.coalesce(F.try_element_at(attempts, F.lit(-1)), F.lit("")).alias("text"),
        F.coalesce(r["raw_parse_success"], F.lit(False)).alias("ok"), F.coalesce(r["fallback_used"], F.lit(False)).alias("fallback"), r["raw_judge_responses_by_group"].alias("groups"), r["criterion_parse_ok"].alias("parse_ok"),
    )
    counters = lambda ok, *more: F.array_compact(F.array(F.lit("total"), F.when(ok, "parsed"), *more))
    reason = lambda text, n: F.when(~F.col("ok"), F.concat(F.lit("reason:"), parse.failure(text, n)["reason"]))
    each = rows.select("key", F.explode(counters(F.col("ok"), F.when(F.col("fallback"), "fallback"), reason(F.col("text"), F.col("n")))).alias("counter"))
    by_sample = each.groupingSets([["counter"], ["key", "counter"]], "key", "counter").agg(F.grouping("key").alias("g"), F.count(F.lit(1)).alias("n"))
    out = by_sample.select(F.when(F.col("g") == 1, "overall").otherwise("candidate").alias("level"), "key", "counter", "n")
    group = rows.filter("not ok").select("parse_ok", F.explode("groups").alias("x")).filter("x is not null")
    size = (F.col("x.group_end") - F.col("x.group_start")).cast("int")
    part = F.slice("parse_ok", (F.col("x.group_start") + 1).cast("int"), size)
    group = group.filter(size > 0).select(size.alias("n"), F.coalesce((F.size("parse_ok") > 0) & F.forall(part, lambda v: F.coalesce(v, F.lit(False))), F.lit(False)).alias("ok"), F.coalesce("x.raw_judge_response", F.lit("")).alias("text"))
    told = group.select(F.col("n").cast("string").alias("key"), F.explode(counters(F.col("ok"), reason(F.col("text"), F.col("n")))).alias("counter"))
    by_group = told.groupingSets([["counter"], ["key", "counter"]], "key", "counter").agg(F.grouping("key").alias("g"), F.count(F.lit(1)).alias("n"))
    out = out.unionByName(by_group.select(F.when(F.col("g") == 1, "groups").otherwise("group_size").alias("level"), "key", "counter", "n"))
    tries = rows.groupBy(F.col("attempts").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(tries.select(F.lit("attempts").alias("level"), "key", F.lit("total").alias("counter"), "n"))


def failure_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 failures by record and place, with what their reasons are read off (a report)."""
    bank = _bank(spark, d, "rubric", "candidate_id", "raw_parse_success fallback_used raw_judge_response raw_judge_responses")
    r = F.col("c.reward_result")
    rows = flatten.candidates(bank, "rubric").filter(r.isNotNull() & ~F.coalesce(r["raw_parse_success"], F.lit(False)))
    attempts = F.coalesce(r["raw_judge_responses"], F.array(F.coalesce(r["raw_judge_response"], F.lit(""))))
    first = splitting.first_rows(rows.select("record_id", "cand_pos", F.col("c.candidate_id").alias("candidate_id"), F.greatest(F.coalesce(F.size("rubric"), F.lit(0)), F.lit(0)).alias("n"), F.coalesce(F.try_element_at(attempts, F.lit(-1)), F.lit("")).alias("text")), ["record_id", "cand_pos"], 40)
    made = first.withColumn("f", parse.failure(F.col("text"), F.col("n")))
    return made.select("record_id", "cand_pos", "candidate_id", "f.reason", F.col("f.chars").alias("chars"), F.substring("text", 1, 200).alias("starts_with"))


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of the three ways of asking a judge about the reference answer, and one filled place by place."""
    rows = _bank(spark, d, "question rubric reference_answer").filter("size(rubric) > 0")
    q, answer, rubric = F.col("question"), F.col("reference_answer"), F.col("rubric")
    legacy = prompt.replaced("Q: {question} / A: {response} / {rubric}", {"question": q, "response": F.concat(F.coalesce(answer, F.lit("")), F.lit(" {rubric}")), "rubric": X.criterion_listing(rubric)})
    return rows.select(
        "record_id", prompt.one_criterion(q, F.get(rubric, F.lit(0)), answer).alias("one"), prompt.all_criteria(q, rubric, answer).alias("all"), prompt.overall(q, rubric, answer).alias("overall"), legacy.alias("legacy"),
        X.one_line(answer).alias("clean"),
    )


def bench_criteria(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "bench", "record_id bigint, refined_rubric array<struct<type:string,rubric:string>>").select("record_id", F.posexplode("refined_rubric").alias("pos", "r")).filter("r is not null")
    hard = F.col("r.type") == "hard"
    return rows.select("record_id", F.col("pos").cast("bigint").alias("pos"), X.bench_criterion(F.col("r.rubric"), hard).alias("canonical"), X.bench_criterion(F.col("r.rubric"), hard, "full").alias("full"))


def spec_matrix(spark: SparkSession, d: str) -> DataFrame:
    models = [("Base 1B", "base/1b"), ("Small-4B", "small/4b")]
    return banks.spec_matrix(spark, models, [("Base 1B", "base/1b", 0.7, 0.95)])


def bank_build(spark: SparkSession, d: str) -> DataFrame:
    """A bank of every question with the reference answer and one candidate for each spec, in the specs' order."""
    specs = spec_matrix(spark, d)
    questions = _bank(spark, d, "question reference_answer").select("record_id", "question", "reference_answer")
    each = F.explode(F.array(*[F.lit(c) for c in ("base_1b_greedy", "small_4b_greedy", "base_1b_sampled")])).alias("candidate_id")
    responses = questions.select("record_id", each, F.coalesce("question", F.lit("")).alias("response"))
    made = banks.bank_build(questions, responses, specs, "record_id")
    return made.select("record_id", F.array_join(F.transform("candidates", lambda c: c["candidate_id"]), ",").alias("ids"), F.array_join(F.transform("candidates", lambda c: F.length(c["response"]).cast("string")), ",").alias("chars"))


def nested_bank(spark: SparkSession, d: str) -> DataFrame:
    """Criterion decisions put back into scored banks: candidates with score and reward_result."""
    bank = _bank(spark, d, "rubric", "candidate_id", "criterion_scores num_parse_failures")
    long = flatten.bank_items(bank).select("record_id", "candidate_id", "rule_index", F.col("label").cast("double").alias("prob"), F.col("label").cast("double").alias("score"), "weight")
    made = banks.nested_bank(long, bank.select("record_id", "rubric"), "record_id").select("record_id", F.inline("candidates"))
    r = F.col("reward_result")
    return made.select("record_id", "candidate_id", six(F.col("score")).alias("score"), F.size(r["criterion_scores"]).cast("bigint").alias("criteria"), X.verdict_letters(r["criterion_scores"]).alias("labels"))


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """An audit of gold labels (key) by the last judge's verdicts (sheet), each in its wide form and its own spelling."""
    rows = read_table(spark, d, "predictions", "model string, sample_id string, question_id string, gold_verdicts string, pred_verdicts string, raw_output string")
    last = rows.agg(F.max("model")).first()[0]
    vector = lambda c: F.from_json(F.nullif(F.trim(F.col(c)), F.lit("")), "array<int>")
    cell = lambda v, k, yes, no: F.when(F.get(v, F.lit(k)) == 1, yes).when(F.get(v, F.lit(k)) == 0, no)
    key = rows.filter("sample_id is not null").groupBy(F.col("sample_id").alias("item_id")).agg(F.min("question_id").alias("pair_id"), F.min("gold_verdicts").alias("gold_verdicts"))
    key = key.select("item_id", "pair_id", *[cell(vector("gold_verdicts"), k, "Yes", "no").alias(f"gpt_rule_{k + 1}") for k in range(6)], *[F.lit("3" if k < 2 else "").alias(f"rule_{k + 1}_weight") for k in range(6)])
    sheet = rows.filter((F.col("model") == last) & F.col("sample_id").isNotNull()).groupBy(F.col("sample_id").alias("item_id")).agg(F.max("pred_verdicts").alias("pred_verdicts"))
    sheet = sheet.select("item_id", *[cell(vector("pred_verdicts"), k, "TRUE ", "n").alias(f"human_rule_{k + 1}") for k in range(5)], F.when(F.get(vector("pred_verdicts"), F.lit(5)) == 1, "y").otherwise("?").alias("human_rule_6"))
    return audit.joined(key, sheet)


def audit_criteria(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.agreement(_audit(spark, d))
    return rows.withColumns({c: six(F.col(c)) for c in ("agreement", "weighted_agreement")})


def audit_items(spark: SparkSession, d: str) -> DataFrame:
    items = audit.items(_audit(spark, d))
    pairs = audit.preferences(items)
    out = audit.scores(items).select("items_complete", six(F.col("score_mae_norm")).alias("score_mae_norm"), six(F.col("score_pearson_norm")).alias("score_pearson_norm"), F.lit(1).alias("k"))
    return out.join(pairs.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


def split_exact(spark: SparkSession, d: str) -> DataFrame:
    ids = _bank(spark, d)
    n = ids.filter("question_id is not null").select("question_id").distinct().count()
    return splitting.exact_split(ids, "question_id", {"train": n - n // 4 - n // 8, "val": n // 8, "test": n // 4})


def split_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = _bank(spark, d, "data_source")
    return splitting.role_split(rows, "question_id", ["record_id"], 8, 12).select("record_id", "question_id", "split_role")


def split_from_ids(spark: SparkSession, d: str) -> DataFrame:
    """Records by the lists of ids of a split by counts."""
    rows = _bank(spark, d, "data_source")
    made = splitting.count_split(rows, "question_id", {"train": 30, "dev": 10}, "heldout")
    parts = {name: made.filter(F.col("split") == name).select("question_id") for name in ("train", "dev", "heldout")}
    return splitting.split_from_ids(rows.filter("question_id is not null"), "question_id", parts, cover=True).select("record_id", "split")


def release_checks(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each split, candidate ids and roles against what a release says of them, counted by check."""
    bank = _bank(spark, d, "split_role", "candidate_id")
    first = flatten.first_of_each(bank.filter("question_id is not null").select("question_id", "record_id", "split_role"), ["question_id"], ["record_id"])
    told = splitting.fraction_split(bank, "question_id", {"train": 0.5, "dev": 0.5}).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()  # two splits
    checks = validate.expected_counts(first, "split_role", {r["split"]: r["n"] for r in told})
    checks = checks.unionByName(validate.candidate_ids_equal(bank, "record_id", ["reference_answer"]))
    checks = checks.unionByName(validate.role_consistent(bank.select("question_id", "split_role"), first, "question_id", "split_role"))
    return checks.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def first_samples(spark: SparkSession, d: str) -> DataFrame:
    """Three small reports: the first 20 records, the first 20 with a rubric of 5 or more, 20 such in hashed order."""
    rows = _bank(spark, d, "rubric").select("record_id", "rubric")
    large = F.size("rubric") >= 5
    parts = [("first", splitting.first_rows(rows, ["record_id"], 20)), ("large", splitting.first_rows(rows, ["record_id"], 20, large)), ("drawn", splitting.shuffled_rows(rows, "record_id", 20, large))]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("part"), "record_id")
        out = one if out is None else out.unionByName(one)
    return out


def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """The records of 25 questions drawn by hashed order (a sample)."""
    return splitting.sample_rows(_bank(spark, d).filter("question_id is not null"), "question_id", 25).select("record_id", "question_id")


def number_order(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the bench whose ids are whole numbers, in the numbers' order, with the distinct models of their answers."""
    rows = read_table(spark, d, "bench", "record_id bigint, question_id string, answers array<struct<model:string>>").filter(F.col("question_id").rlike(r"^\d{1,17}$"))
    ordered = splitting.by_number(rows, "question_id")
    models = F.filter(F.transform("answers", lambda a: a["model"]), lambda m: m.isNotNull())
    return ordered.select("record_id", F.col("question_id").cast("bigint").alias("number"), F.array_join(splitting.distinct_in_order(models), ",").alias("models"))


def suite_report(spark: SparkSession, d: str) -> DataFrame:
    """Each judge's run with the figures of rule kinds, where they are known, and its first question by name."""
    runs = read_table(spark, d, "predictions", "model string, question_id string, parse_ok boolean, rule_matches bigint, num_rules bigint")
    ok = F.coalesce("parse_ok", F.lit(False))
    run = runs.groupBy("model").agg(F.count(F.lit(1)).alias("n"), six(ratio(F.count_if(ok), F.count(F.lit(1)))).alias("parse_rate"))
    path = runs.filter("question_id is not null").groupBy("model", F.col("question_id").alias("path")).agg(six(ratio(F.sum(F.when(ok, F.col("rule_matches"))), F.sum(F.when(ok, F.col("num_rules"))))).alias("hamming"))
    first = flatten.first_of_each(path, ["model"], ["path"])
    kinds = _kinds(spark, d).filter("hard_rules > 0")
    return run.join(first, "model", "left").join(kinds, "model", "left")


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    rubric = read_table(spark, d, "bench", "record_id bigint, question_id string, refined_rubric array<struct<type:string>>").filter("question_id is not null and size(refined_rubric) > 0")
    hard = flatten.first_of_each(rubric.select("question_id", "record_id", F.size(F.filter("refined_rubric", lambda r: r["type"] == "hard")).cast("bigint").alias("hard")), ["question_id"], ["record_id"])
    return read_table(spark, d, "predictions", "model string, question_id string").join(hard, "question_id").groupBy("model").agg(F.sum("hard").alias("hard_rules"))


QUERIES = {
    f.__name__: f
    for f in (
        failure_counters, failure_examples, prompt_texts, bench_criteria, spec_matrix, bank_build, nested_bank, audit_criteria, audit_items, split_exact, split_roles, split_from_ids, release_checks, first_samples,
        sampled_rows, number_order, suite_report,
    )
}

_C = "c AS (SELECT record_id, question_id, rubric, i - 1 AS cand_pos, c FROM (SELECT *, unnest(candidates) AS c, generate_subscripts(candidates, 1) AS i FROM response_bank) WHERE c IS NOT NULL)"
_ORDER = "o AS (SELECT question_id, row_number() OVER (ORDER BY sha256('42:' || question_id), question_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT question_id FROM response_bank WHERE question_id IS NOT NULL))"
_RATE = lambda a, b: f"round(CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE coalesce(CAST({a} AS DOUBLE) / {b}, 0.0) END, 6)"
_LIST = "array_to_string(list_transform(range(1, len(rubric) + 1), lambda i: i || '. ' || concat_ws(': ', nullif(trim(rubric[i].title), ''), nullif(trim(rubric[i].description), ''))), chr(10))"
_AUDIT = """a AS (SELECT sample_id AS item, min(question_id) AS pair, CAST(nullif(trim(min(gold_verdicts)), '') AS INT[]) AS g FROM predictions WHERE sample_id IS NOT NULL GROUP BY 1),
    b AS (SELECT sample_id AS item, CAST(nullif(trim(max(pred_verdicts)), '') AS INT[]) AS p FROM predictions WHERE sample_id IS NOT NULL AND model = (SELECT max(model) FROM predictions) GROUP BY 1),
    u AS (SELECT a.item, pair, k AS rule, CASE WHEN k < 3 THEN CAST(3.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS w, CASE g[k] WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE '' END AS judge,
        CASE WHEN b.item IS NULL THEN '' WHEN k = 6 THEN CASE WHEN p[6] = 1 THEN 'Yes' ELSE 'Unsure' END WHEN p[k] = 1 THEN 'Yes' WHEN p[k] = 0 THEN 'No' ELSE '' END AS human
        FROM (SELECT *, unnest(range(1, 7)) AS k FROM a) a LEFT JOIN b USING (item))"""

ORACLE = {
    "failure_counters": f"""WITH {_C}, s AS (SELECT c.candidate_id AS key, coalesce(len(rubric), 0) AS n, coalesce(c.reward_result.raw_judge_responses, [coalesce(c.reward_result.raw_judge_response, '')]) AS tries, c.reward_result AS r FROM c WHERE c.reward_result IS NOT NULL),
        t AS MATERIALIZED (SELECT key, n, len(tries) AS k, coalesce(tries[-1], '') AS text, coalesce(r.raw_parse_success, false) AS ok, coalesce(r.fallback_used, false) AS fb, r FROM s),
        x AS (SELECT key, 'total' AS counter FROM t UNION ALL SELECT key, 'parsed' FROM t WHERE ok UNION ALL SELECT key, 'fallback' FROM t WHERE fb UNION ALL SELECT key, 'reason:' || {reason_sql('text', 'n')} FROM t WHERE NOT ok),
        g0 AS (SELECT r, unnest(r.raw_judge_responses_by_group) AS g FROM t WHERE NOT ok),
        g AS MATERIALIZED (SELECT CAST(g.group_end - g.group_start AS INT) AS n, coalesce(len(r.criterion_parse_ok) > 0 AND len(list_filter(r.criterion_parse_ok[g.group_start + 1:g.group_end], lambda v: NOT coalesce(v, false))) = 0, false) AS ok, coalesce(g.raw_judge_response, '') AS text
          FROM g0 WHERE g IS NOT NULL AND g.group_end - g.group_start > 0),
        y AS (SELECT CAST(n AS VARCHAR) AS key, 'total' AS counter FROM g UNION ALL SELECT CAST(n AS VARCHAR), 'parsed' FROM g WHERE ok UNION ALL SELECT CAST(n AS VARCHAR), 'reason:' || {reason_sql('text', 'n')} FROM g WHERE NOT ok)
        SELECT 'overall' AS level, NULL AS key, counter, count(*) AS n FROM x GROUP BY counter UNION ALL SELECT 'candidate', key, counter, count(*) FROM x GROUP BY key, counter
        UNION ALL SELECT 'groups', NULL, counter, count(*) FROM y GROUP BY counter UNION ALL SELECT 'group_size', key, counter, count(*) FROM y GROUP BY key, counter
        UNION ALL SELECT 'attempts', CAST(k AS VARCHAR), 'total', count(*) FROM t GROUP BY k""",
    "failure_examples": f"""WITH {_C}, s AS (SELECT record_id, cand_pos, c.candidate_id AS candidate_id, coalesce(len(rubric), 0) AS n, coalesce(coalesce(c.reward_result.raw_judge_responses, [coalesce(c.reward_result.raw_judge_response, '')])[-1], '') AS text
          FROM c WHERE c.reward_result IS NOT NULL AND NOT coalesce(c.reward_result.raw_parse_success, false) ORDER BY record_id, cand_pos LIMIT 40)
        SELECT record_id, cand_pos, candidate_id, {reason_sql('text', 'n')} AS reason, length(text) AS chars, substr(text, 1, 200) AS starts_with FROM s""",
    "prompt_texts": f"""WITH b AS (SELECT record_id, coalesce(question, '') AS q, coalesce(reference_answer, '') AS a, rubric, {_LIST} AS listed FROM response_bank WHERE len(rubric) > 0)
        SELECT record_id, 'Question:' || chr(10) || q || chr(10) || chr(10) || 'Criterion: ' || coalesce(rubric[1].title, '') || chr(10) || coalesce(rubric[1].description, '') || chr(10) || chr(10) || 'Response:' || chr(10) || a || chr(10) || chr(10) || 'Does the response meet the criterion? End with \\boxed{{1}} or \\boxed{{0}}.' AS one,
          'Question:' || chr(10) || q || chr(10) || chr(10) || 'Rules (' || len(rubric) || '):' || chr(10) || listed || chr(10) || chr(10) || 'Response:' || chr(10) || a || chr(10) || chr(10) || 'For every rule write one line: Rule i: <reason>. Verdict: Yes or No' AS "all",
          'Question:' || chr(10) || q || chr(10) || chr(10) || 'Criteria:' || chr(10) || listed || chr(10) || chr(10) || 'Response:' || chr(10) || a || chr(10) || chr(10) || 'Rate the response from 1 to 10. End with \\boxed{{score}}.' AS overall,
          replace(replace(replace('Q: {{question}} / A: {{response}} / {{rubric}}', '{{question}}', q), '{{response}}', a || ' {{rubric}}'), '{{rubric}}', listed) AS legacy, regexp_replace(regexp_replace(a, '[\\r\\n]+', ' ', 'g'), '^[\\s\\pZ\\x{{85}}]+|[\\s\\pZ\\x{{85}}]+$', '', 'g') AS clean FROM b""",
    "bench_criteria": """WITH u AS (SELECT record_id, i - 1 AS pos, refined_rubric[i] AS r FROM (SELECT record_id, refined_rubric, unnest(range(1, len(refined_rubric) + 1)) AS i FROM bench)),
        v AS (SELECT record_id, pos, trim(regexp_replace(coalesce(r.rubric, ''), '\\s+', ' ', 'g')) AS t, coalesce(r.type = 'hard', false) AS h FROM u WHERE r IS NOT NULL)
        SELECT record_id, pos, 'The response satisfies this ' || CASE WHEN h THEN 'hard' ELSE 'soft' END || ' rule: ' || t AS canonical, t || CASE WHEN h THEN ' [Hard Rule]' ELSE ' [Soft Rule]' END AS "full" FROM v""",
    "spec_matrix": """SELECT * FROM (VALUES ('base_1b_greedy', 'Base 1B', 'base/1b', 'greedy', CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE), 0), ('small_4b_greedy', 'Small-4B', 'small/4b', 'greedy', 0.0, 1.0, 1), ('base_1b_sampled', 'Base 1B', 'base/1b', 'sampled', 0.7, 0.95, 2))
        t(candidate_id, model_name, model_path, generation_mode, temperature, top_p, place)""",
    "bank_build": """SELECT record_id, 'reference_answer,base_1b_greedy,small_4b_greedy,base_1b_sampled' AS ids, concat_ws(',', length(coalesce(reference_answer, '')), length(coalesce(question, '')), length(coalesce(question, '')), length(coalesce(question, ''))) AS chars FROM response_bank""",
    "nested_bank": f"""WITH {_C}, k AS (SELECT * FROM (SELECT record_id, rubric, c.candidate_id AS candidate_id, c.reward_result.criterion_scores AS s, c.reward_result.num_parse_failures AS f, row_number() OVER (PARTITION BY record_id, c.candidate_id ORDER BY cand_pos DESC) AS rn FROM c WHERE c.candidate_id IS NOT NULL) WHERE rn = 1),
        g AS (SELECT record_id, candidate_id, list_transform(s, lambda x: CASE WHEN x >= 0.5 THEN 1 ELSE 0 END) AS v, list_transform(rubric, lambda x: abs(coalesce(x.weight, 1.0))) AS w FROM k WHERE coalesce(f, 0) = 0 AND len(s) = len(rubric) AND len(rubric) > 0 AND len(list_filter(s, lambda x: x IS NULL)) = 0)
        SELECT record_id, candidate_id, round(CASE WHEN list_sum(w) = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * w[i])) / list_sum(w) END, 6) AS score, len(v) AS criteria, array_to_string(list_transform(v, lambda x: CASE WHEN x = 1 THEN 'Y' ELSE 'N' END), '') AS labels FROM g""",
    "audit_criteria": f"""WITH {_AUDIT}
        SELECT rule, count(*) FILTER (human IN ('Yes', 'No')) AS compared, count(*) FILTER (human = '') AS missing, count(*) FILTER (human = 'Unsure') AS unsure,
          round(CAST(count(*) FILTER (human IN ('Yes', 'No') AND human = judge) AS DOUBLE) / nullif(count(*) FILTER (human IN ('Yes', 'No')), 0), 6) AS agreement,
          round(coalesce(sum(w) FILTER (human IN ('Yes', 'No') AND human = judge), 0) / nullif(sum(w) FILTER (human IN ('Yes', 'No')), 0), 6) AS weighted_agreement,
          {', '.join(f"count(*) FILTER (judge = '{j}' AND human = '{h}') AS {j.lower()}_{h.lower()}" for j in ('Yes', 'No') for h in ('Yes', 'No'))} FROM u GROUP BY GROUPING SETS ((), (rule))""",
    "audit_items": f"""WITH {_AUDIT}, i AS (SELECT item, pair, bool_and(human IN ('Yes', 'No')) AS complete, sum(CASE WHEN judge = 'Yes' THEN w ELSE 0 END) AS j, sum(CASE WHEN human = 'Yes' THEN w ELSE 0 END) AS h, sum(w) AS most FROM u GROUP BY 1, 2),
        q AS (SELECT pair, sign(arg_min(j, item) - arg_max(j, item)) AS dj, sign(arg_min(h, item) - arg_max(h, item)) AS dh FROM i WHERE complete GROUP BY 1 HAVING count(*) = 2)
        SELECT count(*) AS items_complete, round(avg(abs(h / most - j / most)), 6) AS score_mae_norm, round(CASE WHEN stddev_pop(h / most) * stddev_pop(j / most) > 0 THEN covar_pop(h / most, j / most) / (stddev_pop(h / most) * stddev_pop(j / most)) END, 6) AS score_pearson_norm,
          (SELECT count(*) FROM q WHERE dj <> 0 AND dh <> 0) AS pairs, (SELECT count(*) FROM q WHERE dj <> 0 AND dh = dj) AS agree, (SELECT count(*) FROM q WHERE dh = 0) AS human_ties, (SELECT count(*) FROM q WHERE dj = 0) AS judge_ties FROM i WHERE complete""",
    "split_exact": f"WITH {_ORDER} SELECT question_id, CASE WHEN r < n - n // 4 - n // 8 THEN 'train' WHEN r < n - n // 4 THEN 'val' ELSE 'test' END AS split FROM o",
    "split_roles": f"WITH {_ORDER} SELECT min(record_id) AS record_id, question_id, CASE WHEN r < 8 THEN 'dev' ELSE 'test' END AS split_role FROM response_bank JOIN o USING (question_id) WHERE r < 20 GROUP BY question_id, r",
    "split_from_ids": f"WITH {_ORDER} SELECT record_id, CASE WHEN r < 30 THEN 'train' WHEN r < 40 THEN 'dev' ELSE 'heldout' END AS split FROM response_bank JOIN o USING (question_id)",
    "release_checks": """WITH f AS (SELECT question_id, arg_min({'r': split_role}, record_id).r AS told FROM response_bank WHERE question_id IS NOT NULL GROUP BY 1),
        n AS (SELECT count(*) AS n FROM f), w AS (SELECT 'train' AS split, CAST(round_even(n * 0.5, 0) AS BIGINT) AS m FROM n UNION ALL SELECT 'dev', n - CAST(round_even(n * 0.5, 0) AS BIGINT) FROM n),
        g AS (SELECT told AS split, count(*) AS k FROM f GROUP BY 1)
        SELECT 'split_count' AS "check", count(*) AS n FROM (SELECT coalesce(m, 0) AS m, coalesce(k, 0) AS k FROM w FULL JOIN g USING (split)) WHERE m <> k HAVING count(*) > 0
        UNION ALL SELECT 'candidate_ids', count(*) FROM response_bank WHERE coalesce(list_transform(candidates, lambda c: coalesce(c.candidate_id, '')), []) <> ['reference_answer'] HAVING count(*) > 0
        UNION ALL SELECT 'role_differs', count(*) FROM response_bank b LEFT JOIN f USING (question_id) WHERE b.split_role IS DISTINCT FROM told HAVING count(*) > 0""",
    "first_samples": """SELECT 'first' AS part, record_id FROM (SELECT record_id FROM response_bank ORDER BY record_id LIMIT 20) UNION ALL SELECT 'large', record_id FROM (SELECT record_id FROM response_bank WHERE len(rubric) >= 5 ORDER BY record_id LIMIT 20)
        UNION ALL SELECT 'drawn', record_id FROM (SELECT record_id FROM response_bank WHERE len(rubric) >= 5 ORDER BY sha256('42:' || record_id), record_id LIMIT 20)""",
    "sampled_rows": f"WITH {_ORDER} SELECT record_id, question_id FROM response_bank JOIN o USING (question_id) WHERE r < 25",
    "number_order": """WITH b AS (SELECT record_id, CAST(question_id AS BIGINT) AS number, list_filter(list_transform(answers, lambda a: a.model), lambda m: m IS NOT NULL) AS ms FROM bench WHERE regexp_matches(question_id, '^\\d{1,17}$'))
        SELECT record_id, number, array_to_string(list_transform(list_filter(list_transform(range(1, len(ms) + 1), lambda i: {'i': i, 'm': ms[i]}), lambda x: list_position(ms, x.m) = x.i), lambda x: x.m), ',') AS models FROM b""",
    "suite_report": f"""WITH r AS (SELECT model, count(*) AS n, {_RATE('count(*) FILTER (coalesce(parse_ok, false))', 'count(*)')} AS parse_rate FROM predictions GROUP BY 1),
        p AS (SELECT model, question_id AS path, {_RATE('sum(rule_matches) FILTER (coalesce(parse_ok, false))', 'sum(num_rules) FILTER (coalesce(parse_ok, false))')} AS hamming FROM predictions WHERE question_id IS NOT NULL GROUP BY 1, 2),
        f AS (SELECT model, min(path) AS path, arg_min(hamming, path) AS hamming FROM p GROUP BY 1),
        b AS (SELECT question_id, arg_min(len(list_filter(refined_rubric, lambda x: x.type = 'hard')), record_id) AS hard FROM bench WHERE question_id IS NOT NULL AND len(refined_rubric) > 0 GROUP BY 1),
        k AS (SELECT model, CAST(sum(hard) AS BIGINT) AS hard_rules FROM predictions JOIN b USING (question_id) GROUP BY 1 HAVING sum(hard) > 0)
        SELECT r.model, n, parse_rate, path, hamming, hard_rules FROM r LEFT JOIN f USING (model) LEFT JOIN k USING (model)""",
}
