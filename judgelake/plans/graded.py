"""Queries over graded questions (bench)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.functions import text as X
from judgelake.operators import flatten, splitting
from judgelake.runtime import read_table


TOP = {"question_id": "string", "question": "string", "original_rubric": "string", "ingested_at": "timestamp"}
RULE = {"rule_id": "string", "type": "string", "rubric": "string"}
ANSWER = {"answer_id": "bigint", "model": "string", "answer_text": "string", "total_score": "bigint"}
GRADE = {"rule_id": "bigint", "type": "string", "justification": "string", "verdict": "string"}


def _bench(spark: SparkSession, d: str, top: str = "", rule: str = "", answer: str = "", grade: str = "") -> DataFrame:
    """The bench with the named fields only, so that a scan reads no other column."""
    told = lambda kinds, names: [f"{c}:{kinds[c]}" for c in names.split()]
    columns = ["record_id bigint", *(f"{c} {TOP[c]}" for c in top.split())]
    if rule:
        columns.append(f"refined_rubric array<struct<{','.join(told(RULE, rule))}>>")
    inner = told(ANSWER, answer) + ([f"grade:array<struct<{','.join(told(GRADE, grade))}>>"] if grade else [])
    if inner:
        columns.append(f"answers array<struct<{','.join(inner)}>>")
    return read_table(spark, d, "bench", ", ".join(columns))


def _samples(spark: SparkSession, d: str, rule: str = "rule_id type") -> DataFrame:
    return flatten.flatten_samples(_bench(spark, d, "question_id", rule, "answer_id total_score", "rule_id verdict"), texts=False)


def flatten_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d)
    return rows.select(
        "record_id", "pos", "sample_id", "question_id", "answer_id", "num_rules", "gold_total_score",
        X.verdict_letters(F.col("gold_verdicts")).alias("gold_yn"), F.array_join("rule_weights", ",").alias("weights"),
    )


def criterion_items(spark: SparkSession, d: str) -> DataFrame:
    return flatten.criterion_items(_samples(spark, d))


def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose answer 1 has 10 points, answer 2 at most 3, and any answer 2 to 8."""
    total = lambda i: F.try_element_at(F.filter("answers", lambda a: a["answer_id"] == i), F.lit(1))["total_score"]
    middle = F.exists("answers", lambda a: F.coalesce(a["total_score"].between(2, 8), F.lit(False)))
    return _bench(spark, d, "question_id", "", "answer_id total_score").filter((total(1) == 10) & (total(2) <= 3) & middle).select("record_id", "question_id")


def mixed_quality(spark: SparkSession, d: str) -> DataFrame:
    """The same filter with points as parameters: best answer at least 8, worst at most 3."""
    totals = F.transform("answers", lambda a: a["total_score"])
    return _bench(spark, d, "question_id", "", "total_score").filter((F.array_max(totals) >= 8) & (F.array_min(totals) <= 3)).select(
        "record_id", "question_id", F.array_max(totals).alias("best"), F.array_min(totals).alias("worst")
    )


def refined_valid(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t: F.size(F.filter("refined_rubric", lambda r: r["type"] == t))
    ok = (F.size("refined_rubric") == 6) & (count("hard") == 2) & (count("soft") == 4)
    return _bench(spark, d, "", "type").select("record_id", F.coalesce(ok, F.lit(False)).alias("valid"))


def hard_rule_count(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count("original_rubric", F.lit(r"\[Hard Rule\]")).cast("bigint")
    return _bench(spark, d, "original_rubric").filter(n == 2).select("record_id", n.alias("hard_rules"))


def merge_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries put together, the first of each question by time of arrival stays."""
    rows = _bench(spark, d, "question_id ingested_at")
    first = rows.filter(F.col("record_id") % 2 == 0).select("record_id", "question_id", "ingested_at")
    second = rows.filter(F.col("record_id") % 2 == 1).select("record_id", "question_id", "ingested_at")
    merged = first.unionByName(second).filter("question_id is not null")
    return flatten.first_of_each(merged, ["question_id"], ["ingested_at", "record_id"]).select("record_id", "question_id")


def rubric_listing(spark: SparkSession, d: str) -> DataFrame:
    return _bench(spark, d, "", "rubric type").filter(F.size("refined_rubric") > 0).select("record_id", X.rubric_listing(F.col("refined_rubric")).alias("listing"))


def sft_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d, "rule_id type rubric")
    return rows.select("record_id", "pos", X.sft_lines(F.col("refined_rubric"), F.col("gold_verdicts"), 60).alias("target"))


def grade_totals(spark: SparkSession, d: str) -> DataFrame:
    """Points of each answer from its grades: 3 for a hard rule, 1 for any other or unknown rule that is met."""
    rows = _bench(spark, d, "", "rule_id type", "total_score", "rule_id verdict").select("record_id", "refined_rubric", F.posexplode("answers").alias("pos", "a")).filter("a is not null")
    kind = lambda g: F.try_element_at(F.filter("refined_rubric", lambda r: r["rule_id"] == g["rule_id"].cast("string")), F.lit(1))["type"]
    points = lambda g: F.when(F.lower(F.trim(g["verdict"])) == "yes", F.when(kind(g) == "hard", 3).otherwise(1)).otherwise(0)
    total = F.aggregate(F.coalesce("a.grade", F.expr("array()")), F.lit(0).cast("bigint"), lambda s, g: s + points(g))
    return rows.select("record_id", F.col("pos").cast("bigint").alias("pos"), total.alias("points"), F.col("a.total_score").alias("stored"))


def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of rubric sizes with hard and soft rules and answers."""
    count = lambda t: F.coalesce(F.size(F.filter("refined_rubric", lambda r: r["type"] == t)), F.lit(0))
    n = F.coalesce(F.size("refined_rubric"), F.lit(0))
    return _bench(spark, d, "", "type", "answer_id").groupBy(n.cast("bigint").alias("rules"), count("hard").cast("bigint").alias("hard"), count("soft").cast("bigint").alias("soft")).agg(
        F.count(F.lit(1)).alias("questions"), F.sum(F.coalesce(F.size("answers"), F.lit(0))).alias("answers")
    )


def graded_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Every question with the number of its graded answers; none is 0."""
    rows = _bench(spark, d, "", "", "", "rule_id")
    graded = rows.select("record_id", F.explode("answers").alias("a")).filter("size(a.grade) > 0").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("record_id").join(graded, "record_id", "left").select("record_id", F.coalesce("n", F.lit(0)).alias("graded"))


def verdict_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of verdicts with what they are read as."""
    grades = _bench(spark, d, "", "", "", "verdict").select(F.explode("answers").alias("a")).select(F.explode("a.grade").alias("g"))
    return grades.groupBy(F.col("g.verdict").alias("spelling")).agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", X.token(F.col("spelling")).cast("bigint"))


def sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return splitting.sample_pairs(_samples(spark, d), 50)


QUERIES = {
    f.__name__: f
    for f in (
        flatten_samples, criterion_items, quality_filter, mixed_quality, refined_valid, hard_rule_count, merge_dedup, rubric_listing, sft_targets,
        grade_totals, dataset_profile, graded_left_join, verdict_spellings, sampled_pairs,
    )
}

_SAMPLES = """
    s0 AS (SELECT record_id, question_id, refined_rubric, generate_subscripts(answers, 1) - 1 AS pos, unnest(answers) AS a FROM bench WHERE len(refined_rubric) > 0),
    s AS (SELECT record_id, pos, question_id, refined_rubric, coalesce(a.answer_id, -1) AS answer_id, a.total_score AS stored,
            coalesce(question_id, '') || '_' || coalesce(a.answer_id, -1) AS sample_id,
            list_transform(range(1, len(refined_rubric) + 1), lambda i: CASE WHEN lower(trim(
                (list_filter(coalesce(a.grade, []), lambda g: CAST(g.rule_id AS VARCHAR) = coalesce(refined_rubric[i].rule_id, CAST(i AS VARCHAR)))[-1]).verdict)) = 'yes' THEN 1 ELSE 0 END) AS gold,
            list_transform(refined_rubric, lambda r: CASE WHEN r.type = 'hard' THEN 3 ELSE 1 END) AS w
          FROM s0 WHERE a IS NOT NULL),
    t AS (SELECT *, CAST(list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * gold[i])) AS BIGINT) AS computed FROM s)"""

ORACLE = {
    "flatten_samples": f"""WITH {_SAMPLES}
        SELECT record_id, pos, sample_id, question_id, answer_id, CAST(len(refined_rubric) AS BIGINT) AS num_rules, coalesce(stored, computed) AS gold_total_score,
               array_to_string(list_transform(gold, lambda v: CASE WHEN v = 1 THEN 'Y' ELSE 'N' END), '') AS gold_yn, array_to_string(w, ',') AS weights FROM t""",
    "criterion_items": f"""WITH {_SAMPLES}
        SELECT record_id, pos, sample_id, i - 1 AS rule_index, refined_rubric[i].rule_id AS rule_id, refined_rubric[i].type AS rule_type,
               CAST(w[i] AS BIGINT) AS weight, CAST(gold[i] AS BIGINT) AS gold FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)""",
    "quality_filter": """
        SELECT record_id, question_id FROM bench WHERE (list_filter(answers, lambda a: a.answer_id = 1)[1]).total_score = 10
          AND (list_filter(answers, lambda a: a.answer_id = 2)[1]).total_score <= 3 AND len(list_filter(answers, lambda a: a.total_score BETWEEN 2 AND 8)) > 0""",
    "mixed_quality": """
        SELECT record_id, question_id, best, worst FROM (SELECT record_id, question_id, list_max(list_transform(answers, lambda a: a.total_score)) AS best,
          list_min(list_transform(answers, lambda a: a.total_score)) AS worst FROM bench) WHERE best >= 8 AND worst <= 3""",
    "refined_valid": """
        SELECT record_id, coalesce(len(refined_rubric) = 6 AND len(list_filter(refined_rubric, lambda r: r.type = 'hard')) = 2
          AND len(list_filter(refined_rubric, lambda r: r.type = 'soft')) = 4, false) AS valid FROM bench""",
    "hard_rule_count": """
        SELECT record_id, n AS hard_rules FROM (SELECT record_id, CAST((length(original_rubric) - length(replace(original_rubric, '[Hard Rule]', ''))) // 11 AS BIGINT) AS n FROM bench) WHERE n = 2""",
    "merge_dedup": """
        SELECT record_id, question_id FROM (SELECT record_id, question_id, row_number() OVER (PARTITION BY question_id ORDER BY ingested_at NULLS FIRST, record_id) AS k
          FROM bench WHERE question_id IS NOT NULL AND record_id % 2 IN (0, 1)) WHERE k = 1""",
    "rubric_listing": """
        SELECT record_id, array_to_string(list_transform(range(1, len(refined_rubric) + 1), lambda i: i || '. ' || coalesce(refined_rubric[i].rubric, '')
          || CASE WHEN refined_rubric[i].type = 'hard' THEN ' [Hard Rule]' ELSE ' [Soft Rule]' END), chr(10)) AS listing FROM bench WHERE len(refined_rubric) > 0""",
    "sft_targets": f"""WITH {_SAMPLES},
        u AS (SELECT record_id, pos, gold, list_transform(refined_rubric, lambda r: trim(regexp_replace(r.rubric, '\\s+', ' ', 'g'))) AS rs FROM t),
        v AS (SELECT record_id, pos, gold, list_transform(rs, lambda x: CASE WHEN length(x) <= 60 THEN x ELSE rtrim(substr(x, 1, 57)) || '...' END) AS rs FROM u)
        SELECT record_id, pos, array_to_string(list_transform(range(1, len(rs) + 1), lambda i: 'Rule ' || i || ': ' || rs[i]
          || CASE WHEN regexp_matches(rs[i], '[.!?]$') THEN '' ELSE '.' END || ' Verdict: ' || CASE WHEN gold[i] = 1 THEN 'Yes' ELSE 'No' END), chr(10)) AS target FROM v""",
    "grade_totals": """
        SELECT record_id, pos, CAST(coalesce(list_sum(list_transform(coalesce(a.grade, []), lambda g: CASE WHEN lower(trim(g.verdict)) = 'yes' THEN
            CASE WHEN (list_filter(refined_rubric, lambda r: r.rule_id = CAST(g.rule_id AS VARCHAR))[1]).type = 'hard' THEN 3 ELSE 1 END ELSE 0 END)), 0) AS BIGINT) AS points, a.total_score AS stored
        FROM (SELECT record_id, refined_rubric, generate_subscripts(answers, 1) - 1 AS pos, unnest(answers) AS a FROM bench) WHERE a IS NOT NULL""",
    "dataset_profile": """
        SELECT rules, hard, soft, count(*) AS questions, CAST(sum(n) AS BIGINT) AS answers FROM (SELECT CAST(coalesce(len(refined_rubric), 0) AS BIGINT) AS rules,
          CAST(coalesce(len(list_filter(refined_rubric, lambda r: r.type = 'hard')), 0) AS BIGINT) AS hard,
          CAST(coalesce(len(list_filter(refined_rubric, lambda r: r.type = 'soft')), 0) AS BIGINT) AS soft, coalesce(len(answers), 0) AS n FROM bench) GROUP BY ALL""",
    "graded_left_join": """
        SELECT b.record_id, coalesce(n, 0) AS graded FROM bench b LEFT JOIN (SELECT record_id, count(*) AS n FROM (SELECT record_id, unnest(answers) AS a FROM bench)
          WHERE len(a.grade) > 0 GROUP BY 1) g ON g.record_id = b.record_id""",
    "verdict_spellings": """
        SELECT spelling, n, CAST(CASE WHEN lower(trim(spelling)) IN ('yes', 'y', 'true', '1') THEN 1 WHEN lower(trim(spelling)) IN ('no', 'n', 'false', '0') THEN 0 END AS BIGINT) AS verdict
        FROM (SELECT g.verdict AS spelling, count(*) AS n FROM (SELECT unnest(a.grade) AS g FROM (SELECT unnest(answers) AS a FROM bench)) GROUP BY 1)""",
    "sampled_pairs": f"""WITH {_SAMPLES},
        o AS (SELECT question_id, sample_id, coalesce(stored, computed) AS g, sha256('20260524:' || sample_id) AS h FROM t WHERE question_id IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY h, sample_id, g) AS k FROM o),
        f AS (SELECT question_id, sample_id AS first_sample, g AS g1 FROM r WHERE k = 1),
        p AS (SELECT f.question_id, first_sample, arg_min(r.sample_id, r.k) AS second_sample FROM f JOIN r ON r.question_id = f.question_id AND r.g <> f.g1 GROUP BY ALL)
        SELECT printf('P%03d', k) AS pair_id, question_id, first_sample, second_sample FROM (SELECT *, row_number() OVER (ORDER BY sha256('20260524:' || question_id), question_id) AS k FROM p) WHERE k <= 50""",
}
