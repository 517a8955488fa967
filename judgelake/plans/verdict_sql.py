"""SQL of the verdict parsers, for comparison with the column expressions."""

from __future__ import annotations

from judgelake.functions import parse


def _text(pattern: str) -> str:
    return pattern.replace("'", "''")


def first_shape(line: str, shapes: list[tuple[str, int, int]], group: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({line}, '{_text(p)}') THEN regexp_extract({line}, '{_text(p)}', {group})" for p, _, _ in shapes) + " END"


def passes(ctes: str, base: str) -> str:
    """WITH ... parsed: the rows of base (raw_output, num_rules, ...) with vs, the verdicts, and source, the pass that read them."""
    strict, loose, broad = parse.STRICT, parse.RELAXED, parse.BROAD
    bare = "regexp_replace(line, '^,+|,+$', '', 'g')"
    hit = lambda k, line, shapes: f"SELECT id, {k} AS pass, ln, TRY_CAST({first_shape(line, shapes, 1)} AS INT) AS rule, lower({first_shape(line, shapes, 2)}) AS tok FROM l2"
    vec = lambda name, source: f"{name} AS (SELECT id, list(v ORDER BY rule) AS vs, count(*) AS k, min(rule) AS lo, max(rule) AS hi FROM (SELECT id, rule, arg_max(CASE WHEN tok IN ('yes', 'y', 'true', '1') THEN 1 ELSE 0 END, pass * 1000000 + ln) AS v FROM {source} GROUP BY 1, 2) GROUP BY 1)"
    good = lambda t: f"({t}.k = num_rules AND {t}.lo = 1 AND {t}.hi = num_rules)"
    return f"""WITH {ctes + ',' if ctes else ''} base AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM ({base})),
        l AS (SELECT id, list_filter(list_transform(string_split_regex(coalesce(raw_output, ''), '[\n\r]'), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '') AS ls FROM base),
        l2 AS MATERIALIZED (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM l),
        hits AS MATERIALIZED (SELECT * FROM ({hit(0, 'line', strict)} UNION ALL {hit(1, 'line', loose)} UNION ALL {hit(2, bare, broad)}) WHERE rule IS NOT NULL),
        k0 AS (SELECT id, count(DISTINCT rule) AS named FROM hits WHERE pass = 0 GROUP BY 1),
        kept AS MATERIALIZED (SELECT hits.* FROM hits JOIN base USING (id) LEFT JOIN k0 USING (id) WHERE pass > 0 OR named = num_rules),
        {vec('v0', '(SELECT * FROM hits WHERE pass = 0)')}, {vec('v1', '(SELECT * FROM kept WHERE pass < 2)')}, {vec('v2', 'kept')},
        parsed AS (SELECT base.*, CASE WHEN num_rules = 0 AND length(raw_output) > 0 AND v0.id IS NULL THEN CAST([] AS INT[]) WHEN {good('v0')} THEN v0.vs WHEN {good('v1')} THEN v1.vs WHEN {good('v2')} THEN v2.vs END AS vs,
            CASE WHEN (num_rules = 0 AND length(raw_output) > 0 AND v0.id IS NULL) OR {good('v0')} THEN 'strict' WHEN {good('v1')} THEN 'relaxed' WHEN {good('v2')} THEN 'broad' ELSE 'failed' END AS source
          FROM base LEFT JOIN v0 USING (id) LEFT JOIN v1 USING (id) LEFT JOIN v2 USING (id))"""


def boxed_sql(t: str) -> str:
    return f"(CASE WHEN regexp_matches({t}, '\\\\boxed\\{{[^}}]+\\}}') THEN trim(regexp_extract({t}, '\\\\boxed\\{{([^}}]+)\\}}', 1)) END)"


def binary_sql(t: str) -> str:
    b = boxed_sql(t)
    return f"coalesce(CASE WHEN regexp_matches({b}, '^[+-]?\\d+$') AND TRY_CAST({b} AS INT) IN (0, 1) THEN TRY_CAST({b} AS INT) END, CASE WHEN regexp_matches({t}, '\\b0\\b') THEN 0 WHEN regexp_matches({t}, '\\b1\\b') THEN 1 END)"


def likert_sql(t: str) -> str:
    b = boxed_sql(t)
    x = f"CASE WHEN regexp_matches({b}, '(?i)^[+-]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:e[+-]?\\d+)?$') THEN greatest(1.0, least(10.0, TRY_CAST({b} AS DOUBLE))) END"
    y = f"list_filter(list_transform(regexp_extract_all({t}, '(\\d+(?:\\.\\d+)?)', 1), lambda s: TRY_CAST(s AS DOUBLE)), lambda v: v >= 1 AND v <= 10)[1]"
    return f"((coalesce({x}, {y}) - 1) / 9)"


def reason_sql(t: str, n: str) -> str:
    """Reason of a failure, of a text and its number of rules; t is a column."""
    ls = f"list_filter(list_transform(string_split_regex(coalesce({t}, ''), '[\n\r]'), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '')"
    rules = lambda shapes: f"list_sort(list_distinct(list_filter(list_transform({ls}, lambda q: TRY_CAST({first_shape('q', shapes, 1)} AS INT)), lambda k: k IS NOT NULL)))"
    named = f"list_filter(list_transform({ls}, lambda q: TRY_CAST(nullif(regexp_extract(q, '{_text(parse.RULE_LINE)}', 1), '') AS INT)), lambda k: k IS NOT NULL)"
    seen = f"len(list_filter({ls}, lambda q: regexp_matches(q, '{_text(parse.VERDICT_LINE)}')))"
    want = f"CAST(range(1, {n} + 1) AS INT[])"
    return f"""CASE WHEN len({ls}) = 0 THEN 'empty_response' WHEN {rules(parse.STRICT)} = {want} THEN 'parser_mismatch_strict_should_have_parsed' WHEN {rules(parse.RELAXED)} = {want} THEN 'strict_only_failure'
        WHEN contains({t}, '<think>') AND NOT contains({t}, '</think>') THEN 'unclosed_thinking' WHEN contains({t}, '</think>') AND regexp_matches({t}, '(?s)^.*?</think>\\s*$') AND trim(split_part({t}, '</think>', 2), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'reasoning_only_no_final_content'
        WHEN len({named}) > 0 AND len(list_distinct({named})) < {n} THEN 'partial_rule_lines' WHEN {seen} > 0 AND {seen} < {n} THEN 'partial_verdict_lines' WHEN len({named}) = 0 THEN 'no_rule_lines' ELSE 'malformed_rule_lines' END"""
