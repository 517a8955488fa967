"""Verdict parsers as column expressions.

Each pass turns the lines of a text into (rule, verdict) hits; the last hit of a rule counts; a vector is valid if
every rule 1..n has a verdict and no other rule is named. The relaxed parser falls back from the strict shape to a
looser one and then to a broad one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelake.functions.text import lines, trimmed

#: Spellings of a verdict, with and without digits.
TOKEN = "(Yes|No|Y|N|True|False|0|1)"
WORDS = "(Yes|No|Y|N|True|False)"
#: The parts of a verdict line. A bullet may lead it, one separator may follow the rule's number, another
#: one the word that announces the verdict.
BULLET, RULE = r"(?:[-*]\s*)?", r"Rule\s*(\d+)"
SEPARATOR, CLOSER, ASSIGNED = r"\s*[:.)-]?\s*", r"\s*[:.)\]-]\s*", r"\s*[:=-]?\s*"
QUOTE = "[\"']?"


def _shape(*parts: str) -> tuple[str, int, int]:
    """A case-insensitive pattern with the groups of rule and verdict."""
    return "(?i)" + "".join(parts), 1, 2


#: The shapes of a verdict line that each pass accepts, as the parts above in order.
STRICT = [_shape("^", RULE, r"\s*:\s*.*?\bVerdict\s*:\s*(Yes|No|Y|N)$")]
RELAXED = [
    _shape("^", BULLET, RULE, SEPARATOR, r".*?\bVerdict", ASSIGNED, TOKEN, r"\b"),
    _shape("^", BULLET, RULE, SEPARATOR, r".*?\b", WORDS, r"\s*$"),
]
SEQUENCE = [
    _shape("^", RULE, r"\s*:\s*(Yes|No|Y|N)$"),
    _shape("^", RULE, r"\s*[:.)-]\s*(Yes|No|Y|N)\b.*$"),
    _shape("^", RULE, r"\s*:\s*.*?\bVerdict\s*:\s*(Yes|No|Y|N)\s*\.?$"),
]
BROAD = [
    _shape(r"\b", RULE, r"\b.*?\b(?:Verdict|Answer|Satisfied)", ASSIGNED, TOKEN, r"\b"),
    _shape(r"^\s*", BULLET, r"(?:Rule\s*)?(\d+)", CLOSER, TOKEN, r"\b\s*$"),
    _shape(r"^\s*", BULLET, RULE, CLOSER, r".*?\b", TOKEN, r"\b\s*$"),
    _shape(QUOTE, r"(?:Rule\s*)?(\d+)", QUOTE, r"\s*[:=]\s*", QUOTE, TOKEN),
]
#: A line that begins with a rule, and one that states a verdict anywhere.
RULE_LINE = rf"(?i)^{BULLET}{RULE}\b"
VERDICT_LINE = rf"(?i)\bVerdict{ASSIGNED}{TOKEN}\b"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hit(line: Column, patterns: list[tuple[str, int, int]]) -> Column:
    """(rule, verdict) of the first pattern that matches a line; null where none does."""

    def of(pattern: str, k: int, v: int) -> Column:
        def read(rule: Column) -> Column:
            yes = F.lower(F.regexp_extract(line, pattern, v)).isin("yes", "y", "true", "1")
            return F.when(rule != "", F.struct(rule.try_cast("int").alias("rule"), F.when(yes, 1).otherwise(0).alias("verdict")))

        return bound(F.regexp_extract(line, pattern, k), read)

    tries = [of(*p) for p in patterns]
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]


def hits(text_lines: Column, patterns: list[tuple[str, int, int]]) -> Column:
    return F.filter(F.transform(text_lines, lambda s: _hit(s, patterns)), lambda h: h["rule"].isNotNull())


def _last(found: Column, rule: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda h: h["rule"] == rule), F.lit(-1))["verdict"]


def vector(passes: list[Column], n: Column) -> Column:
    """Verdicts of rules 1..n, a later pass before an earlier one; null unless complete and without other rules."""

    def read(every: Column) -> Column:  # all passes in one list: the last hit of a rule is the latest pass's
        foreign = F.exists(every, lambda h: (h["rule"] < 1) | (h["rule"] > n))
        made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _last(every, i))
        return F.when((n > 0) & ~foreign, bound(made, lambda m: F.when(~F.exists(m, lambda v: v.isNull()), m)))

    return bound(F.concat(*passes) if len(passes) > 1 else passes[0], read)


def strict(text: Column, n: Column) -> Column:
    """Every line "Rule i: ... Verdict: Yes"; null for an unreadable or empty text, empty for no rules and no verdicts."""
    return bound(lines(text), lambda ls: _strict(text, ls, n))


def _strict(text: Column, ls: Column, n: Column) -> Column:
    found = hits(ls, STRICT)
    return F.when(n == 0, F.when((F.length(text) > 0) & (F.size(found) == 0), F.array().cast("array<int>"))).otherwise(vector([found], n))


def relaxed(text: Column, n: Column, broad: bool = True, carry: bool = True) -> Column:
    """Strict, else relaxed, else (if broad) broad. With carry, as in scoring, a strict pass with n wrong rules stays
    among the hits, so that no later pass can succeed; diagnosis reads without carry and without broad."""

    def read(ls: Column) -> Column:
        base = []
        if carry:
            none = F.array().cast("array<struct<rule:int,verdict:int>>")
            base = [bound(hits(ls, STRICT), lambda f: F.when(F.size(F.array_distinct(f["rule"])) == n, f).otherwise(none))]
        second = hits(ls, RELAXED)
        tries = [_strict(text, ls, n), vector([*base, second], n)]
        if broad:
            tries.append(vector([*base, second, hits(F.transform(ls, lambda s: F.regexp_replace(s, "^,+|,+$", "")), BROAD)], n))
        return F.coalesce(*tries)

    return bound(lines(text), read)


def source(text: Column, n: Column) -> Column:
    """Which pass read the text."""
    return (
        F.when(strict(text, n).isNotNull(), "strict").when(relaxed(text, n, broad=False).isNotNull(), "relaxed").when(relaxed(text, n).isNotNull(), "broad").otherwise("failed")
    )


def sequential(text: Column, n: Column) -> Column:
    """First run of consecutive lines that name rules 1, 2, ..., n; any other line breaks a run, rule 1 starts a new one."""
    none = F.array().cast("array<int>")

    def state(due: Column, made: Column, done: Column) -> Column:
        return F.struct(due.cast("int").alias("due"), made.alias("made"), done.alias("done"))

    def step(acc: Column, line: Column) -> Column:
        def on(h: Column) -> Column:
            return (
                F.when(acc["done"], acc)
                .when(h["rule"] == acc["due"], state(acc["due"] + 1, F.concat(acc["made"], F.array(h["verdict"])), acc["due"] == n))
                .when(h["rule"] == 1, state(F.lit(2), F.array(h["verdict"]), n == 1))
                .otherwise(state(F.lit(1), none, F.lit(False)))
            )

        return bound(_hit(line, SEQUENCE), on)

    end = F.aggregate(lines(text), state(F.lit(1), none, F.lit(False)), step)
    return F.when(end["done"], end["made"])


#: Why a text gives no verdicts, in the order in which the reasons are tried.
REASONS = [
    "empty_response", "parser_mismatch_strict_should_have_parsed", "strict_only_failure", "unclosed_thinking", "reasoning_only_no_final_content",
    "partial_rule_lines", "partial_verdict_lines", "no_rule_lines", "malformed_rule_lines",
]


def failure(text: Column, n: Column) -> Column:
    """Struct of the reason and what it is read off: chars, contains_think, rule_line_count, unique_rule_line_count,
    verdict_line_count, strict_parse_ok, loose_parse_ok. A null text counts as an empty one."""
    body = F.coalesce(text, F.lit(""))

    def why(ls: Column) -> Column:
        rules = F.filter(F.transform(ls, lambda s: F.regexp_extract(s, RULE_LINE, 1).try_cast("int")), lambda k: k.isNotNull())
        seen = F.size(F.filter(ls, lambda s: s.rlike(VERDICT_LINE)))
        return F.struct(
            F.size(rules).alias("lines"), F.size(F.array_distinct(rules)).alias("rules"), seen.alias("verdicts"),
            strict(body, n).isNotNull().alias("strict"), relaxed(body, n, broad=False, carry=False).isNotNull().alias("loose"),
        )

    def told(x: Column) -> Column:
        opened, closed = body.contains("<think>"), body.contains("</think>")
        after = F.regexp_replace(body, r"(?s)^.*?</think>", "")
        cases = [
            trimmed(body) == "", x["strict"], x["loose"], opened & ~closed, closed & (trimmed(after) == ""), (x["lines"] > 0) & (x["rules"] < n),
            (x["verdicts"] > 0) & (x["verdicts"] < n), x["lines"] == 0,
        ]
        reason = F.lit(REASONS[-1])
        for case, name in reversed(list(zip(cases, REASONS, strict=False))):
            reason = F.when(case, name).otherwise(reason)
        return F.struct(
            reason.alias("reason"), F.length(body).alias("chars"), (opened | closed).alias("contains_think"), x["lines"].alias("rule_line_count"), x["rules"].alias("unique_rule_line_count"),
            x["verdicts"].alias("verdict_line_count"), x["strict"].alias("strict_parse_ok"), x["loose"].alias("loose_parse_ok"),
        )

    return bound(bound(lines(body), why), told)


def boxed(text: Column) -> Column:
    """Content of the first \\boxed{...}, trimmed; null without one."""
    return F.when(text.rlike(r"\\boxed\{[^}]+\}"), trimmed(F.regexp_extract(text, r"\\boxed\{([^}]+)\}", 1)))


def binary(text: Column, strict: bool = False) -> Column:
    """0 or 1 out of the first box; else, unless strict, 0 where the word 0 stands anywhere, then 1; null otherwise."""
    inner = boxed(text)
    kept = F.when(inner.rlike(r"^[+-]?\d+$"), inner.try_cast("int"))
    found = F.when(kept.isin(0, 1), kept)
    return found if strict else F.coalesce(found, F.when(text.rlike(r"\b0\b"), 0).when(text.rlike(r"\b1\b"), 1))


def likert(text: Column, strict: bool = False) -> Column:
    """Number in the first box, clamped to 1..10, else, unless strict, the first number from 1 to 10; put on 0..1."""
    inner = boxed(text)
    kept = F.when(inner.rlike(r"(?i)^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?$|^[+-]?(?:inf|infinity|nan)$"), inner.try_cast("double"))
    # Not a number clamps to the upper end: least and greatest take it for the largest value.
    clamped = F.greatest(F.lit(1.0), F.least(F.lit(10.0), kept))
    x = F.when(kept.isNotNull(), clamped)
    if not strict:
        numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda s: s.try_cast("double"))
        x = F.coalesce(x, F.get(F.filter(numbers, lambda v: (v >= 1) & (v <= 10)), F.lit(0)))
    return (x - 1) / 9
