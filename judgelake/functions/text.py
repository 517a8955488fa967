"""Text column functions: listings, prompts, labels, ids. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Words that mark the kind of a criterion, in the order in which they count.
KINDS = ("essential", "important", "optional", "pitfall")


def trimmed(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, SPACE, " "))


def shortened(x: Column, limit: int) -> Column:
    """At most limit characters, the last three of them dots; below four a plain cut."""
    if limit <= 3:
        return F.substring(x, 1, max(0, limit))
    cut = F.concat(F.regexp_replace(F.substring(x, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.length(x) <= limit, x).otherwise(cut)


def token(x: Column) -> Column:
    """1 or 0 for the spellings of yes and no, else null."""
    plain = F.lower(trimmed(x.cast("string")))
    return F.when(plain.isin("yes", "y", "true", "1"), 1).when(plain.isin("no", "n", "false", "0"), 0)


def rubric_listing(rubric: Column, hard: str = "[Hard Rule]", soft: str = "[Soft Rule]") -> Column:
    """Numbered lines of rules with their label."""
    line = lambda r, i: F.concat_ws(
        "", (i + 1).cast("string"), F.lit(". "), r["rubric"], F.when(r["type"] == "hard", f" {hard}").otherwise(f" {soft}")
    )
    return F.array_join(F.transform(rubric, line), "\n")


def criterion_listing(rubric: Column) -> Column:
    """Numbered lines "title: description"; either part may be missing."""
    part = lambda r: F.array_join(
        F.filter(F.array(F.nullif(trimmed(r["title"]), F.lit("")), F.nullif(trimmed(r["description"]), F.lit(""))), lambda x: x.isNotNull()), ": "
    )
    return F.array_join(F.transform(rubric, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), part(r))), "\n")


def kind(title: Column, description: Column) -> Column:
    """First kind named in a criterion's text, else unknown."""
    text = F.lower(F.concat_ws(" ", title, description))
    out = F.lit("unknown")
    for word in reversed(KINDS):
        out = F.when(text.contains(word), word).otherwise(out)
    return out


#: Forms in which a criterion can be written.
FORMS = ("full", "compact", "canonical", "title_only", "description_only")


def criterion(title: Column, description: Column, form: str = "canonical", limit: int = 0) -> Column:
    """A criterion in one of FORMS, cut to limit characters if that is above 0.

    full joins title and description; compact also leaves out "... Criteria:" wherever it stands; canonical says of
    that that the response satisfies it or, for a pitfall, avoids it.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {FORMS}")
    t, d = (F.coalesce(collapsed(x), F.lit("")) for x in (title, description))
    if form == "title_only":
        out = F.when(t != "", t).otherwise(d)
    elif form == "description_only":
        out = F.when(d != "", d).otherwise(t)
    else:
        out = F.when((t != "") & (d != ""), F.concat(t, F.lit(": "), d)).otherwise(F.concat(t, d))
        if form != "full":
            out = F.regexp_replace(out, r"(?i)\b(?:Essential|Important|Optional|Pitfall)\s+Criteria\s*:\s*", "")
        if form == "canonical":
            lead = F.when(kind(title, description) == "pitfall", "The response avoids this pitfall: ").otherwise("The response satisfies this criterion: ")
            out = F.concat(lead, out)
    return shortened(collapsed(out), limit) if limit > 0 else collapsed(out)


def canonical_criterion(title: Column, description: Column) -> Column:
    return criterion(title, description)


def bench_criterion(rule: Column, hard: Column, form: str = "canonical") -> Column:
    """A rule of a graded question as a statement (canonical) or followed by its label (full)."""
    text, name = collapsed(F.coalesce(rule, F.lit(""))), F.when(F.coalesce(hard, F.lit(False)), "hard").otherwise("soft")
    if form == "full":
        return F.concat(text, F.lit(" ["), F.initcap(name), F.lit(" Rule]"))
    return F.concat(F.lit("The response satisfies this "), name, F.lit(" rule: "), text)


def verdict_letters(verdicts: Column) -> Column:
    """Y and N of a vector; empty for null."""
    return F.coalesce(F.array_join(F.transform(verdicts, lambda v: F.when(v == 1, "Y").otherwise("N")), ""), F.lit(""))


def lines(x: Column) -> Column:
    """Lines that aren't blank, trimmed; every line end of Unicode counts."""
    parts = F.transform(F.split(x, "[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), trimmed)
    return F.filter(parts, lambda s: s != "")


def first_line(x: Column) -> Column:
    return F.coalesce(F.get(lines(x), F.lit(0)), F.lit(""))


def question_key(x: Column, otherwise: Column | None = None) -> Column:
    """Stable id of a question's text; where that is empty, of another text (the prompt as JSON) if one is given."""
    told = x if otherwise is None else F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(otherwise)
    return F.concat(F.lit("q_"), F.substring(F.sha1(told), 1, 16))


def one_line(x: Column) -> Column:
    """Line ends as blanks, trimmed; empty for null."""
    return trimmed(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " "))


def slug(x: Column) -> Column:
    plain = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_")
    return F.regexp_replace(plain, "^_+|_+$", "")


def dialogue(messages: Column) -> Column:
    """Bare content of a single message, else one line "Role: content" each."""
    role = lambda m: F.concat(F.upper(F.substring(m["role"], 1, 1)), F.lower(F.substring(m["role"], 2, 1000)))
    many = F.array_join(F.transform(messages, lambda m: F.concat(role(m), F.lit(": "), m["content"])), "\n")
    return F.when(F.size(messages) == 1, F.get(messages, F.lit(0))["content"]).otherwise(many)


def after_last(x: Column, marker: str) -> Column:
    """What follows the last marker; the whole text without one."""
    return trimmed(F.element_at(F.split(x, f"\\Q{marker}\\E"), -1))


def unfenced(x: Column) -> Column:
    """Without a code fence around the whole."""
    return trimmed(F.regexp_replace(trimmed(x), r"^```(?:json)?\s*|\s*```$", ""))


def rough_tokens(x: Column) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(F.when(trimmed(x) == "", 0).otherwise(F.size(F.split(trimmed(x), SPACE))) * 1.3).cast("bigint")


def sft_lines(rubric: Column, verdicts: Column, limit: int = 140) -> Column:
    """Target text: each rule as justification, cut and closed as a sentence, with its verdict."""
    said = lambda r: shortened(collapsed(r["rubric"]), limit)
    closed = lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))
    line = lambda r, i: F.concat(
        F.lit("Rule "), (i + 1).cast("string"), F.lit(": "), closed(said(r)), F.lit(" Verdict: "), F.when(F.get(verdicts, i) == 1, "Yes").otherwise("No")
    )
    return F.array_join(F.transform(rubric, line), "\n")


def privileged(rubric: Column, reference: Column) -> Column:
    """What a privileged reader is told: the criteria with signed weights, the reference answer, or both."""
    weight = lambda r: F.coalesce(r["weight"], F.lit(1.0))
    signed = lambda r: F.concat(F.when(weight(r) > 0, "+").otherwise(""), weight(r).cast("string"))
    line = lambda r: F.concat(F.lit("  - "), F.coalesce(r["title"], F.lit("")), F.lit(": "), F.coalesce(r["description"], F.lit("")), F.lit(" (weight: "), signed(r), F.lit(")"))
    # The two instructions.
    told = (
        "You should follow the given rubrics to answer the question. Positive weights indicate criteria you should satisfy."
        " Negative weights indicate criteria you should avoid."
    )
    criteria = F.when(F.size(rubric) > 0, F.concat(F.lit(f"{told}\n\n"), F.array_join(F.transform(rubric, line), "\n")))
    answer = F.when(F.coalesce(reference, F.lit("")) != "", F.concat(F.lit("You should refer to the following reference answer:\n\n"), reference))
    return F.concat_ws("\n\n", criteria, answer)
