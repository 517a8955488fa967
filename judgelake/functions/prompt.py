"""Prompts: named places in a template, filled all at once or one after the other."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelake.functions.text import criterion_listing

_PLACE = re.compile(r"\{\{|\}\}|\{(\w+)\}")

#: Templates for the three ways of asking a judge; callers may give their own.
ONE_CRITERION = "Question:\n{question}\n\nCriterion: {title}\n{description}\n\nResponse:\n{response}\n\nDoes the response meet the criterion? End with \\boxed{{1}} or \\boxed{{0}}."
ALL_CRITERIA = "Question:\n{question}\n\nRules ({num_rules}):\n{rubric_rules}\n\nResponse:\n{response}\n\nFor every rule write one line: Rule i: <reason>. Verdict: Yes or No"
OVERALL = "Question:\n{question}\n\nCriteria:\n{rubric_formatted}\n\nResponse:\n{response}\n\nRate the response from 1 to 10. End with \\boxed{{score}}."


def filled(template: str, values: dict[str, Column]) -> Column:
    """All places at once, so that braces within a value stay; doubled braces are single ones. An unknown place is an
    error; a null value is empty."""
    parts, end = [], 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[end : m.start()]))
        end = m.end()
        if m.group(1) is None:
            parts.append(F.lit(m.group()[0]))
        elif m.group(1) not in values:
            raise KeyError(f"the template names {m.group(1)}, which has no value")
        else:
            parts.append(F.coalesce(values[m.group(1)].cast("string"), F.lit("")))
    parts.append(F.lit(template[end:]))
    return F.concat(*parts)


def replaced(template: str, values: dict[str, Column]) -> Column:
    """One place after the other in the order given, so that a place within a value is filled too."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def one_criterion(question: Column, criterion: Column, response: Column, template: str = ONE_CRITERION) -> Column:
    return filled(template, {"question": question, "title": criterion["title"], "description": criterion["description"], "response": response})


def all_criteria(question: Column, rubric: Column, response: Column, template: str = ALL_CRITERIA) -> Column:
    return filled(template, {"question": question, "rubric_rules": criterion_listing(rubric), "num_rules": F.size(rubric), "response": response})


def overall(question: Column, rubric: Column, response: Column, template: str = OVERALL) -> Column:
    return filled(template, {"question": question, "rubric_formatted": criterion_listing(rubric), "response": response})


def model_spec(text: str) -> tuple[str, str, str | None]:
    """model, label::model or label::base::adapter as (label, model, adapter); an error for more parts."""
    parts = [p.strip() for p in text.split("::")]
    if len(parts) > 3:
        raise ValueError(f"model, label::model or label::base::adapter expected, got {text!r}")
    return parts[0], parts[min(1, len(parts) - 1)], parts[2] if len(parts) == 3 else None
