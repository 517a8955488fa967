"""Shredding of deeply nested records into an adjacency table and from there into flat entity tables.

The adjacency table has one row per node: origin, record_id, node, parent, label, ordinal, kind, scalar.
Array elements are children of the object that holds the array; label is the array's field and ordinal the
element's 0-based place. Typed columns are shredded by Catalyst expressions built from the schema
(:func:`shred_columns`), JSON text of changing shape by one parse per line (:func:`shred_json`).

Defined results: a null or unreadable record has its own node only; a null array has no elements, a null
element is a node of kind "null"; repeated record ids give repeated nodes; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = "origin string, record_id bigint, node string, parent string, label string, ordinal int, kind string, scalar string"
ROOT = "$"


def _node(node: Column, parent: Column, label: str, ordinal: Column, kind: Column, scalar: Column) -> Column:
    return F.struct(
        node.alias("node"), parent.alias("parent"), F.lit(label).alias("label"), ordinal.cast("int").alias("ordinal"),
        kind.alias("kind"), scalar.cast("string").alias("scalar"),
    )


def _emit(value: Column, kind: T.DataType, node: Column, parent: Column, label: str, ordinal: Column) -> Column:
    """Array of the nodes at and under value."""
    if isinstance(kind, T.StructType):
        own = _node(node, parent, label, ordinal, F.when(value.isNull(), "null").otherwise("object"), F.lit(None))
        below = [
            _emit(value.getField(f.name), f.dataType, F.concat(node, F.lit(f".{f.name}")), node, f.name, F.lit(0))
            for f in kind.fields
        ]
        return F.when(value.isNull(), F.array(own)).otherwise(F.concat(F.array(own), *below))
    if isinstance(kind, T.ArrayType):
        each = F.transform(
            value,
            lambda x, i: _emit(x, kind.elementType, F.concat(node, F.lit("["), i.cast("string"), F.lit("]")), parent, label, i),
        )
        return F.coalesce(F.flatten(each), F.array().cast(_NODES))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return _emit(F.map_entries(value), T.ArrayType(entry), node, parent, label, ordinal)
    own = _node(node, parent, label, ordinal, F.when(value.isNull(), "null").otherwise("scalar"), value)
    return F.array(own)


_NODES = "array<struct<node:string,parent:string,label:string,ordinal:int,kind:string,scalar:string>>"


def shred_columns(df: DataFrame, record_id: str, origin: str, columns: list[str]) -> DataFrame:
    """Adjacency table of typed nested columns, without Python and without a shuffle.

    One generator per row; which fields become nodes follows from the schema, so a narrower schema makes fewer.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    root = _node(F.lit(ROOT), F.lit(None).cast("string"), "record", F.lit(0), F.lit("object"), F.lit(None))
    nodes = F.concat(
        F.array(root),
        *(_emit(F.col(f"`{c}`"), schema[c], F.lit(f"{ROOT}.{c}"), F.lit(ROOT), c, F.lit(0)) for c in columns),
    )
    return df.select(
        F.lit(origin).alias("origin"), F.col(record_id).cast("bigint").alias("record_id"), F.inline(nodes)
    )


#: Fields that mark an object as one candidate; an object without any of them maps candidate ids to candidates.
CANDIDATE_FIELDS = frozenset(
    ["candidate_id", "model_name", "model_path", "generation_mode", "temperature", "top_p", "response", "score",
     "num_parse_failures", "reward_result", "criterion_scores"]
)
#: Lists of a reward_result that hold one element for each criterion.
CRITERION_LISTS = ("criterion_scores", "criterion_weights", "criterion_parse_ok", "criterion_yes_probs")
#: Marks around a line that don't count.
AROUND = " \t\r\n\v\f   \u0085﻿"


def _refuse(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity aren't JSON


def _parse(text: str) -> object:
    return json.loads(text, parse_constant=_refuse)


def _unwrap(value: object) -> object:
    """A value kept as JSON in a string, as often as it was quoted."""
    while isinstance(value, str):
        try:
            value = _parse(value.strip(AROUND))
        except (ValueError, RecursionError):
            return value
    return value


def _kind(value: object) -> str:
    return "null" if value is None else "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _flat(value: object) -> Iterator[object]:
    """Elements of arrays in arrays, in order of appearance."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        else:
            yield x


def _candidates(value: object) -> list[tuple[str | None, object]]:
    """(id that stood as key, candidate) in whatever shape candidates are kept."""
    value = _unwrap(value)
    if value is None or value == "":
        return []
    if isinstance(value, dict):
        if not value:
            return []
        if CANDIDATE_FIELDS.isdisjoint(value):
            return [(k, _unwrap(v)) for k, v in value.items()]
        return [(None, value)]
    return [(None, _unwrap(x)) for x in _flat(value)]


def _scores(value: object) -> list[object]:
    """Elements of one of CRITERION_LISTS in whatever shape; one kept alone is one element, a null none."""
    value = _unwrap(value)
    if value is None:
        return []
    if isinstance(value, dict):
        return [y for x in value.values() for y in (_flat(x) if isinstance(x, list) else [x])]
    if isinstance(value, str):
        return [x.strip() for x in value.strip("[]() ").replace(";", ",").split(",")] if value.strip() else []
    return list(_flat(value))


def shred_line(line: str | None) -> list[tuple]:
    """(node, parent, label, ordinal, kind, scalar) of one JSON line. A line that isn't one object has its root only."""
    out: list[tuple] = [(ROOT, None, "record", 0, "object", None)]
    try:
        record = _parse((line or "").strip(AROUND))
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return [(ROOT, None, "record", 0, "null", None)]

    def add(parent: str, label: str, value: object) -> None:
        """Everything under a field that isn't an entity of its own, in the shape it has."""
        stack = [(f"{parent}.{label}", parent, label, 0, value)]
        while stack:
            node, above, name, place, x = stack.pop()
            if isinstance(x, list):
                stack.extend((f"{node}[{i}]", above, name, i, y) for i, y in reversed(list(enumerate(x))))
                continue
            out.append((node, above, name, place, _kind(x), None if isinstance(x, dict) else _text(x)))
            if isinstance(x, dict):
                stack.extend((f"{node}.{k}", node, k, 0, y) for k, y in reversed(x.items()))

    for label, value in record.items():
        if label != "candidates":
            add(ROOT, label, value)
    for i, (key, candidate) in enumerate(_candidates(record.get("candidates"))):
        node = f"{ROOT}.candidates[{i}]"
        out.append((node, ROOT, "candidates", i, _kind(candidate), None if isinstance(candidate, dict | list) else _text(candidate)))
        if not isinstance(candidate, dict):
            continue
        if key is not None and "candidate_id" not in candidate:
            out.append((f"{node}.candidate_id", node, "candidate_id", 0, "scalar", key))
        for label, value in candidate.items():
            if label != "reward_result" and label not in CRITERION_LISTS:
                add(node, label, value)
        result = _unwrap(candidate.get("reward_result"))
        if isinstance(result, list):  # one result in a list, or several that follow each other
            result = {k: v for part in _flat(result) if isinstance(part, dict) for k, v in part.items()}
        if not isinstance(result, dict):
            result = {"score": result} if isinstance(result, int | float) else {}
        result = {k: candidate[k] for k in CRITERION_LISTS if k in candidate} | result
        if result:
            inner = f"{node}.reward_result"
            out.append((inner, node, "reward_result", 0, "object", None))
            for label, value in result.items():
                if label not in CRITERION_LISTS:
                    add(inner, label, value)
            for label in CRITERION_LISTS:
                for j, x in enumerate(_scores(result.get(label))):
                    out.append((f"{inner}.{label}[{j}]", inner, label, j, _kind(x), _text(x)))
    return out


_ARROW = pa.schema(
    [("origin", pa.string()), ("record_id", pa.int64()), ("node", pa.string()), ("parent", pa.string()),
     ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())]
)


def shred_json(df: DataFrame, record_id: str, line: str, origin: str) -> DataFrame:
    """Adjacency table of JSON lines whose shape changes from line to line; Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(ids), 500):  # a batch of lines becomes many more nodes
                rows = [
                    (origin, i, *node)
                    for i, text in zip(ids[start : start + 500], lines[start : start + 500], strict=True)
                    for node in shred_line(text)
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
                )

    return df.select(F.col(record_id).cast("bigint"), F.col(line).cast("string")).mapInArrow(run, NODE_SCHEMA)


def entity(nodes: DataFrame, label: str, fields: dict[str, str], via: str | None = None) -> DataFrame:
    """Flat table of the object nodes under a label: origin, record_id, node, parent, ordinal, kind and the given
    scalar children pivoted to columns (field -> Spark type). Objects without children keep their row.

    via names an inner object whose scalar children count as the entity's own. Object nodes and scalar children
    meet on (origin, record_id, node); one exchange on these keys serves the join and the pivot.
    """
    own = nodes.filter(F.col("label") == label).select("origin", "record_id", "node", "parent", "ordinal", "kind", "scalar")
    if not fields:
        return own
    wanted = nodes.filter(F.col("label").isin(list(fields)) & F.col("parent").isNotNull() & (F.col("ordinal") == 0))
    holder = F.col("parent") if via is None else F.regexp_replace("parent", rf"\.{via}$", "")
    children = (
        wanted.select("origin", "record_id", holder.alias("node"), "label", "scalar", (F.col("parent") == holder).alias("direct"))
        .groupBy("origin", "record_id", "node")
        .agg(*(F.max_by(F.when(F.col("label") == f, F.col("scalar")), F.struct(F.col("label") == f, "direct")).try_cast(t).alias(f) for f, t in fields.items()))
    )
    return own.join(children, ["origin", "record_id", "node"], "left")


def entity_tables(nodes: DataFrame, candidate_fields: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """records, candidates and criteria; each row knows its parent, childless parents are kept."""
    keys = ["origin", "record_id"]
    records = nodes.filter(F.col("label") == "record").filter(F.col("parent").isNull()).select(*keys, "node", "kind")
    candidates = entity(nodes.filter((F.col("label") != "candidates") | (F.col("parent") == ROOT)), "candidates", candidate_fields or {}, "reward_result")
    candidates = candidates.withColumnRenamed("ordinal", "cand_pos")
    criteria = (
        nodes.filter((F.col("label") == "criterion_scores") & F.col("parent").endswith(".reward_result"))
        .select(*keys, "node", F.regexp_replace("parent", r"\.reward_result$", "").alias("candidate_node"),
                F.col("ordinal").alias("crit_pos"), "kind", F.col("scalar").try_cast("double").alias("criterion_score"))
    )
    owners = candidates.select(*keys, F.col("node").alias("candidate_node"), "cand_pos")
    return {"records": records, "candidates": candidates, "criteria": criteria.join(owners, [*keys, "candidate_node"])}


def nodes_found(tables: dict[str, DataFrame]) -> DataFrame:
    """(origin, record_id, cand_pos, crit_pos) of every row of the entity tables; -1 where a level has no place."""
    keys = [F.col("origin"), F.col("record_id")]
    none = F.lit(-1).cast("bigint")
    return (
        tables["records"].select(*keys, none.alias("cand_pos"), none.alias("crit_pos"))
        .unionByName(tables["candidates"].select(*keys, F.col("cand_pos").cast("bigint"), none.alias("crit_pos")))
        .unionByName(tables["criteria"].select(*keys, F.col("cand_pos").cast("bigint"), F.col("crit_pos").cast("bigint")))
    )


#: Scalar fields of the flat tables. A reward_result's own have result_ before their name there.
RECORD_FIELDS = {
    "question_id": "string", "split_role": "string", "data_source": "string", "question": "string", "reference_answer": "string", "ingested_at": "timestamp",
}
CANDIDATE_SCALARS = {
    "candidate_id": "string", "model_name": "string", "model_path": "string", "generation_mode": "string", "temperature": "double", "top_p": "double",
    "response": "string", "score": "double", "num_parse_failures": "bigint",
}
RESULT_SCALARS = {
    "score": "double", "binary_score": "double", "num_parse_failures": "bigint", "raw_num_parse_failures": "bigint", "raw_parse_success": "boolean",
    "fallback_used": "boolean", "judge_attempts": "bigint", "parse_source": "string", "raw_judge_response": "string",
}
CRITERION_FIELDS = {"criterion_score": "double", "criterion_weight": "double", "criterion_parse_ok": "boolean", "criterion_yes_prob": "double"}
_KEYS = {"origin": "string", "record_id": "bigint", "node": "string", "parent": "string"}
_RESULT_FIELDS = {"result_node": "string"} | {f"result_{f}": t for f, t in RESULT_SCALARS.items()}
#: Columns of each flat table. node and parent are those of the adjacency table, but a criterion's parent is its
#: candidate; the node of a criterion for which criterion_scores has no element is null.
FLAT = {
    "records": _KEYS | {"kind": "string"} | RECORD_FIELDS,
    "candidates": _KEYS | {"cand_pos": "bigint", "kind": "string"} | CANDIDATE_SCALARS | _RESULT_FIELDS,
    "criteria": _KEYS | {"cand_pos": "bigint", "crit_pos": "bigint", "kind": "string"} | CRITERION_FIELDS,
}


def flat_columns(bank: DataFrame, record_id: str, origin: str, table: str) -> DataFrame:
    """One of the FLAT tables of typed nested columns; rows come from their own record, without a shuffle."""
    keys = [F.lit(origin).alias("origin"), F.col(record_id).cast("bigint").alias("record_id")]
    if table == "records":
        return bank.select(*keys, F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("object").alias("kind"), *RECORD_FIELDS)
    rows = bank.select(*keys, F.posexplode("candidates").alias("i", "c"))
    node, r = F.concat(F.lit(f"{ROOT}.candidates["), F.col("i").cast("string"), F.lit("]")), F.col("c.reward_result")
    inner = F.concat(node, F.lit(".reward_result"))
    place = F.col("i").cast("bigint").alias("cand_pos")
    if table == "candidates":
        return rows.select(
            "origin", "record_id", node.alias("node"), F.lit(ROOT).alias("parent"), place, F.when(F.col("c").isNull(), "null").otherwise("object").alias("kind"),
            *[F.col(f"c.{f}") for f in CANDIDATE_SCALARS], F.when(r.isNotNull(), inner).alias("result_node"), *[r[f].alias(f"result_{f}") for f in RESULT_SCALARS],
        )
    length = lambda f: F.coalesce(F.array_size(r[f]), F.lit(0))
    decided = rows.select(*rows.columns, length(CRITERION_LISTS[0]).alias("scores"), F.greatest(*map(length, CRITERION_LISTS)).alias("most")).filter("most > 0")
    decided = decided.select(*decided.columns, F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("j"))
    scored, value = F.col("j") < F.col("scores"), lambda f: F.get(r[f], F.col("j"))
    return decided.select(
        "origin", "record_id", F.when(scored, F.concat(inner, F.lit(".criterion_scores["), F.col("j").cast("string"), F.lit("]"))).alias("node"), node.alias("parent"),
        place, F.col("j").cast("bigint").alias("crit_pos"), F.when(scored, F.when(value(CRITERION_LISTS[0]).isNull(), "null").otherwise("scalar")).alias("kind"),
        *[value(f).alias(name) for f, name in zip(CRITERION_LISTS, CRITERION_FIELDS, strict=True)],
    )


def flat_line(line: str | None, table: str) -> list[dict[str, object]]:
    """Rows of one of the FLAT tables of one JSON line, without origin and record_id, scalars as text.

    A scalar field kept as a list has its first element.
    """
    nodes = shred_line(line)
    own: dict[str, dict[str, object]] = {}  # nodes of the table and those that give columns to them
    criteria: dict[tuple[str, int], dict[str, object]] = {}
    for node, parent, label, place, kind, scalar in nodes:
        if parent is None:
            own[node] = {"node": node, "parent": None, "kind": kind}
        elif parent == ROOT and label == "candidates":
            own[node] = {"node": node, "parent": ROOT, "cand_pos": place, "kind": kind}
        elif label == "reward_result" and parent in own and node == f"{parent}.reward_result":
            own[parent]["result_node"] = node
        elif parent.endswith(".reward_result") and (holder := parent.removesuffix(".reward_result")) in own:
            if label in CRITERION_LISTS:
                row = criteria.setdefault((holder, place), {"node": None, "parent": holder, "cand_pos": own[holder]["cand_pos"], "crit_pos": place, "kind": None})
                row[_SINGLE[label]] = scalar
                if label == CRITERION_LISTS[0]:
                    row |= {"node": node, "kind": kind}
            elif label in RESULT_SCALARS:
                own[holder].setdefault(f"result_{label}", scalar)
        elif parent in own and label in (RECORD_FIELDS if parent == ROOT else CANDIDATE_SCALARS):
            own[parent].setdefault(label, scalar)
    if table == "criteria":
        return list(criteria.values())
    return [row for row in own.values() if (row["parent"] is None) == (table == "records")]


_SINGLE = dict(zip(CRITERION_LISTS, CRITERION_FIELDS, strict=True))


def _typed(name: str, kind: str) -> Column:
    """Text of a JSON scalar as its type; truth values count as numbers, whole numbers in any notation as bigint."""
    c = F.col(name)
    if kind == "double":
        return F.coalesce(c.try_cast("double"), F.when(F.lower(c) == "true", 1.0).when(F.lower(c) == "false", 0.0))
    if kind == "bigint":
        number = c.try_cast("double")
        return F.coalesce(c.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))
    if kind == "boolean":
        return F.coalesce(c.try_cast("boolean"), c.try_cast("double") != 0)
    return c.try_cast(kind)


def flat_json(df: DataFrame, record_id: str, line: str, origin: str, table: str) -> DataFrame:
    """One of the FLAT tables of JSON lines whose shape changes from line to line; Arrow batches, no shuffle."""
    columns = {c: t if c in ("cand_pos", "crit_pos") else "string" for c, t in FLAT[table].items() if c not in ("origin", "record_id")}
    arrow = pa.schema([("record_id", pa.int64()), *((c, pa.int64() if t == "bigint" else pa.string()) for c, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(ids), 500):
                rows = [row | {"record_id": i} for i, text in zip(ids[start : start + 500], lines[start : start + 500], strict=True) for row in flat_line(text, table)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    shape = ", ".join(f"{c} {t}" for c, t in ({"record_id": "bigint"} | columns).items())
    made = df.select(F.col(record_id).cast("bigint"), F.col(line).cast("string")).mapInArrow(run, shape)
    return made.select(F.lit(origin).alias("origin"), "record_id", *[F.col(c) if columns[c] == t else _typed(c, t).alias(c) for c, t in FLAT[table].items() if c in columns])
