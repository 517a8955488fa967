import random

import pytest

from judgelake.llm import leaks

FILL = [f"{a} {b} {c}" for a in ("grey", "tall", "early", "quiet") for b in ("river", "ledger", "harbour", "orchard") for c in ("slows", "turns", "waits", "ends")]


def item(k):
    rng = random.Random(k)
    name = lambda: "".join(rng.choice("klmnrst") + rng.choice("aeiou") for _ in range(4))
    return f"One reads {rng.randint(10, 900)} ms off the {name()} as soon as the {name()} of {name().title()} has settled past the {name()} decade. Show your reasoning step by step and state the units of the final value."


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, item_id string")
    t = spark.createDataFrame([(i, q, a, "clash") for i, q, a in items], "item_id bigint, question string, reference_answer string, doc_id string")
    return {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, t).collect()}


def test_written_otherwise(spark):
    items = [(k, item(k), None) for k in range(40)]
    body = item(3).split(". Show")[0]
    words = body.split()
    filler = ". ".join(FILL[:20])
    docs = [
        (1, f"{filler}. {body}. {filler}"), (2, f"{filler} {body.upper()} {filler}"), (3, f"{filler}\n> " + "\n> ".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4))),
        (4, " ".join(f"<b>{w}</b>" if i % 5 == 0 else w for i, w in enumerate(words))), (5, " ".join([*words[:7], "indeed", *words[7:]])), (6, body.replace("settled", "setttled")),
        (7, body.replace("decade", "dec-\nade")), (8, filler), (9, "Show your reasoning step by step and state the units of the final value."), (10, " ".join(words[:4])), (11, None), (12, ""), (1, f"{filler}. {body}. {filler}"),
        (13, filler * 2000 + " " + body),
    ]
    assert found(spark, docs, items) == {(i, 3) for i in (1, 2, 3, 4, 5, 6, 7, 13)}


def test_one_seed_with_slips_around_it(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("klmnrst") + rng.choice("aeiou") for _ in range(4)) for _ in range(12)]
    slips = [w if 4 <= i < 8 else w[:3] + w[3] + w[3:] for i, w in enumerate(words)]
    body = " ".join(slips)
    table = next(leaks.item_tables(spark.createDataFrame([(1, " ".join(words))], "item_id bigint, question string"), "item_id", ["question"]))
    assert len(table.hits([slips])[0]) == 1
    assert found(spark, [(1, f"{FILL[0]}. {body}. {FILL[1]}"), (2, " ".join(words[4:8]))], [(k, item(k), None) for k in range(40)] + [(99, " ".join(words), None)]) == {(1, 99)}


@pytest.mark.parametrize("sharing", [2, 3, 5, 14, 40])
def test_instruction_of_a_few_items(spark, sharing):
    stock = "Draw the whole diagram first and label each axis before you begin."
    items = [(k, item(k).split(" Show")[0] + (f" {stock}" if k < sharing else ""), None) for k in range(360)]
    docs = [(1, f"{FILL[0]}. {stock} {FILL[1]}."), (2, f"{FILL[2]}. {items[1][1]} {FILL[3]}."), (3, stock)]
    assert found(spark, docs, items) == {(2, 1)}


def test_context_of_two_items(spark):
    rng = random.Random(9)
    context = " ".join("".join(rng.choice("klmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(70))
    items = [(k, item(k), None) for k in range(50)] + [(70 + k, f"{context}. {item(70 + k)}", None) for k in range(2)]
    assert found(spark, [(1, f"{FILL[0]}. {context}. {FILL[1]}")], items) == {(1, 70), (1, 71)}


def test_line_is_chain(spark):
    items = spark.createDataFrame([(k, item(k)) for k in range(30)], "item_id bigint, question string")
    table = next(leaks.item_tables(items, "item_id", ["question"]))
    rng = random.Random(3)
    for t, words in enumerate(table.words):
        other = [w if rng.random() < 0.7 else rng.choice([w + "s", "und", "7"]) for w in words]
        pairs = {(i + 2, i) for i, (a, b) in enumerate(zip(words, other, strict=True)) if a == b}
        args = (["x", "y", *other], words, table.weights[t], pairs)
        assert table.line(*args) == pytest.approx(table.chain(*args))


def test_empty(spark):
    assert found(spark, [(1, item(1))], []) == set()
    assert found(spark, [], [(1, item(1), None)]) == set()
    assert found(spark, [(1, "a b")], [(1, None, ""), (None, item(1), None)]) == set()


def test_blocks_change_nothing(spark):
    items = spark.createDataFrame([(k, item(k), item(100 + k)) for k in range(30)], "item_id bigint, question string, reference_answer string")
    assert sum(len(t.items) for t in leaks.item_tables(items, "item_id", ["question", "reference_answer"], 200)) == 60
