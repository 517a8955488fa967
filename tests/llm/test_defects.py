import random
import time

import pytest

from judgelake.llm import cutoff, defects

Q = "The group keeps the lens fixed at 46 cm. How does the mirror of Klorenta change if the light is cut to 12 percent?"
GOOD = "The lens depends on the mirror, which narrows the beam by 12 percent. At 46 cm the light is spread over the whole plate."
CASES = [
    (GOOD, None), ("", "empty"), (None, "empty"), (" \n\t", "empty"), ("N/A", "empty"), ("<think>\n</think>\n", "empty"), (r"\boxed{}", "empty"), ("Answer:", "empty"), ("```\n```", "empty"), ("{}", "empty"),
    ("I'm sorry, but I can't help with that request.", "refusal"), ("<think>hm</think>As an assistant, I am not able to answer this. Thank you for understanding.", "refusal"),
    ("I'm sorry, but I can't assist with this request. Providing such information could be harmful. " + "Please consult a qualified professional, since they know the details of your case. There are good books about safety. " * 3, "refusal"),
    ("I can't give exact numbers. The lens widens the beam.", None), ("The beam is unable to follow the plate. Here the prism stands for another, and the gap bounds it.", None), ("Diese Frage darf ich leider nicht beantworten.", "refusal"), ("Je ne peux pas répondre à cette question.", "refusal"), ("抱歉,我无法回答这个问题。", "refusal"),
    ("I cannot stress enough that the mirror narrows the beam. " + GOOD, None), ("The lens is unable to widen the beam past the mirror.", None),
    (Q, "copy"), (Q.upper(), "copy"), ("You asked: " + Q, "copy"), (Q + " " + GOOD + " " + GOOD, None),
    ("Die Linse hängt von dem Spiegel ab, der das Licht nicht mehr auf die ganze Platte wirft, und wird durch den Rand begrenzt.", "language"), ("根据报告,镜子在大多数情况下取决于光线,而不是透镜。", "language"),
    ("As it says: “Die Linse hängt von dem Spiegel ab und wird begrenzt.” " + GOOD, None),
    (GOOD + " The mirror is (compare the", "truncated"), (GOOD + "\n```\nvalue = (3 +", "truncated"), (GOOD + "\n$$\n\\frac{12", "truncated"), (GOOD + " The mirror narrows th", "truncated"), (GOOD + " The mir…", "truncated"),
    (GOOD + " The **mirror narrows the beam", "truncated"), (GOOD + " <b>The mirror narrows.", "truncated"), (GOOD + "\n- lens: 46 cm\n-", "truncated"), (GOOD + "\n| lens | 46 cm |\n| light | 12", "truncated"), ("It is f(x) = {", "truncated"),
    (GOOD + "\n\\begin{align} x = 1", "truncated"), (GOOD + "\n\\begin{align} x = 1 \\end{align}", None), (GOOD + " The **mirror** narrows <b>the</b> beam.", None), ("The lens (which is fixed. It widens the beam.\n" + GOOD, None), ("<b></b>\n" * 30, "empty"),
    ("I'm sorry, but I can't help with that request. " * 12, "refusal"), ("You asked: " + (Q + "\n") * 3, "copy"), (Q.replace("lens", "lenz").replace("mirror", "miror").replace("change", "chnage").replace("percent", "precent"), "copy"),
    ("A lente depende do espelho, que não é mais largo do que o feixe, e a luz não passa pela placa quando também foi reduzida.", "language"), ("Lo specchio è più stretto della lente, ma anche la luce non passa nella lastra quando viene ridotta dal bordo.", "language"), ("レンズは鏡に依存しており、光は板全体に広がります。", "language"),
    ("Option (C)", None), ("12 percent", None), ("Klorenta.", None), ("- lens: 46 cm\n- light: 12 percent", None), (GOOD + "\n| lens | 46 cm |", None), (GOOD + "\n\\boxed{3}", None),
]


@pytest.fixture(scope="module")
def judge():
    base = [GOOD, GOOD + "\n| lens | 46 cm |", GOOD + "\n\\boxed{3}", GOOD + "\n- lens: 46 cm\n- light: 12 percent", "12 percent", "Option (C)", GOOD + " " + GOOD, GOOD + " ✅", "Klorenta.", GOOD + " What of the mirror?"]
    return defects.Judge(cutoff.train(base * 30, []))


@pytest.mark.parametrize("answer,defect", CASES)
def test_defects(judge, answer, defect):
    assert judge.judge(Q, [answer]) == [defect]


def test_without_question(judge):
    assert judge.judge(None, [GOOD, Q, "Die Linse hängt von dem Spiegel ab und wird nicht durch den Rand begrenzt."]) == [None, None, None]
    assert judge.judge("", [""]) == ["empty"]


def test_tables(spark, bank_schema):
    bench_schema = "record_id bigint, question string, answers array<struct<answer_text:string>>"
    bank = spark.createDataFrame([(1, "q", None, None, Q, "x", "y", [("c", "m", GOOD, None), None, ("c", "m", None, None), ("c", "m", "x y " * 50_000, None)]), (2, "q", None, None, None, "x", "y", None)], bank_schema)
    bench = spark.createDataFrame([(1, Q, [(Q,), (GOOD,)]), (1, Q, [(Q,), (GOOD,)])], bench_schema)
    got = {tuple(r) for r in defects.find_defects(bank, bench).collect()}
    assert ("response_bank", 1, 2, "empty") in got and ("bench", 1, 0, "copy") in got and ("response_bank", 1, 1) not in {g[:3] for g in got}
    assert defects.find_defects(bank.limit(0), bench.limit(0)).count() == 0


def test_pushdown():
    assert [defects.left_open(t) for t in ("a (b) [c]", "a (b", "a “b", "```\nx(\n```", "```\nx", "$$x$$ {", "")] == ["", "(", "“", "", "```", "{", ""]


def test_tiling():
    a, q = "one two three x one two three y".split(), "one two three four".split()
    covered, used = defects.tiles(a, q)
    assert covered.tolist() == [True, True, True, False, True, True, True, False] and used.tolist() == [True, True, True, False]


def slow_tiles(answer, question, least=3):
    """Longest common runs by trying all places."""
    free = [True] * len(answer)
    while True:
        best = 0
        for i in range(len(answer)):
            for j in range(len(question)):
                k = 0
                while i + k < len(answer) and j + k < len(question) and free[i + k] and answer[i + k] == question[j + k]:
                    k += 1
                if k > best:
                    best, at = k, i
        if best < least:
            return [not x for x in free]
        free[at : at + best] = [False] * best


def test_tiling_against_all_places():
    rng = random.Random(8)
    for _ in range(150):
        a, q = ([rng.choice("abcd") for _ in range(rng.randint(0, 24))] for _ in range(2))
        assert defects.tiles(a, q)[0].tolist() == slow_tiles(a, q)


def test_repetitive_words_in_short_time():
    began = time.perf_counter()
    for words in (["alpha"] * 1000, ["alpha", "beta"] * 500):
        assert defects.is_copy(words, defects.Asked(words[:20]))
    assert time.perf_counter() - began < 1


def test_copy_of_a_short_question():
    q = "which lamp lit the far harbour first".split()
    assert defects.is_copy("so you would like to know".split()[:5] + q, defects.Asked(q))
    assert defects.is_copy("who wrote faust".split(), defects.Asked("who wrote faust".split()))
    assert not defects.is_copy("the far harbour".split(), defects.Asked(q))
    assert not defects.is_copy(["x" * 100_000], defects.Asked(["y" * 100_001]))
