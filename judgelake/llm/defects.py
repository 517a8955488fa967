"""Defective prompt and response pairs: empty, refusal, copy, language, truncated.

Each answer is read whole, in this order, and gets the first defect found:
empty      nothing but blanks, placeholders, markup and empty frames;
refusal    every sentence refuses (a grammar of who, can't or won't, answer what), is courtesy or, behind a refusal, takes
           up no word of the question, and one refuses;
copy       greedy string tiling of the answer with the question leaves next to nothing uncovered but framing;
language   script and function words of the body, quotations aside, are of another language than the question's;
truncated  a pushdown parser finds a fence, bracket, quotation, formula, environment, tag, emphasis, list item or table
           row open at the end, or the closing words look broken off to the regression of
           :mod:`judgelake.llm.cutoff`, fitted on SAMPLE answers.

Questions stand once beside all their answers, so that a record is one row until its defective pairs are known; no
shuffle is needed. Defined results: a null answer is empty, a null candidate is no pair; without a question no answer is a copy or
in another language; long answers are read whole; repeated rows give one pair per record and place; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm import cutoff
from judgelake.llm.text import LONGEST, fold, slip, words_of

SAMPLE = 5000
#: Share of an answer's words that must stand in the question, and words that framing may add.
COVERED, FRAMING = 0.82, 5
#: A copy has this share of its words at the beginning of three that stand so in the question, or gives this share of the question back;
#: and so many of its words stand in the question letter by letter.
DENSE, GIVEN, LITERAL = 0.45, 0.75, 0.4
TILE = 3
THRESHOLD = 0.6

_THINK = regex.compile(r"<think>.*?</think>", regex.S | regex.I)
_OPEN_THINK = regex.compile(r"</?think>", regex.I)
#: Words that stand in place of an answer.
_PLACEHOLDER = regex.compile(
    r"^(?:n/?a|null|none|nil|nan|undefined|empty|blank|tbd|todo|no (?:response|answer|output|reply)|(?:response|answer) (?:missing|pending|unavailable)|not (?:available|applicable|provided)|missing|placeholder|unknown error|error)$",
    regex.I,
)
_FRAME = regex.compile(r"</?[a-z][^<>]*>|\\boxed\b|\\(?:text|frac)\b|```\w*|(?:^|\n)\W*(?:final\s+)?(?:answer|response|result|output|antwort|réponse|respuesta|ответ|a|r)\s*[:=]", regex.I)

# A grammar of refusals by language: who can't, won't or may not ... do what an answer does.
_EN_NOT = r"(?:can(?:no|')t|can not|cannot|could not|couldn't|won't|will not|(?:am|is|are|be|I'm|been) (?:un|not )able to|unable to|(?:am|is|are|I'm)? ?not (?:allowed|permitted|authori[sz]ed|in a position|comfortable|going|willing|able)|don't feel comfortable|do not feel comfortable|(?:must|have to|would|will|need to|to) (?:decline|refuse)|declin(?:e|ed|es) to|refus(?:e|es|ed) to|(?:would|'d) (?:rather|prefer) not|(?:rather|prefer) not|chosen not to|choose not to|prevents? me from|keeps? me from|forbids? me|not (?:be )?appropriate|set up not to|no (?:answer|reply|response|comment))"
_EN_DO = r"(?:answer|respond|repl|help|assist|discuss|comment|compl[iy]|provid|offer|giv|shar|attempt|work|talk|go into|tak(?:e|ing) part|speak|address|engag|proceed|continu|say|produc|follow|do (?:that|this|so)|that request|this request)"
_REFUSALS = [
    regex.compile(rf"{_EN_NOT}\b[^.!?]{{0,60}}?\b{_EN_DO}", regex.I),
    regex.compile(r"\b(?:answer|opinion|reply|response|advice)\b[^.!?]{0,60}\b(?:won't|will not|can't|cannot|not) (?:do|be given|be offered|be provided|follow)", regex.I),
    regex.compile(r"\b(?:request (?:was )?(?:declined|denied|refused|blocked)|(?:prompt|request|question) (?:was|has been|is) (?:blocked|declined|rejected|refused))", regex.I),
    regex.compile(r"\b(?:outside|beyond|against|not within) (?:what (?:I|we|this|the)|my|our|the)\b[^.!?]{0,40}\b(?:allowed|(?:may|can) (?:comment|answer|discuss|say|speak|address)|polic|guideline|role|scope|remit|permitted|rules|abilit|capabilit)", regex.I),
    regex.compile(r"\b(?:my (?:role|guidelines|instructions|policy|rules)) (?:do(?:es)? not|don't|doesn't|prevents?|forbids?|prohibits?)", regex.I),
    regex.compile(r"\b(?:keep silent|stay silent|remain silent|not a (?:topic|subject|matter) for me|no (?:reply|answer|response) will follow|left to human|leave aside|I will stop here|not something I)\b", regex.I),
    regex.compile(r"\b(?:I'?d|I would|we would|would) (?:prefer|rather|like) (?:that )?(?:we |to )?(?:talk|speak|move|turn|discuss)[^.!?]{0,30}\b(?:other than|instead|something else|another)", regex.I),
    regex.compile(r"\b(?:ask you to|please|should) (?:turn to|consult|contact|see) (?:somebody|someone|a (?:qualified|licensed|human)|an expert)", regex.I),
    regex.compile(r"\b(?:kann|darf|möchte|werde|will|könn\w+|konnte)\b[^.!?]{0,60}\b(?:nicht|kein\w*|nichts)\b[^.!?]{0,40}\b(?:beantwort|antwort|helf|auskunft|äußer|sagen|besprech|geben|weiterhelf)|\b(?:nicht|keine?)\b[^.!?]{0,40}\b(?:beantworten|antwort geben|auskunft)|\b(?:verweigere|lehne)\b|leider nicht (?:möglich|erlaubt)|antwort ist (?:mir )?nicht", regex.I),
    regex.compile(r"\b(?:ne (?:peux|puis|pouvons|veux|souhaite|suis|dois)|préfère ne|n'ai pas le droit|refuse de|m'est (?:pas |im)?possible|pas (?:autorisé|permis|en mesure)|impossible de)\b[^.!?]{0,60}\b(?:répon\w*|aider|donner|traiter|discuter|satisfaire|parler)|\bpas de réponse|\bne (?:m'est|nous est) pas", regex.I),
    regex.compile(r"\b(?:no (?:puedo|podemos|podré|debo|quiero|me (?:es|está)|estoy|es posible|voy a)|prefiero no|me niego|imposible|lamento no)\b[^.!?]{0,60}\b(?:respon\w*|ayudar|contestar|dar|respuesta|hablar|atender|tratar)", regex.I),
    regex.compile(r"(?:не (?:могу|можем|буду|вправе|имею права|разрешено|смогу|готов|стану)|вынужден|отказыва|невозможно|нельзя|предпочитаю не)[^.!?]{0,60}(?:ответ|отвеч|помо|обсужд|коммент|дать|говорить|отказ)", regex.I),
    regex.compile(r"(?:无法|不能|不便|拒绝|不可以|不方便|不予|没办法|不会|不允许|无权|不愿|恕)[^。！？]{0,20}(?:回答|答复|帮助|帮|讨论|提供|回应|评论|作答|处理|答案|协助)|(?:抱歉|对不起)[^。]{0,10}(?:不|无)"),
]
#: What is said in the words of a refusal but refuses nothing: emphasis, a name that isn't accepted, an excuse for length.
_NOT_REFUSAL = regex.compile(
    r"\b(?:cannot|can't|can not|couldn't|could not) (?:stress|emphasi[sz]e|overstate|understate|help but)\b|\b(?:declin|refus)(?:e|ed|es) to (?:call|accept|treat|believe)\b"
    r"|\bthat this is (?:so |too |rather )?(?:long|short|late|brief)\b", regex.I,
)
#: The first person in languages that name it.
_FIRST_PERSON = regex.compile(r"\b(?:I|we|my|me|us|our|ich|wir|mir|uns|je|j|nous|moi|m)\b", regex.I)
_COURTESY = regex.compile(
    r"^(?:hm+|sure|ok(?:ay)?|well|sorry|unfortunately|apologies|thanks? (?:you )?(?:for|very)|thank you|let me be frank|i understand|if you have (?:another|other|any)|is there (?:something|anything)|"
    r"questions? (?:about|on)|the topic of|you (?:asked|want)|please|feel free|i'?m happy|i am happy|happy to|still|while|in case|as an? (?:assistant|ai|language|model)|danke|entschuldig|tut mir|merci|désolé|je (?:suis )?désolé|"
    r"gracias|lo siento|disculp|perdón|извини|прост|спасибо|к сожалению|抱歉|对不起|谢谢|感谢|the assistant|request|.{0,12}$)", regex.I,
)
_SPLIT = regex.compile(r"(?<=[.!?。！？])\s*|\n+|(?<=[:;])\s+")

#: Function words that tell a language from the others here.
_FUNCTION = {
    "en": "the of and is are was were that this which with for from by it its on as at be not or an has have can will does what how if to in a",
    "de": "der die das und ist nicht mit von den dem des ein eine einen für auf bei wird sich auch nach aus nur zu im wenn dass welche wie warum man durch über hat",
    "fr": "le la les des est et dans pour par une du au aux que qui ne pas sur avec ce cette son sa plus quel quelle comment pourquoi on devient reste dès selon lorsque",
    "es": "el la los las es y en por para una del al que no con se su un cuando cómo qué según como más muy sin entre queda cuál solo",
}
#: Function words of further languages, asked only where those above don't tell.
_FURTHER = {
    "pt": "o os as um uma do da dos das no na nos nas em para com não que é são por mais como mas ao pelo pela seu sua quando também foi",
    "it": "il lo gli di del della dei delle un una che è sono non per con nel nella più come ma anche questo questa quando viene dal alla si",
    "nl": "de het een van en is zijn niet met voor op aan te dat die er ook naar bij wordt door uit maar als om deze dit heeft",
    "sv": "och att det som en ett är av för med på den till inte har de om från vid kan men så när eller efter också",
    "da": "og at det som en et er af for med på den til ikke har de om fra ved kan men så når eller efter også bliver",
    "pl": "i w na z się nie do jest to że o jak po co tak za od przez przy dla są czy ale jego oraz który która",
    "cs": "a v na se je že z s o do to i pro za ve jako po ale by jsou není který která nebo při od podle",
    "hu": "a az és hogy nem is egy van volt ez azt meg de mint csak ha vagy el már még kell ki lesz mert",
    "ro": "și în de la cu nu o un este pe din pentru mai care să că sunt sau prin dar ca fi după când acest",
    "tr": "ve bir bu için ile da de olarak daha çok olan gibi kadar sonra ancak ya değil her en ise var ne",
    "id": "yang dan di dari untuk dengan ini itu pada adalah tidak dalam akan ke oleh juga sebagai karena atau dapat telah lebih",
    "fi": "ja on ei se että oli hän mutta kun ovat myös tai joka niin kuin voi ole tämä sen jos vain sekä",
}
#: Scripts that tell a language or a family, with the characters that must be of them in all.
_SCRIPTS = [
    (name, regex.compile(rf"[{signs}]"), least) for name, signs, least in (
        ("ja", r"\p{Hiragana}\p{Katakana}", 4), ("ko", r"\p{Hangul}", 4), ("ar", r"\p{Arabic}", 8), ("he", r"\p{Hebrew}", 8), ("el", r"\p{Greek}", 8),
        ("hi", r"\p{Devanagari}", 8), ("th", r"\p{Thai}", 8), ("ka", r"\p{Georgian}", 8), ("hy", r"\p{Armenian}", 8), ("bn", r"\p{Bengali}", 8), ("ta", r"\p{Tamil}", 8),
    )
]


def _by_word(lists: dict[str, str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, listed in lists.items():
        for w in dict.fromkeys(map(fold, listed.split())):
            out.setdefault(w, []).append(name)
    return out


_WORD_LANGUAGE, _WORD_FURTHER = _by_word(_FUNCTION), _by_word(_FUNCTION | _FURTHER)
_QUOTED = regex.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]{12,}\"")
_HAN, _CYRILLIC = regex.compile(r"\p{Han}"), regex.compile(r"\p{Cyrillic}")


def language(text: str, least: int = 3, words: list[str] | None = None) -> str | None:
    """Language of a text by script and function words; None where too little tells. words: its words, if they are known."""
    if not text.isascii():
        letters = max(1, sum(map(str.isalpha, text)))
        for name, signs, few in _SCRIPTS:
            met = len(signs.findall(text))
            if met >= few and met * (5 if name == "ja" else 2) > letters:
                return name
        han, cyrillic = len(_HAN.findall(text)), len(_CYRILLIC.findall(text))
        if han * 2.5 > letters and han >= 4:
            return "zh"
        if cyrillic * 2 > letters and cyrillic >= 8:
            return "ru"
    words = words_of(fold(text)) if words is None else words
    return _told(words, _FUNCTION, _WORD_LANGUAGE, least) or _told(words, _FUNCTION | _FURTHER, _WORD_FURTHER, least + 2)


def _told(words: list[str], names: dict[str, str], by_word: dict[str, list[str]], least: int) -> str | None:
    sums = dict.fromkeys(names, 0.0)
    for w in words:
        if by := by_word.get(w):
            for x in by:
                sums[x] += 1 / len(by)
    first, second = sorted(sums.items(), key=lambda x: -x[1])[:2]
    return first[0] if first[1] >= least and first[1] >= 1.4 * second[1] else None


def is_empty(body: str) -> bool:
    inner = body.strip().strip("\"'`[](){}<>.,:;!?-–—_*#|/\\ \n\t​﻿\xa0")
    if not inner or _PLACEHOLDER.match(inner):
        return True
    rest = _FRAME.sub(" ", body)
    inner = rest.strip("\"'`[](){}<>.,:;!?-–—_*#|/\\$= \n\t​﻿\xa0")
    return not any(c.isalnum() for c in inner) and not any(ord(c) > 0x2100 for c in inner) or bool(_PLACEHOLDER.match(inner))


def is_refusal(body: str, known: set[str] | frozenset[str] = frozenset()) -> bool:
    """Whether an answer refuses and does nothing else: courtesy may come with it and, behind a refusal in the first
    person, sentences that take up no word of the question (known), such as reasons and advice."""
    refused = spoken = False
    for part in _SPLIT.splititer(body):
        part = part.strip()
        if not part:
            continue
        if not _NOT_REFUSAL.search(part) and any(r.search(part) for r in _REFUSALS):
            refused, spoken = True, spoken or bool(_FIRST_PERSON.search(part))
        elif not _COURTESY.match(part) and not (spoken and known and not any(len(w) > 3 and w in known for w in words_of(fold(part)))):
            return False
    return refused


_BASE = 0x9E3779B97F4A7C15


class _Runs:
    """Hashes of all runs of a word list, whatever their length, from sums over its beginnings."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        power = np.ones(self.n + 1, dtype=np.uint64)
        np.cumprod(np.full(self.n, _BASE, dtype=np.uint64), out=power[1:])
        self.power = power
        np.cumsum(ids * power[:-1], out=self.sums[1:])
        self.free = np.ones(self.n, dtype=bool)

    def of(self, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of so many free words begins, and its hash, made comparable by the power of its place."""
        if size > self.n:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[size:] == taken[: self.n - size + 1])
        with np.errstate(over="ignore"):
            return at, (self.sums[at + size] - self.sums[at]) * self.power_to(most, at)

    def power_to(self, most: int, at: np.ndarray) -> np.ndarray:
        powers = np.ones(most + 1, dtype=np.uint64)
        np.cumprod(np.full(most, _BASE, dtype=np.uint64), out=powers[1:])
        return powers[most - at]


def tiles(answer: list[str], question: list[str], least: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Greedy string tiling: longest common runs first, each word of the answer in one tile; the question may be given
    back several times. Which words of both are covered.

    Runs of one length are compared by their hashes, and the longest length that still has a common run is found by
    halving, so that each length costs time in proportion to the words, repetitive texts included.
    """
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) for words in (answer, question)]
    a, q = _Runs(ids[0]), _Runs(ids[1])
    most, used = max(a.n, q.n), np.zeros(q.n, dtype=bool)

    def common(size: int) -> tuple[np.ndarray, np.ndarray]:
        (at, x), (to, y) = a.of(size, most), q.of(size, most)
        return at[np.isin(x, y)], to[np.isin(y, x)]

    longest = min(a.n, q.n)
    while longest >= least:
        low, high = least - 1, longest
        while low < high:  # whether a run of some length is left is monotone in the length
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        longest = low
        if longest < least:
            break
        at, to = common(longest)
        end = -1
        for i in at.tolist():
            if i >= end:
                end = i + longest
                a.free[i:end] = False
        for j in to.tolist():
            used[j : j + longest] = True
        longest -= 1
    return ~a.free, used


def _shortened(word: str) -> set[str]:
    """The word, and what is left of it without one letter, of a long one also without two. Two words of which one is a
    slip of the other have one of these in common."""
    out = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    if len(word) >= 8:
        out |= {w[:i] + w[i + 1 :] for w in tuple(out) if len(w) < len(word) for i in range(len(w))}
    return out


class Asked:
    """The words of a question, and which of them a misspelt word means."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.known = words, set(words)
        self.near: dict[str, list[str]] | None = None
        self.found: dict[str, str] = {}

    def meant(self, word: str) -> str:
        """The question's word of which this one is a slip, the first in order; the word itself if there is none."""
        if word not in self.found:
            if self.near is None:
                self.near = {}
                for w in sorted(w for w in self.known if len(w) <= LONGEST):
                    for x in _shortened(w):
                        self.near.setdefault(x, []).append(w)
            close = sorted({w for x in _shortened(word) for w in self.near.get(x, ())}) if len(word) <= LONGEST else []
            self.found[word] = next((w for w in close if slip(word, w)), word)
        return self.found[word]


def is_copy(answer: list[str], asked: Asked) -> bool:
    """Whether the answer gives the question back: slips of its words count as these words, tiles cover the most, and
    what they leave are words of the question in another order or a few words of framing."""
    question, known = asked.words, asked.known
    if not answer or not question:
        return False
    strange = [w for w in answer if w not in known]
    if len(strange) > (1 - LITERAL) * len(answer):
        return False
    unknown = 0
    for w in strange:
        unknown += asked.meant(w) not in known
        if unknown > FRAMING:
            return False
    if strange:
        answer = [w if w in known else asked.meant(w) for w in answer]
    if len(answer) < 5:
        return answer == question
    covered, used = tiles(answer, question)
    left = Counter(w for w, u in zip(question, used.tolist(), strict=True) if not u)
    open_words = 0
    for w, c in zip(answer, covered.tolist(), strict=True):
        if not c:
            open_words += left[w] < 1
            left[w] -= 1
    rest = len(answer) - int(covered.sum())
    grams = {tuple(question[i : i + TILE]) for i in range(len(question) - TILE + 1)}
    dense = sum(tuple(answer[i : i + TILE]) in grams for i in range(len(answer) - TILE + 1)) >= DENSE * len(answer)
    return (dense or min(used.sum(), covered.sum()) >= GIVEN * len(question)) and open_words <= FRAMING and (open_words <= (1 - COVERED) * len(answer) or rest <= FRAMING)


#: Tags that are always closed; others may stand open.
_PAIRED = "a|b|i|u|em|strong|code|pre|sub|sup|span|div|ul|ol|dl|table|thead|tbody|blockquote|h[1-6]|font|small|big|del|ins|mark|kbd|q|details|section"
_MARKS = regex.compile(
    rf"(?P<fence>```)|(?P<formula>\$\$)|\\(?P<side>begin|end)\{{(?P<environment>[^{{}}\n]*)\}}|\\[a-zA-Z]+\{{|\\[()\[\]{{}}]|</?(?P<tag>{_PAIRED})(?:\s[^<>]*)?>|(?P<strong>(?<!\*)\*\*(?!\*))|(?P<tick>`)|[(\[{{“«„)\]}}”»\"]|\n"
)
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_FINISHED = regex.compile(r"[.!?:;。！？：；)\]|>*`_]\s*$")
#: A list item of which only the mark is there, after another item or a line that announces it.
_EMPTY_ITEM = regex.compile(r"(?:^|\n)[ \t]*[-*+•][ \t]+\S[^\n]*\n\s*[-*+•]\s*$|(?:^|\n)[ \t]*\d+[.)][ \t]+\S[^\n]*\n\s*\d+[.)]\s*$|:\s*\n\s*[-*+•]\s*$")
_ROW = regex.compile(r"^[ \t]*\|.*\|[ \t]*$")


def left_open(body: str) -> str:
    """Pushdown parser over fences, formulas, environments, brackets, quotations, tags, emphasis, lists and tables:
    what is open at the end of the text. Emphasis and code within a line end with the line or paragraph; a bracket or
    quotation that a finished line leaves open is a slip of the pen."""
    stack: list[str] = []

    def close(mark: str) -> None:
        if mark in stack:
            while stack.pop() != mark:
                pass

    for m in _MARKS.finditer(body):
        mark, top = m.group(), stack[-1] if stack else ""
        if top == "```" and not m["fence"] or top == "`" and mark not in ("`", "\n"):
            continue  # code is no text
        if m["fence"] or m["formula"] or mark == '"' or m["tick"]:
            if mark in stack:
                close(mark)
            else:
                stack.append(mark)
        elif m["strong"]:
            before, after = body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1]
            if "**" in stack and before and not before.isspace():
                close("**")
            elif after and not after.isspace() and not (before.isalnum() and after.isalnum()):
                stack.append("**")
        elif m["side"] or m["tag"]:
            name = f"\\{m['environment']}" if m["side"] else f"<{m['tag']}>"
            if m["side"] == "end" or mark[1] == "/":
                close(name)
            else:
                stack.append(name)
        elif mark in _PAIRS:
            close(_PAIRS[mark])
        elif mark == "\n":
            if top == "`" or top == "**" and body[m.end() : m.end() + 1] in ("\n", ""):
                stack.pop()
            elif top in ('"', "(", "[") and _FINISHED.search(body, max(0, m.start() - 8), m.start()):
                stack.pop()
        elif mark[0] != "\\" or mark[-1] == "{" and len(mark) > 2:
            stack.append("{" if mark[-1] == "{" else "“" if mark == "„" else mark)
    if stack:
        return stack[-1]
    lines = body.rsplit("\n", 2)
    last = lines[-1].strip()
    if last.startswith("|") and not last.endswith("|") and len(lines) > 1 and _ROW.match(lines[-2]):
        return "|"
    return "-" if _EMPTY_ITEM.search(body, max(0, body.rfind("\n", 0, max(0, body.rfind("\n"))))) else ""


class Judge:
    """Finds the defect of each answer to one question."""

    def __init__(self, model: cutoff.Model) -> None:
        self.model = model

    def judge(self, question: str | None, answers: list[str | None]) -> list[str | None]:
        asked = Asked(words_of(fold(question)) if question else [])
        spoken = language(question) if asked.words else None
        return [self.defect(a, asked, spoken) for a in answers]

    def defect(self, answer: str | None, asked: Asked, spoken: str | None) -> str | None:
        body = answer or ""
        if "<think" in body or "</think" in body:
            closed = _THINK.sub(" ", body)
            if "<think>" in closed and "</think>" not in closed:
                return "truncated" if any(c.isalnum() for c in closed.split("<think>", 1)[1]) else "empty"
            body = _OPEN_THINK.sub(" ", closed)
        if is_empty(body):
            return "empty"
        if is_refusal(body.strip(), asked.known):
            return "refusal"
        words = words_of(fold(body))
        if is_copy(words, asked):
            return "copy"
        if spoken:
            own = language(_QUOTED.sub(" ", body)) if any(q in body for q in "“«„\"") else language(body, words=words)
            if own and own != spoken:
                return "language"
        if left_open(body.rstrip()) or self.model.score(body) >= THRESHOLD:
            return "truncated"
        return None


def _answers(rows: DataFrame, array: str, field: str, origin: str) -> DataFrame:
    """origin, record_id, question, pos and answers of the pairs of a record; null elements are no pairs."""
    kept: Column = F.filter(F.transform(array, lambda c, i: F.struct(i.cast("bigint").alias("pos"), c.isNotNull().alias("there"), c[field].alias("answer"))), lambda x: x["there"])
    return rows.filter(F.col("record_id").isNotNull() & (F.size(array) > 0)).select(
        F.lit(origin).alias("origin"), F.col("record_id").cast("bigint").alias("record_id"), F.col("question").cast("string").alias("question"),
        kept["pos"].alias("pos"), kept["answer"].alias("answers"),
    )


def find_defects(bank: DataFrame, bench: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(origin, record_id, pos, defect) of the defective pairs of both tables."""
    pairs = _answers(bank, "candidates", "response", "response_bank").unionByName(_answers(bench, "answers", "answer_text", "bench"))
    values = pairs.select(F.lit("answer").alias("field"), "origin", "record_id", F.posexplode("answers").alias("place", "value")).filter(F.col("value").rlike(r"\S"))
    limits, totals = cutoff.survey(values)
    drawn = cutoff.sampled(values, ["origin", "record_id", "place"], totals, sample).get("answer", [])
    shared = bank.sparkSession.sparkContext.broadcast(Judge(cutoff.train(drawn, limits.get("answer", []))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            found = []
            for origin, record, question, pos, answers in zip(*(batch.column(c).to_pylist() for c in ("origin", "record_id", "question", "pos", "answers")), strict=True):
                found += [(origin, record, p, d) for p, d in zip(pos, judge.judge(question, answers), strict=True) if d]
            cols = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["origin", "record_id", "pos", "defect"],
            )

    return pairs.mapInArrow(run, "origin string, record_id bigint, pos bigint, defect string")
