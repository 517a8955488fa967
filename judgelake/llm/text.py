"""Canonical words of a text: what case, width, accents, invisible characters, look-alike letters and punctuation leave."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

#: Letters of other scripts that look like a Latin letter.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁһԛԝьгпαβγεηικνορτυχωﬁ",
    "abekmhopctyxijsdhqwbrnabyenikvoptuxwf",
)
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}\p{Cc}--[\t\n\r\f\v]]", regex.V1)
_MIXED = regex.compile(r"[^\W\d_]*(?:[a-z][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][a-z])[^\W\d_]*")
#: A number keeps its point; a Han or Kana sign is a word of its own.
_WORD = regex.compile(r"\d+(?:[.,]\d+)*|[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[^\W\d_])+")
_ASCII_WORD = regex.compile(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+")


def fold(text: str) -> str:
    """Lower case without accents, invisible marks and look-alikes; white space and punctuation stay."""
    if text.isascii():
        return text.lower()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
    if not text.isascii():
        text = _MIXED.sub(lambda m: m.group().translate(LOOKALIKES), text)
    return text


def words_of(folded: str) -> list[str]:
    return (_ASCII_WORD if folded.isascii() else _WORD).findall(folded)


def words(text: str) -> list[str]:
    return words_of(fold(text))


def number(word: str) -> str:
    """One spelling of a number: grouping commas and a zero fraction don't count."""
    word = regex.sub(r",(?=\d{3}(?:\D|$))", "", word).replace(",", ".")
    whole, point, rest = word.partition(".")
    rest = rest.rstrip("0")
    return (whole.lstrip("0") or "0") + (point + rest if rest else "")


#: Letters of the longest word that may be a slip of another one.
LONGEST = 64


@lru_cache(maxsize=100_000)
def slip(a: str, b: str) -> bool:
    """Whether one word is a spelling slip of the other: one letter more, less or other, or two neighbours exchanged;
    two such slips in words of eight letters or more."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or max(len(a), len(b)) > LONGEST or abs(len(a) - len(b)) > 2:
        return False
    return distance(a, b) <= (2 if min(len(a), len(b)) >= 8 else 1)


def distance(a: str, b: str) -> int:
    """Edits with exchanged neighbours as one (optimal string alignment)."""
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, last = last, row
    return last[-1]
