"""Token ids of whole texts by corpus-level merge replay of a public byte-level BPE.

Every batch of documents is split into pre-tokens; the distinct ones not met before are laid out as one sequence
of byte symbols, and an inverted index from symbol pair to positions replays the merge list in rank order. A merge
touches only its own positions and their neighbours. Since a symbol is made by one merge and only later merges use
it, one pass over the ranks gives exactly what merging word by word gives.

Defined results: null and empty texts have an empty list; blank texts and strings that look like special tokens are
ordinary text; long texts are encoded whole; repeated doc_ids give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pre-token pattern published with this vocabulary.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeReplay:
    """Merge ranks of one vocabulary and the ids of the pre-tokens met so far."""

    def __init__(self, content: bytes) -> None:
        model = json.loads(content)["model"]
        vocabulary = model["vocab"]
        self.of_byte = [0] * 256
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocabulary[letter]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocabulary[left], vocabulary[right]] = len(self.made)
            self.made.append(vocabulary[left + right])
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PRETOKEN).findall

    def replay(self, words: Iterable[str]) -> None:
        """Learn the ids of distinct pre-tokens: all merges in rank order over all of them at once."""
        symbol, start = [], []
        words = list(words)
        of_byte, rank_of, made = self.of_byte, self.rank, self.made
        for word in words:
            start.append(len(symbol))
            symbol += [of_byte[b] for b in word.encode("utf-8", "surrogatepass")]
            symbol.append(-1)  # no pair reaches over the end of a word
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            if (r := rank_of.get((symbol[i], symbol[i + 1]))) is not None:
                index.setdefault(r, []).append(i)
        todo = list(index)
        heapq.heapify(todo)
        while todo:
            r = heapq.heappop(todo)
            new = made[r]
            places = index.pop(r)
            places.sort()  # from the left, as "aaa" merges
            for i in places:
                j = after[i]
                if j >= n or symbol[i] < 0 or rank_of.get((symbol[i], symbol[j])) != r:
                    continue
                symbol[i], symbol[j] = new, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (s := rank_of.get((new, symbol[k]))) is not None:
                        if s not in index:
                            index[s] = []
                            heapq.heappush(todo, s)
                        index[s].append(i)
                h = before[i]
                if h >= 0 and (s := rank_of.get((symbol[h], new))) is not None:
                    if s not in index:
                        index[s] = []
                        heapq.heappush(todo, s)
                    index[s].append(h)
        known = self.known
        for w, word in enumerate(words):
            end = start[w + 1] - 1 if w + 1 < len(words) else n - 1
            known[word] = [s for s in symbol[start[w] : end] if s != -2]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pieces = [self.split(t) if t else [] for t in texts]
        new = {w for words in pieces for w in words if w not in self.known}
        if new:
            self.replay(sorted(new))
        known, out = self.known, []
        for words in pieces:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out


#: Vocabularies of this worker, by digest of their file.
_LOADED: dict[str, MergeReplay] = {}


def _loaded(digest: str, content: Callable[[], bytes]) -> MergeReplay:
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = MergeReplay(content())
    return _LOADED[digest]


#: Bytes of the largest vocabulary file that is sent to the workers.
LARGEST = 64_000_000


def encode_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, rows: int = 1000) -> DataFrame:
    """(doc_id, ids) of every document. A narrow map over Arrow batches: no shuffle, one pass over the texts.

    rows: documents encoded at a time, which bounds the memory of a worker whatever the batch size. The vocabulary file is
    read by the driver and sent to the workers.
    """

    content = Path(vocabulary).read_bytes()
    if len(content) > LARGEST:
        raise ValueError(f"the vocabulary file has more than {LARGEST} bytes")
    digest, shared = hashlib.sha256(content).hexdigest(), documents.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(digest, lambda: shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = model.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>"
    )
