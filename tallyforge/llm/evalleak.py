"""Evaluation texts that leak into training documents.

The words of all evaluation texts are numbered and their five-word sequences go, as sorted
numbers, into a broadcast hash table; the evaluation set is bounded (``MAX_EVAL_WORDS`` a
scan; larger sets are worked off in blocks).  Every document is read once, without a
shuffle: a five-word sequence found in the table is a candidate, and each candidate is
verified by aligning document and item outwards from it.

A leak is a stretch of consecutive item words of which at most one in ten is replaced, dropped or added, and
of which the document holds 20 or more as they are; its first and last word are held.  Nothing is lost:

* A leak with e edits has at most e + 1 intact runs.  With 20 held words and two edits, or 10 e words, e of them
  edited, one of the runs has at least seven words.
* A leak that contains no shorter one has at most five edits.  For let it have n words and e >= 6 edits, e <= n / 10.
  If its first 30 words had at most three edits, they would, cut back to their last held word, still be a leak:
  27 words or more with one edit in ten, 24 or more of them held.  So they have four, the last n - 30 words likewise
  more than (n - 30) / 10, and together there are more than n / 10.  Around an intact run of a leak, five
  edits therefore reach a leak.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import spread

GRAM = 5
MIN_WORDS = 20
ONE_IN = 10
LEAST_RUN = 7
DECIDING_EDITS = 5
MAX_EVAL_WORDS = 5_000_000  # about 20 bytes a word and 150 a distinct word in each Python worker

_JOINERS = "-'’‐‑­​‌‍⁠﻿"
_WORD = re.compile(rf"[^\W_]+(?:(?:[{_JOINERS}](?=[^\W_])|(?<=\d)[:./,](?=\d))[^\W_]+)*")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|\\[nrtbf]|\]\([^()\s]*\)|\\u[0-9a-fA-F]{4}")
_LABEL = re.compile(r"\b(?:question|answer)[*_\s]*:", re.IGNORECASE)


def _spaces(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def _plain(text: str) -> str:
    """Markup and labels as blanks, so that positions stay."""
    if "<" in text or "&" in text or "\\" in text or "](" in text:
        text = _MARKUP.sub(_spaces, text)
    return _LABEL.sub(_spaces, text) if ":" in text else text


def _key(word: str) -> str:
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
    word = word.casefold()
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


class _Ids(dict):
    """Word as written to its number in a vocabulary, 0 if unknown; emptied now and then, as it follows from the vocabulary."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        number = self[word] = self.vocabulary.get(_key(word), 0)
        return number


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, spacing, markup and labels; dates, times and hyphenated words are one word."""
    text = _plain(text or "")
    if text.isascii():
        return [w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in _WORD.findall(text.lower())]
    return [_key(w) for w in _WORD.findall(text)]


_RADIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_numbers(ids: np.ndarray) -> np.ndarray:
    """A number for the five words from each place on; 0 where one of them is unknown."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    number, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            part = ids[k : k + n]
            number = (number + part.astype(np.uint64) + np.uint64(1)) * _RADIX
            number ^= number >> np.uint64(29)
            whole &= part > 0
    return np.where(whole, number | np.uint64(1), np.uint64(0))


@dataclass
class EvalIndex:
    """Evaluation texts as numbered words, and the places of their five-word sequences in the order of the sequences' numbers."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    texts: list[np.ndarray] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)
    _sorted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def add(self, tokens: list[str], items: list[int]) -> None:
        self.texts.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens], np.int32))
        self.items.append(items)
        self._sorted = None

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers in ascending order, text, place in the text)."""
        if self._sorted is None:
            numbers = [_gram_numbers(t) for t in self.texts]
            whole = np.concatenate([*numbers, np.zeros(0, np.uint64)])
            text = np.repeat(np.arange(len(numbers), dtype=np.int32), [len(x) for x in numbers])
            place = np.concatenate([*(np.arange(len(x), dtype=np.int32) for x in numbers), np.zeros(0, np.int32)])
            order = np.argsort(whole, kind="stable")
            self._sorted = whole[order], text[order], place[order]
        return self._sorted


def openings(passage: str) -> list[tuple[int, int]]:
    """(hash, number of words) of a passage's beginning up to each end of a sentence; linear in its length."""
    out: list[tuple[int, int]] = []
    said, n = xxhash.xxh64(), 0
    for sentence in re.split(r"(?<=[.!?:])\s+", passage):
        for w in words(sentence):
            said.update(w + " ")
            n += 1
        if n and (not out or out[-1][1] != n):
            out.append((said.intdigest() - (1 << 63), n))
    return out


def standing_instructions(items: DataFrame, least: int = 3, share: float = 0.05) -> dict[str | None, set[int]]:
    """Per suite, the hashes of the beginnings that its passages share.

    By definition a beginning, at the end of any sentence, is a standing instruction if at least ``least`` and
    ``share`` of the suite's distinct passages begin with it.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(s, o) for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for o, _ in openings(p)]
            yield pa.record_batch([pa.array([s for s, _ in pairs], pa.string()), pa.array([o for _, o in pairs], pa.int64())], names=["suite", "opening"])

    passages = items.filter("passage is not null").select("suite", "passage").distinct()
    counts = passages.mapInArrow(opened, "suite string, opening long").groupBy("suite", "opening").agg(F.count(F.lit(1)).alias("n"))
    whole = passages.groupBy(F.col("suite").alias("of")).agg(F.count(F.lit(1)).alias("passages"))
    enough = F.greatest(F.lit(float(least)), F.col("passages") * share)
    out: dict[str | None, set[int]] = defaultdict(set)
    # At each end of a sentence a suite has at most 1 / share of them.
    for r in counts.join(whole, F.col("suite").eqNullSafe(F.col("of"))).filter(F.col("n") >= enough).collect():
        out[r["suite"]].add(r["opening"])
    return out


def eval_blocks(items: DataFrame) -> Iterator[EvalIndex]:
    """Indexes over the items (item_id, suite, passage, question, answer), at most ``MAX_EVAL_WORDS`` words each."""
    rows = items.select("item_id", "suite", "passage", "question", "answer")
    instructions = standing_instructions(rows)
    texts: dict[tuple[str, ...], list[int]] = defaultdict(list)
    n = 0

    def index() -> EvalIndex:
        made = EvalIndex()
        for tokens, ids in texts.items():
            made.add(list(tokens), sorted(set(ids)))
        made.grams()
        return made

    for r in rows.toLocalIterator():
        passage, known = words(r["passage"]), instructions.get(r["suite"], set())
        passage = passage[max((k for o, k in openings(r["passage"] or "") if o in known), default=0) :]
        for tokens in (passage, words(r["question"]) + words(r["answer"])):
            if len(tokens) >= MIN_WORDS:
                texts[tuple(tokens)].append(r["item_id"])
                n += len(tokens)
        if n > MAX_EVAL_WORDS:
            yield index()
            texts, n = defaultdict(list), 0
    if texts:
        yield index()


def _reach(item: list[int], doc: list[int]) -> Iterator[tuple[int, int]]:
    """(words of ``item`` covered, those of them held) by the start of ``doc`` with 0, 1, 2 ... edits, the last one held."""
    n, m = len(item), len(doc)
    i = 0
    while i < n and i < m and item[i] == doc[i]:
        i += 1
    front = {0: (i, i)}
    best = (i, i)
    while True:
        yield best
        after: dict[int, tuple[int, int]] = {}
        for d, (i, held) in front.items():
            for nd, ni in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                if ni <= n and 0 <= ni + nd <= m and (ni, held) > after.get(nd, (-1, 0)):
                    after[nd] = (ni, held)
        front = {}
        for d, (i, held) in after.items():
            since = i
            while i < n and i + d < m and item[i] == doc[i + d]:
                i += 1
            front[d] = (i, held + i - since)
            if front[d] > best and i > since:
                best = front[d]


def _verified(item: list[int], doc: list[int], i: int, j: int) -> tuple[int, int] | None:
    """The doc words [from, to) of the longest leak around the shared words item[i:], doc[j:], if there is one."""
    most = max(DECIDING_EDITS, len(item) // ONE_IN)
    margin = len(item) + most
    to_right = _reach(item[i:], doc[j : j + margin])
    to_left = _reach(item[:i][::-1], doc[max(0, j - margin) : j][::-1])
    right: list[tuple[int, int]] = []
    left: list[tuple[int, int]] = []
    best = None
    for edits in range(most + 1):
        right.append(next(to_right))
        left.append(next(to_left))
        each = ((right[a], left[edits - a]) for a in range(edits + 1))
        (r, held_r), (le, held_l) = max(each, key=lambda x: (x[0][0] + x[1][0], x[0][1] + x[1][1]))
        if held_r + held_l >= MIN_WORDS and r + le >= edits * ONE_IN and (best is None or r + le > best[1] - best[0]):
            best = (max(0, j - le), min(len(doc), j + r))
        if best is None and edits >= DECIDING_EDITS or right[-1][0] == len(item) - i and left[-1][0] == i:
            break
    return best


def leaks_in(index: EvalIndex, ids: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Text number to the doc word spans that leak it; ids: the document's words, 0 if unknown to the index."""
    known, _, _ = index.grams()
    grams = _gram_numbers(np.array(ids, np.int32))
    if not len(known) or not len(grams):
        return {}
    return _leaks(index, ids, grams, np.searchsorted(known, grams, "left"))


def _leaks(index: EvalIndex, ids: list[int], grams: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """As ``leaks_in``, given the document's sequences and where they would be among the index's."""
    known, of_text, places = index.grams()
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    done: dict[tuple[int, int], int] = {}
    n, total = len(ids), len(known)
    inside = np.minimum(at, total - 1)
    for j in np.flatnonzero((grams > 0) & (known[inside] == grams)).tolist():
        k = int(at[j])
        while k < total and known[k] == grams[j]:
            text, i = int(of_text[k]), int(places[k])
            k += 1
            if done.get((text, j - i), -1) >= j:
                continue
            item = index.texts[text].tolist()
            run = 0
            while i + run < len(item) and j + run < n and item[i + run] == ids[j + run]:
                run += 1
            done[text, j - i] = j + run - GRAM  # seeds within the run lead to the same alignment
            if run < LEAST_RUN or any(a <= j < b for a, b in found[text]):
                continue
            span = _verified(item, ids, i, j)
            if span:
                found[text].append(span)
    return {t: s for t, s in found.items() if s}


def _scan(index: EvalIndex, texts: list[str | None], ids_of: _Ids) -> Iterator[tuple[int, str, dict[int, list[tuple[int, int]]]]]:
    """(row, text, spans as characters by text number) of the rows that leak; a batch's sequences are looked up together."""
    known, _, _ = index.grams()
    every = [[ids_of[w] for w in _WORD.findall(_plain(t))] if t else [] for t in texts]
    # A word unknown to the index keeps the documents apart.
    together: list[int] = []
    for ids in every:
        together += ids
        together.append(0)
    flat = np.array(together, np.int32)
    grams = _gram_numbers(flat)
    if not len(known) or not len(grams):
        return
    at = np.zeros(len(grams), np.int64)
    asked = grams > 0
    at[asked] = np.searchsorted(known, grams[asked], "left")
    hit = np.zeros(len(grams), bool)
    hit[asked] = known[np.minimum(at[asked], len(known) - 1)] == grams[asked]
    starts = np.cumsum([0, *(len(ids) + 1 for ids in every)])
    for row in np.unique(np.searchsorted(starts, np.flatnonzero(hit), "right") - 1).tolist():
        a, b = int(starts[row]), int(min(starts[row + 1], len(grams)))
        hits = _leaks(index, every[row], grams[a:b], at[a:b])
        if hits:
            place = [(m.start(), m.end()) for m in _WORD.finditer(_plain(texts[row]))]
            yield row, texts[row], {t: [(place[x][0], place[y - 1][1]) for x, y in spans] for t, spans in hits.items()}


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, spans): each document and item it leaks, with the spans as character offsets.

    A leak is a stretch of consecutive item words with at most one in ten replaced, dropped or added, of which the document
    holds 20 or more as they are.  NULL and empty texts and items under 20 words leak nothing;
    texts of any length are read whole; documents that repeat appear once per row.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, item_id long, spans array<struct<begin: int, until: int>>"
    parts = []
    for block in eval_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            ids_of = _Ids(index.vocabulary)
            types = pa.struct([("begin", pa.int32()), ("until", pa.int32())])
            for batch in batches:
                rows, ids, spans = [], [], []
                for row, _, hits in _scan(index, batch.column(1).to_pylist(), ids_of):
                    by_item: dict[int, set[tuple[int, int]]] = defaultdict(set)
                    for number, found in hits.items():
                        for item in index.items[number]:
                            by_item[item] |= set(found)
                    for item, found in sorted(by_item.items()):
                        rows.append(row)
                        ids.append(item)
                        spans.append([{"begin": a, "until": b} for a, b in sorted(found)])
                if rows:
                    yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(ids, pa.int64()), pa.array(spans, pa.list_(types))], names=[doc_id,
                        "item_id", "spans"])

        parts.append(spread(documents.select(doc_id, text)).mapInArrow(scan, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # The blocks of a large set may hold the same item's two texts.
    return whole if len(parts) == 1 else whole.groupBy(doc_id, "item_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def clean(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all their columns and rows, with leaking spans cut out of ``text``.

    The spans are cut where they are found, in one scan of the documents and without a shuffle; further blocks of a
    large evaluation set follow in the same scan.
    """
    at = documents.columns.index(text)
    out = spread(documents)
    for block in eval_blocks(items):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def cut(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids_of = _Ids(shared.value.vocabulary)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                for row, whole, hits in _scan(shared.value, list(texts), ids_of):
                    texts[row] = _without(whole, [s for found in hits.values() for s in found])
                columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.record_batch(columns, names=batch.schema.names)

        out = out.mapInArrow(cut, documents.schema)
    return out


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text", drop: bool = False) -> DataFrame:
    """The documents with leaking spans cut out, or (``drop``) without the leaking documents."""
    if drop:
        return documents.join(leaks.select(doc_id), doc_id, "left_anti")
    spans = leaks.select(doc_id, F.explode("spans").alias("s")).groupBy(doc_id).agg(F.array_sort(F.collect_set("s")).alias("__spans"))
    keep = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.when(s["begin"] > acc["at"], F.substring(F.col(text), acc["at"] + 1, s["begin"] - acc["at"])).otherwise("")).alias("out"),
            F.greatest(acc["at"], s["until"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    joined = documents.join(spans, doc_id, "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(keep)).drop("__spans")
