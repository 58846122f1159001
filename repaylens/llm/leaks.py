"""Benchmark decontamination: pieces of test items found exactly, then edit distance.

An item of n characters may occur with up to ``k = rate * n`` edits, so items of under
``1 / rate`` characters only as they are; an item of ``LONG_WORDS`` or more words also with
any one word replaced by any other. A place begins and ends at word boundaries. An item is
cut into k + 1 pieces or, for a replaced word, more until no word touches all of them: k
edits or a replaced word leave at least one piece whole, so the exact places of pieces
(one automaton for all of them) are all the candidates there are. Around each place Myers'
bit-parallel search finds the least distance of the item to any part of the document;
where that is small enough, the search is repeated from each word that may begin the place.
``allowed`` is k, or the distance where a replaced word takes more.

Texts are compared as words: lower case, with everything that is no letter or digit
(ASCII) as one space.

Items come in blocks of bounded size, one scan of the documents for each block; a block
is the only thing that is broadcast.

Defined results: null and blank texts hold no item; null and blank items, and those of
one or two characters, are in no document; repeated documents and items give rows of their
own; an item found at several places has its best place, the first of equal ones; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import table
from repaylens.llm.toxicity import SEPARATORS

RATE = 0.05
#: Characters of items in one block, more or less.
BLOCK_CHARS = 2_000_000
LEAST_CHARS = 1
#: Words of an item from which one may be replaced.
LONG_WORDS = 10


def normal(text: str | None) -> str:
    """Words in lower case with single spaces."""
    return b" ".join((text or "").lower().encode().translate(SEPARATORS).split()).decode()


def errors(length: int, rate: float = RATE) -> int:
    return min(length - 1, int(rate * length))


def is_long(item: str) -> bool:
    return item.count(" ") + 1 >= LONG_WORDS


def cuts(item: str, rate: float = RATE) -> int:
    """The least number of pieces of which edits, or a replaced word of a long item, leave one whole."""
    count = errors(len(item), rate) + 1
    if is_long(item):
        spans = [(m.start(), m.end()) for m in re.finditer("[^ ]+", item)]
        # a word touches all pieces if it begins in the first and ends in the last
        while any(a < len(item) // count and b > len(item) * (count - 1) // count for a, b in spans):
            count += 1
    return count


def pieces(item: str, count: int) -> list[tuple[int, str]]:
    """``count`` pieces of near equal length with their places."""
    ends = [len(item) * k // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def myers(item: str, text: str, whole: bool = False) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where that part ends.

    ``whole``: to parts that begin where ``text`` does and end with a word.
    """
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | whole) & full  # zeros come in if the part may start anywhere
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best and (not whole or j == len(text) or text[j] == " "):
            best, end = score, j
    return best, end


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def placed(item: str, text: str, starts: list[int], most: int) -> list[tuple[int, int]]:
    """(distance, end) of places of whole words that begin within ``most`` of ``starts``, up to the first exact one."""
    out = []
    for at in sorted({i for s in starts for i in range(max(0, s - most), min(len(text), s + most + 1))}):
        if at == 0 or text[at - 1] == " ":
            # one character more tells whether a word ends
            distance, end = myers(item, text[at:at + len(item) + most + 1], whole=True)
            if distance <= most:
                out.append((distance, at + end))
                if distance == 0:
                    break
    return out


class Words:
    """The words of a text and where they begin and end."""

    def __init__(self, text: str):
        self.words = text.split(" ")
        ends = list(accumulate((len(w) + 1 for w in self.words), initial=-1))
        self.ends = ends[1:]
        self.first = {end + 1: k for k, end in enumerate(ends[:-1])}
        self.last = {end: k for k, end in enumerate(self.ends)}

    def one_replaced(self, item: str, start: int) -> list[tuple[int, int]]:
        """(distance, end) of places from ``start`` or up to where the item would end, with at most one other word."""
        own, out = item.split(" "), []
        for k in {self.first.get(start, -1), self.last.get(start + len(item), -1) - len(own) + 1}:
            part = self.words[k:k + len(own)] if k >= 0 else []
            if len(part) == len(own):
                other = [(x, y) for x, y in zip(own, part) if x != y]
                if len(other) < 2:
                    out.append((sum(edits(x, y) for x, y in other), self.ends[k + len(own) - 1]))
        return out


def automaton(items: list[tuple[int, str]], rate: float) -> ahocorasick.Automaton:
    """Finds pieces; a piece's value lists (item number, place in the item)."""
    held: dict[str, list[tuple[int, int]]] = {}
    for number, (_, item) in enumerate(items):
        for at, piece in pieces(item, cuts(item, rate)):
            held.setdefault(piece, []).append((number, at))
    out = ahocorasick.Automaton()
    for piece, where in held.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out


def hits(text: str, items: list[tuple[int, str]], finder: ahocorasick.Automaton, rate: float) -> dict[int, tuple[int, int, int]]:
    """Items found in a text: item number to (distance, end, errors allowed)."""
    windows: dict[int, set[int]] = {}
    for end, (length, where) in finder.iter(text):
        for number, at in where:
            windows.setdefault(number, set()).add(end + 1 - length - at)
    out = {}
    words = None
    for number, starts in windows.items():
        item = items[number][1]
        most = errors(len(item), rate)
        spans: list[tuple[int, int, list[int]]] = []
        for s in sorted(starts):
            low, high = max(0, s - most), min(len(text), s + len(item) + most)
            if spans and low <= spans[-1][1]:
                first, last, held = spans.pop()
                held.append(s)
                spans.append((first, max(last, high), held))
            else:
                spans.append((low, high, [s]))
        near = [s for low, high, held in spans if most == 0 or myers(item, text[low:high])[0] <= most for s in held]
        found = placed(item, text, near, most)
        if is_long(item):
            words = words or Words(text)
            found += [x for s in starts for x in words.one_replaced(item, s)]
        if found:
            distance, end = min(found)
            out[number] = (distance, end, max(most, distance))
    return out


def _search(shared, rate: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        finder = automaton(items, rate)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                for number, (distance, end, most) in hits(normal(text), items, finder, rate).items():
                    rows.append((doc, items[number][0], distance, most, end))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "allowed", "end"])

    return run


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters, dealt out by hash."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / block_chars))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for block in range(count):
        found = [(None if r["item_id"] is None else str(r["item_id"]), normal(r["text"])) for r in dealt.where(F.col("block") == block).collect()]
        yield sorted((x for x in found if len(x[1]) >= LEAST_CHARS), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, allowed, end)`` for every document and item that it holds.

    ``end`` is where the best place ends in the normalised text.
    """
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    # ids travel as text: pandas would turn a column of longs with nulls into doubles
    schema = "doc_id string, item_id string, distance int, allowed int, end long"
    out = spark.createDataFrame([], schema)
    texts = docs.select(F.col("doc_id").cast("string"), "text")
    for items in item_blocks(benchmark, block_chars):
        if items:
            shared = spark.sparkContext.broadcast(items)
            out = out.unionByName(texts.mapInPandas(_search(shared, rate), schema))
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in zip(("doc_id", "item_id"), kinds)})


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
