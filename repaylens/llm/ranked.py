"""Ranked lexical search: dense blocks of documents times dense tiles of items.

Two scans of the texts. The first counts documents, words and, for the terms of the items
only, the documents that hold each; the second scores. Items are cut into tiles of some
hundred, and the terms of a tile, renumbered compactly, into strips. For a block of
documents and a strip, impacts (a matrix of documents by terms) are multiplied with
weights times repeats (items by terms) by BLAS in float64. All entries are integers, and
the weights of a strip are dealt out over layers whose rows stay so small that no partial
sum reaches 2^53: each product is exact, and layers and strips are added as 64-bit integers.

Of each block only documents that reach an item's k-th best score so far stay; equal
scores stay too, so ties are decided by doc_id and not by blocks. Tasks return k rows an
item at most, and a window over those gives the ranks.

Items travel in blocks of ``BLOCK_BYTES`` of text, each broadcast; more items mean more
scans, whose cost is small beside the products. A single item is held whole.

Defined results: null texts, of documents or items, have no terms; documents without any
count nowhere; null doc_ids come after all others of equal score; repeated documents are
ranked each for itself, items that repeat id and text once; items that share an id but not
the text are ranked apart; without a document, or an item, there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repaylens.llm.common import table

BLOCK_BYTES = 2_000_000
#: Documents of a block, items of a tile, terms of a strip.
DOCS, ITEMS, TERMS = 1024, 256, 2048
#: Text that is split into words at once.
PIECE = 1 << 20
#: No impact is larger; weights of a layer's row add up to LAYER at most.
IMPACT = 10**6
LAYER = (2**53 - 1) // IMPACT
# Terms are runs of ASCII letters and digits and of all other characters from U+0080 on.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Rows of the first scan that are no terms.
ALL_DOCS, ALL_WORDS = -1, -2


def words(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data = (text or "").encode().translate(LETTERS)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + PIECE) if len(data) - start > PIECE else -1
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def postings(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """Words of each text, and ``(text, term, times)`` for the terms in the vocabulary."""
    sizes, at, terms = [], [], []
    for k, text in enumerate(texts):
        size = 0
        for part in words(text):
            size += len(part)
            found = np.array([v for v in map(vocabulary.get, part) if v is not None], np.int64)
            at.append(np.full(len(found), k, np.int64))
            terms.append(found)
        sizes.append(size)
    width = len(vocabulary) + 1
    none = np.zeros(0, np.int64)
    pairs, times = np.unique(np.concatenate([none, *at]) * width + np.concatenate([none, *terms]), return_counts=True)
    return np.array(sizes, np.int64), pairs // width, pairs % width, times.astype(np.int64)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each term, and under ALL_DOCS and ALL_WORDS what all documents have."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, all_docs, all_words = np.zeros(len(sent.value), np.int64), 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                sizes, _, terms, _ = postings(batch["text"][start : start + DOCS].to_pylist(), sent.value)
                df += np.bincount(terms, minlength=len(df))
                all_docs += int(np.count_nonzero(sizes))
                all_words += int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.record_batch(
            {"term": pa.array([ALL_DOCS, ALL_WORDS, *held], pa.int32()), "n": pa.array([all_docs, all_words, *df[held]], pa.int64())}
        )

    rows = docs.select("text").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.collect()}  # at most two more than the terms of a block of items


@dataclass
class Query:
    """Weights of the terms of a block of items, sparse and in order of the items."""

    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray  # times the repeats of the term in the item
    vocabulary: dict[bytes, int]
    docs: int
    words: int
    items: int

    def tiles(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """``(first item, end, strips)``: a strip has the numbers of its terms."""
        for start in range(0, self.items, ITEMS):
            stop = min(start + ITEMS, self.items)
            own = np.unique(self.term[(self.item >= start) & (self.item < stop)])
            yield start, stop, [own[a : a + TERMS] for a in range(0, len(own), TERMS)]

    def layers(self, start: int, stop: int, strip: np.ndarray) -> Iterator[np.ndarray]:
        """Matrices of items by terms that add up to the weights, none with a row sum over LAYER."""
        here = (self.item >= start) & (self.item < stop) & np.isin(self.term, strip)
        whole = np.zeros((stop - start, len(strip)), np.int64)
        whole[self.item[here] - start, np.searchsorted(strip, self.term[here])] = self.weight[here]
        ends = np.cumsum(whole, axis=1)
        for low in range(0, int(ends[:, -1].max(initial=0)), LAYER):
            yield (np.clip(ends, low, low + LAYER) - np.clip(ends - whole, low, low + LAYER)).astype(np.float64)


class Best:
    """The best k documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))  # item, score, no id, id

    def add(self, first: int, scores: np.ndarray, no_id: np.ndarray, id: np.ndarray) -> None:
        """``scores`` of items from ``first`` on, by documents."""
        item, doc = np.nonzero(scores >= self.least[first : first + len(scores), None])
        if not len(item):
            return
        new = (item + first, scores[item, doc], no_id[doc], id[doc])
        rows = [np.concatenate(x) for x in zip(self.rows, new)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        item = rows[0][order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        self.rows = tuple(x[order] for x in rows)
        item, full = item[place < self.k], place[place < self.k] == self.k - 1
        self.least[item[full]] = self.rows[1][full]


def score_block(texts: list[str | None], query: Query) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first item, scores by items and documents, the documents' places)`` for each tile."""
    sizes, doc, term, times = postings(texts, query.vocabulary)
    lengths = np.array([25 + 75 * n * query.docs // max(1, query.words) for n in sizes.tolist()], np.int64)
    impact = 1_000_000_000 * times // (1000 * times + 8 * lengths[doc])
    for start, stop, strips in query.tiles():
        scores = np.zeros((stop - start, len(texts)), np.int64)
        for strip in strips:
            at = np.minimum(np.searchsorted(strip, term), len(strip) - 1)
            held = strip[at] == term
            docs, row = np.unique(doc[held], return_inverse=True)
            block = np.zeros((len(docs), len(strip)))
            block[row, at[held]] = impact[held]
            for layer in query.layers(start, stop, strip):
                scores[:, docs] += (layer @ block.T).astype(np.int64)
        yield start, scores


def read_items(items: DataFrame, block: int, blocks: int) -> tuple[list, list[list[bytes]]]:
    """Ids and terms of the items of a block; those without terms are left out."""
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    rows = items.where(number == block).orderBy("item_id", "text").collect()  # about BLOCK_BYTES of text
    terms = [[w for part in words(r["text"]) for w in part] for r in rows]
    kept = [k for k, t in enumerate(terms) if t]
    return [rows[k]["item_id"] for k in kept], [terms[k] for k in kept]


def build_query(docs: DataFrame, terms: list[list[bytes]]) -> Query:
    """Counts the terms over all documents and weighs them."""
    vocabulary = {w: k for k, w in enumerate(sorted({w for t in terms for w in t}))}
    counts = count_terms(docs, vocabulary)
    n = counts.get(ALL_DOCS, 0)
    weight = {k: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for k, df in counts.items() if k >= 0}
    item, term, weights = [], [], []
    for k, own in enumerate(terms):
        numbers, repeats = np.unique([vocabulary[w] for w in own], return_counts=True)
        for number, times in zip(numbers.tolist(), repeats.tolist()):
            if weight.get(number):
                item.append(k)
                term.append(number)
                weights.append(weight[number] * times)
    arrays = (np.array(x, np.int64) for x in (item, term, weights))
    return Query(*arrays, vocabulary, n, counts.get(ALL_WORDS, 0), len(terms))


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best ``k`` of ``docs(doc_id, text)`` for each of ``items(item_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    blocks = math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes)
    out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for block in range(blocks):
        ids, terms = read_items(items, block, blocks)
        if ids:
            names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {out.schema['item_id'].dataType.simpleString()}")
            out = out.unionByName(best_of(docs, build_query(docs, terms), k).join(F.broadcast(names), "item").drop("item"))
    return out


def best_of(docs: DataFrame, query: Query, k: int) -> DataFrame:
    """``(item, rank, doc_id, score)`` for a block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(query)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value.items, k)
        for batch in batches:
            ids = batch["doc_id"]
            no_id, id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for start in range(0, batch.num_rows, DOCS):
                part = slice(start, start + DOCS)
                for first, scores in score_block(batch["text"][part].to_pylist(), sent.value):
                    best.add(first, scores, no_id[part], id[part])
        item, score, no_id, id = best.rows
        yield pa.record_batch(
            {"item": pa.array(item.astype(np.int32)), "doc_id": pa.array(id, mask=no_id), "score": pa.array(score)}
        )

    rows = docs.mapInArrow(scored, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


#: A run of letters and digits, as above.
_TERMS = (
    r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
)
OP13_SQL = f"""
WITH items AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
asked AS (SELECT q, item_id, w, count(*) AS times FROM (SELECT q, item_id, {_TERMS} AS w FROM items) GROUP BY ALL),
found AS (SELECT r, doc_id, w, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS w FROM docs) GROUP BY ALL),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM found GROUP BY r),
total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_words FROM sizes),
weights AS (
  SELECT w, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM found, total WHERE w IN (SELECT w FROM asked) GROUP BY w
),
scores AS (
  SELECT q, item_id, r, doc_id,
    sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_words))))::BIGINT AS score
  FROM asked JOIN weights USING (w) JOIN found USING (w) JOIN sizes USING (r), total
  GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
