"""Hard-negative mining by vertical scans that bound what is still to be read.

A task holds rows in blocks, dimension by dimension, with the least and largest value of
each dimension. An anchor reads the dimensions in falling order of its own magnitude. What
the unread ones can still add lies between the sums of their least and largest products,
so every candidate has a lower and an upper bound; a bitmap keeps those that may still
count, and shrinks with every stretch of dimensions until scores are exact.

1. Positives: a candidate goes when k others of the block, or k rows of earlier blocks of
   the task, surely score higher.
2. Negatives: the positives fix score windows. A candidate goes when no window can hold it,
   or when enough others surely lie in each window that may and score higher.

Tasks return k rows an anchor, or a window, at most; Spark windows over those rank them.
Anchors travel in blocks of ``ANCHOR_BYTES``, each broadcast for two scans of all rows; the
scans' cost is small beside the bounds of the block's anchors. All rows are candidates.

Components are integers after quantising. Sums are exact: in float64 where dimensions times
the largest product stay below 2^53, else in 64-bit integers. Components beyond LARGEST
after quantising have no score in 64 bits.

Defined results: rows with a null id, label or vector, or with a null, non-finite or too
large component take no part; nor do anchors without a positive. Shorter vectors count as
filled up with zeros. Rows that repeat id, label and vector count once; rows that share
only the id are different rows, and an anchor's other rows are all but itself. Equal scores
are ordered by id. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repaylens.llm.common import stored, table

#: Anchors that are broadcast at once, in bytes of their components.
ANCHOR_BYTES = 16_000_000
#: Components of a block of rows in a task.
BLOCK_NUMBERS = 1 << 20
#: Dimensions that are read between two looks at the bounds.
STRETCH = 16
LARGEST = 1 << 27


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 3
    #: A negative's score in hundredths of the positive's.
    least: int = 50
    most: int = 95


def exact_type(largest: int, dimensions: int) -> type:
    return np.float64 if largest * largest * max(1, dimensions) < 2**53 else np.int64


class Block:
    """Rows of a task by dimension, in the order of their labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())


class Scan:
    """One anchor's reading of a block: partial sums of the rows whose bit is set."""

    def __init__(self, block: Block, vector: np.ndarray, alive: np.ndarray):
        self.block, self.vector, self.alive = block, vector, alive
        self.order = np.argsort(-np.abs(vector), kind="stable")
        ends = np.sort(np.stack([vector * block.least, vector * block.most])[:, self.order], axis=0)
        # what the dimensions from each place on can add
        self.rest = np.concatenate([ends[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((2, 1), ends.dtype)], axis=1)
        self.read = 0
        self.sums = np.zeros(len(alive), vector.dtype)

    def step(self) -> bool:
        """Read some more dimensions; whether any was left."""
        if self.read == len(self.order) or not len(self.alive):
            return False
        dims = self.order[self.read : self.read + STRETCH]
        part = self.block.columns[dims]
        self.sums += self.vector[dims] @ (part if len(self.alive) == part.shape[1] else part[:, self.alive])
        self.read += len(dims)
        return True

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.rest[:, self.read]
        return self.sums + low, self.sums + high

    def keep(self, bitmap: np.ndarray) -> None:
        if not bitmap.all():
            self.alive, self.sums = self.alive[bitmap], self.sums[bitmap]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, if there are as many."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def best_alike(block: Block, vector: np.ndarray, alive: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best ``k`` rows of ``alive`` that score ``least`` or more."""
    scan = Scan(block, vector, alive)
    while scan.step():
        low, high = scan.bounds()
        scan.keep(high >= max(least, kth(low, k)))
    return first(scan.sums.astype(np.int64), block.ids[scan.alive], k)


def best_in_windows(
    block: Block, vector: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], k: int, least: list[float]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, the best ``k`` rows inside that score ``least`` or more."""
    scan = Scan(block, vector, alive)
    while scan.step():
        low, high = scan.bounds()
        wanted = np.zeros(len(scan.alive), bool)
        for (bottom, top), so_far in zip(windows, least):
            sure = low[(low >= bottom) & (high <= top)]
            wanted |= (low <= top) & (high >= max(bottom, so_far, kth(sure, k)))
        scan.keep(wanted)
    scores, ids = scan.sums.astype(np.int64), block.ids[scan.alive]
    out = []
    for (bottom, top), so_far in zip(windows, least):
        inside = (scores >= max(bottom, so_far)) & (scores <= top)
        out.append(first(scores[inside], ids[inside], k))
    return out


def window_of(score: int, rule: Mining) -> tuple[int, int]:
    """Negative scores that a positive score allows; empty if the first is larger."""
    return -(-rule.least * score // 100), rule.most * score // 100


def prepared(vectors: DataFrame, scale: float, label: Column) -> DataFrame:
    """``(id, label, vector)`` of rows that take part, quantised; ``vectors`` has vec_id, embedding and label."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), "embedding")
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    number = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= LARGEST, F.lit(False)))
    return rows.where(fits).select("id", "label", F.transform("embedding", number).alias("vector")).distinct()


def blocks_of(batches: Iterator[pa.RecordBatch], dimensions: int, kind: type) -> Iterator[Block]:
    """Blocks of some BLOCK_NUMBERS components."""
    held: list[pa.RecordBatch] = []
    size, most = 0, max(1, BLOCK_NUMBERS // max(1, dimensions))
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            held.append(batch.slice(start, most))
            size += held[-1].num_rows
            if size >= most:
                yield _block(held, dimensions, kind)
                held, size = [], 0
    if size:
        yield _block(held, dimensions, kind)


def _block(held: list[pa.RecordBatch], dimensions: int, kind: type) -> Block:
    rows = pa.Table.from_batches(held).combine_chunks()
    return Block(rows["id"].to_numpy(), rows["label"].to_numpy(), dense(rows["vector"], dimensions, kind))


def dense(vectors: pa.ChunkedArray, dimensions: int, kind: type) -> np.ndarray:
    """Rows of numbers, filled up with zeros."""
    lists = vectors.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dimensions), kind)
    out[np.arange(dimensions) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


@dataclass
class Anchors:
    """A block of anchors, and their windows once the positives are known."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: list[list[tuple[int, int]]]
    kind: type


def read_anchors(rows: DataFrame, dimensions: int, kind: type) -> Anchors:
    got = rows.toArrow()  # a block of ANCHOR_BYTES, more or less
    vectors = dense(got["vector"], dimensions, kind)
    return Anchors(got["id"].to_numpy(), got["label"].to_numpy(), vectors, [], kind)


def find_positives(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """``(anchor, rank, positive, score)``: each anchor's best other rows of its label."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(a.ids)
        for block in blocks_of(batches, a.vectors.shape[1], a.kind):
            for n, (id, label, vector) in enumerate(zip(a.ids, a.labels, a.vectors)):
                start, stop = block.of_label(label)
                alive = np.arange(start, stop)
                for own in start + np.flatnonzero(block.ids[start:stop] == id):
                    if np.array_equal(block.columns[:, own], vector):
                        alive = alive[alive != own]
                scores, ids = best[n]
                found = best_alike(block, vector, alive, k, kth(scores, k))
                best[n] = first(np.concatenate([scores, found[0]]), np.concatenate([ids, found[1]]), k)
        yield _rows("anchor", np.repeat(np.arange(len(best)), [len(b[0]) for b in best]), "positive", best)

    return _ranked(rows.mapInArrow(scan, "anchor int, positive long, score long"), "anchor", "positive", k)


def find_negatives(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """``(window, rank, negative, score)``: the best rows of other labels inside each window.

    Windows are numbered through all anchors, in order.
    """
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        none = np.zeros(0, np.int64)
        best = [[(none, none)] * len(w) for w in a.windows]
        for block in blocks_of(batches, a.vectors.shape[1], a.kind):
            for n, (label, vector, windows) in enumerate(zip(a.labels, a.vectors, a.windows)):
                if not windows:
                    continue
                start, stop = block.of_label(label)
                alive = np.concatenate([np.arange(start), np.arange(stop, len(block.ids))])
                found = best_in_windows(block, vector, alive, windows, k, [kth(s, k) for s, _ in best[n]])
                best[n] = [
                    first(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]), k)
                    for old, new in zip(best[n], found)
                ]
        flat = [b for own in best for b in own]
        yield _rows("window", np.repeat(np.arange(len(flat)), [len(b[0]) for b in flat]), "negative", flat)

    return _ranked(rows.mapInArrow(scan, "window int, negative long, score long"), "window", "negative", k)


def _rows(key: str, keys: np.ndarray, name: str, best: list) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    scores, ids = (np.concatenate([none, *(b[i] for b in best)]) for i in (0, 1))
    return pa.record_batch({key: pa.array(keys, pa.int32()), name: pa.array(ids), "score": pa.array(scores)})


def _ranked(rows: DataFrame, key: str, id: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), id)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, rule: Mining = Mining(), scale: float = 256.0, label: Column | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on ``id``; ``label`` replaces the column of that name.
    """
    spark = vectors.sparkSession
    rows = stored(prepared(vectors, scale, F.col("label") if label is None else label))
    size, largest, anchors_in = rows.agg(
        F.max(F.size("vector")),
        F.max(F.greatest(F.lit(0), F.array_max("vector"), -F.array_min("vector"))),
        F.count_if(is_anchor),
    ).first()
    dimensions = size or 0
    kind = exact_type(largest or 0, dimensions)
    blocks = math.ceil(anchors_in * max(1, dimensions) * 8 / ANCHOR_BYTES)
    # bounds cost far more than reading, so rows are dealt out evenly over all cores
    spread = rows.repartition(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], names)
    for block in range(blocks):
        part = F.pmod(F.xxhash64("id", "vector", "label"), F.lit(blocks)) == block
        anchors = read_anchors(rows.where(is_anchor & part).orderBy("id", "label", "vector"), dimensions, kind)
        found = find_positives(spread, anchors, rule.positives).toPandas()  # positives an anchor of the block at most
        found = found.sort_values(["anchor", "rank"])
        found["window"] = np.arange(len(found))
        anchors.windows = [[] for _ in anchors.ids]
        for anchor, score in zip(found["anchor"], found["score"]):
            anchors.windows[anchor].append(window_of(int(score), rule))
        names = spark.createDataFrame(
            [
                (int(w), int(anchors.ids[a]), int(p), int(s))
                for w, a, p, s in zip(found["window"], found["anchor"], found["positive"], found["score"])
            ],
            "window int, anchor_id long, positive_id long, positive_score long",
        )
        negatives = find_negatives(spread, anchors, rule.negatives).withColumnsRenamed(
            {"negative": "negative_id", "score": "negative_score"}
        )
        out = out.unionByName(negatives.join(F.broadcast(names), "window").drop("window"))
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


OP11_SQL = """
WITH given AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id % 50 = 0 AND (a.vec_id <> b.vec_id)
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
),
ranked AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT alike
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
