"""Toxicity by logistic regression, learnt with FTRL-proximal.

Features are hashed word n-grams (one and two words), skip-grams (two words around one)
and beginnings of words by how often they occur (at least one to four times), each once a
text. Learning keeps two numbers a feature:
per-coordinate rates, and an L1 penalty that leaves most weights at zero. The few others
are broadcast for scoring; their number is bounded by the size of the hash space.

Learning runs in rounds. In each, every share of the training rows continues from the
common state in a task of its own, and the states are averaged. The state is a stored
table of blocks of features, which Spark moves to the shares and averages block by block.

Training rows are at most about ``max_rows`` labelled documents, chosen by a hash of
their id; more labels than that do not change weights much. Everything else, scoring
included, reads every row and whole texts.

Defined results: null and empty texts are scored by the bias alone; repeated rows get
equal scores; an id labelled twice counts as toxic if one label says so; labels of
unknown documents are ignored; without any training row the score is 0.5; columns other
than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import release, stored, table

BITS = 20
#: Features of a block of the state; it is kept in a row for each block.
BLOCK = 1 << 16
#: ``z`` and ``n`` of a block as float64, and both as the float32 that learning starts from.
STATE = "block int, z binary, n binary, rounded binary"
SHARES, ROUNDS, PASSES = 4, 3, 2
MAX_ROWS = 16_000
THRESHOLD = 0.3
BEGINNINGS = (3, 4, 5, 6, 7)
TIMES = 4
#: ASCII bytes that are no letters or digits separate words.
SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass(frozen=True)
class Rates:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0


class Words(dict):
    """Rows of a table with the hashes of words and their beginnings, for a bounded number of words."""

    most = 300_000

    def __init__(self) -> None:
        self.table = np.zeros((self.most, 1 + len(BEGINNINGS)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        text, row = word.decode(), len(self)
        self.table[row, 0] = xxhash.xxh64_intdigest(word)
        for k, length in enumerate(BEGINNINGS, 1):
            self.table[row, k] = xxhash.xxh64_intdigest(text[:length].encode(), seed=length) if len(text) > length else 0
        self[word] = row
        return row

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """A row of hashes for each word."""
        parts = []
        for start in range(0, len(words), 50_000):
            part = words[start : start + 50_000]
            if len(self) + len(part) > self.most:
                self.clear()
            parts.append(self.table[np.fromiter(map(self.__getitem__, part), np.int64, len(part))])
        return np.concatenate(parts)


def features(text: str | None, words: Words, bits: int = BITS) -> np.ndarray:
    """The distinct feature numbers of a text; feature 0 is the bias."""
    found = (text or "").lower().encode().translate(SEPARATORS).split()
    if not found:
        return np.zeros(1, np.int32)
    hashes = words.hashes(found)
    one = hashes[:, 0]
    starts, times = np.unique(hashes[:, 1:], return_counts=True)
    times[starts == 0] = 0
    grams = [one, one[:-1] * ODD[1] + one[1:], one[:-2] * ODD[2] + one[2:]]
    grams += [starts[times >= k] + np.uint64(k) for k in range(1, TIMES + 1)]
    numbers = np.unique((np.concatenate(grams) * ODD[0] >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate([np.zeros(1, np.int32), numbers[numbers > 0]])


def ftrl(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray, rates: Rates, passes: int) -> None:
    """Update the state ``z``, ``n`` in place by ``passes`` over ``rows``."""
    for _ in range(passes):
        for at, label in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = weights(zi, root, rates)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            square = gradient * gradient
            z[at] = zi + gradient - (np.sqrt(ni + square) - root) / rates.alpha * w
            n[at] = ni + square


def weights(z: np.ndarray, root: np.ndarray, rates: Rates) -> np.ndarray:
    """The proximal step: zero where the L1 penalty outweighs ``z``."""
    return np.where(
        np.abs(z) <= rates.l1,
        0.0,
        -(z - np.sign(z) * rates.l1) / ((rates.beta + root) / rates.alpha + rates.l2),
    )


def held_out(id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``(share, order, text, toxic)`` of the chosen labelled documents."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64(F.lit("train"), "doc_id")
    part = min(1.0, max_rows / max(1, known.count()))
    if part < 1:
        known = known.where(draw < int((part * 2 - 1) * 2**63))
    # at most about max_rows rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        F.pmod(draw, F.lit(SHARES)).cast("int").alias("share"), draw.alias("order"), "text", "toxic"
    )


def rounded(blocks: pd.DataFrame) -> np.ndarray:
    """``z`` and ``n`` of all features from blocks of the state; zero where there is no block."""
    state = np.zeros((2, 1 << BITS), np.float32)
    for block, held in zip(blocks["block"], blocks["rounded"]):
        state[:, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(held, np.float32).reshape(2, BLOCK)
    return state


def added(group: pd.DataFrame, before: np.ndarray, rates: Rates) -> Iterator[tuple]:
    """What a share's rows add to the state: ``(block, at, z, n)`` of the features they hold."""
    words = Words()
    group = group.sort_values(["order", "text", "toxic"])
    own = [(features(t, words), int(y)) for t, y in zip(group["text"], group["toxic"])]
    zs, ns = (x.astype(np.float64) for x in before)
    ftrl(own, zs, ns, rates, PASSES)
    at = np.flatnonzero(ns != before[1])
    parts = [(at % BLOCK).astype(np.int32), *((x[at] - y[at]).astype(np.float32) for x, y in zip((zs, ns), before))]
    cuts = np.searchsorted(at, np.arange(BLOCK, 1 << BITS, BLOCK))
    for block, part in enumerate(zip(*(np.split(x, cuts) for x in parts))):
        if len(part[0]):
            yield block, *(x.tobytes() for x in part)


def merged(parts: pd.DataFrame, before: pd.DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's ``z`` and ``n`` after a round: the mean over ``count`` shares added to what was."""
    z, n = (np.frombuffer(before[x].iloc[0]).copy() if len(before) else np.zeros(BLOCK) for x in ("z", "n"))
    for p in parts.sort_values("share").to_dict("records"):
        at = np.frombuffer(p["at"], np.int32)
        z[at] += np.frombuffer(p["z"], np.float32) / count
        n[at] += np.frombuffer(p["n"], np.float32) / count
    return z, n


def learn(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), max_rows: int = MAX_ROWS) -> dict[int, float]:
    """The weights that are not zero, by feature number."""

    def share(key: tuple, group: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = added(group, rounded(blocks), rates) if len(group) else ()
        return pd.DataFrame([(key[0], *x) for x in found], columns=["share", "block", "at", "z", "n"])

    def merge(key: tuple, parts: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        z, n = merged(parts, before, count)
        both = np.concatenate([z, n]).astype(np.float32)
        return pd.DataFrame({"block": key, "z": [z.tobytes()], "n": [n.tobytes()], "rounded": [both.tobytes()]})

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, z, n in zip(batch["block"], batch["z"], batch["n"]):
                w = weights(np.frombuffer(z), np.sqrt(np.frombuffer(n)), rates)
                at = np.flatnonzero(w)
                yield pd.DataFrame({"at": [(at + block * BLOCK).astype(np.int32).tobytes()], "w": [w[at].tobytes()]})

    rows = stored(training_rows(docs, labels, max_rows))
    count = rows.select("share").distinct().count()
    state = docs.sparkSession.createDataFrame([], STATE)
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    for _ in range(ROUNDS if count else 0):
        copies = state.select(shares, "block", "rounded")
        parts = rows.groupBy("share").cogroup(copies.groupBy("share")).applyInPandas(
            share, "share int, block int, at binary, z binary, n binary"
        )
        # one row a block; neither the state nor what is added to it reaches the driver
        before, state = state, stored(
            parts.groupBy("block").cogroup(state.select("block", "z", "n").groupBy("block")).applyInPandas(merge, STATE)
        )
        release(before)
    release(rows)
    model = {}
    for r in state.select("block", "z", "n").mapInPandas(chosen, "at binary, w binary").toLocalIterator():
        model.update(zip(np.frombuffer(r["at"], np.int32).tolist(), np.frombuffer(r["w"]).tolist()))
    release(state)
    return model


def scored(batches: Iterator[pa.Array], w: np.ndarray) -> Iterator[pa.Array]:
    """The scores of batches of texts. A worker holds one batch, and one text of it as a string."""
    words = Words()
    for texts in batches:
        found = [1 / (1 + np.exp(-np.clip(w[features(t.as_py(), words)].sum(), -30, 30))) for t in texts]
        del texts  # before the next batch is read
        yield pa.array(found, pa.float64())


def score(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    """``docs`` with a column ``score`` between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (np.array(list(model), np.int64), np.array(list(model.values()), np.float64))
    )

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = np.zeros(1 << BITS)
        w[shared.value[0]] = shared.value[1]
        yield from scored(batches, w)

    return docs.withColumn("score", scores(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; labels come as ``(doc_id, toxic)``."""
    model = learn(docs, labels, max_rows=max_rows)
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
