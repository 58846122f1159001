"""Exact deduplication by polynomial fingerprints that combine from chunks.

The bytes of a text are the digits of a number, taken modulo three primes of 31 bits.
Fingerprints of neighbouring chunks combine without the text,
``H(xy) = H(x) * r^|y| + H(y)``: the chunks of a huge document are hashed in parallel
tasks, and their hashes are shifted by the length of what follows and added up.

Equal fingerprints are only a proposal. Members of such a group are compared with its
first member chunk by chunk; those that differ form a group of their own and are
compared again, until none is left.

Defined results: null text counts as empty, all empty texts are one group; of rows that
repeat both id and text one is kept; a null id sorts first and is compared as such;
columns other than id and text are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import salt, salts, stored, table

#: Largest primes below 2^31: products of two residues fit a long.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
BASES = (1_234_567_891, 987_654_323, 1_618_033_989)
CHUNK_CHARS = 65_536
FP = ["fp_len", "fp0", "fp1", "fp2"]


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space each; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def chunks_of(text: str, chars: int) -> str:
    """SQL for the chunks of a text as an array, cut in one walk through it."""
    return f"regexp_extract_all({text}, '(?s).{{1,{chars}}}', 0)"


def powers(base: int, prime: int, count: int) -> np.ndarray:
    """``base^0 .. base^(count-1)`` modulo ``prime``, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:count]


def hash_chunks(primes: tuple[int, ...], bases: tuple[int, ...], chunk_bytes: int):
    """A function for ``mapInPandas``: texts of chunks to residues and shift factors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        falling = [powers(b, p, chunk_bytes)[::-1].copy() for b, p in zip(bases, primes)]
        for batch in batches:
            data = [np.frombuffer(t.encode(), np.uint8).astype(np.uint64) for t in batch.pop("chunk")]
            sizes = [len(d) for d in data]
            batch["bytes"] = np.array(sizes, np.int64)
            for k, (p, b) in enumerate(zip(primes, bases)):
                tail = falling[k]
                # residues below 2^31 times bytes, at most 2^18 of them, stay below 2^57
                batch[f"h{k}"] = np.array([int(d @ tail[chunk_bytes - n :]) % p for d, n in zip(data, sizes)], np.int64)
                batch[f"shift{k}"] = np.array([pow(b, n, p) for n in sizes], np.int64)
            yield batch

    return run


def fingerprints(
    docs: DataFrame,
    key: str = "row_key",
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    primes: tuple[int, ...] = PRIMES,
) -> DataFrame:
    """``(key, fp_len, fp0, fp1, fp2)`` of every row. ``key`` is any column that tells rows apart.

    A text of one chunk is hashed where it is read. Only the chunks of longer ones are
    dealt out and combined by key.
    """
    parts = docs.select(
        F.col(key).alias("k"),
        F.expr(f"CAST(ceil(length({text}) / {chunk_chars}) AS INT)").alias("parts"),
        F.col(text).alias("t"),
    )
    schema = "k {0}, no int, bytes long, h0 long, h1 long, h2 long, shift0 long, shift1 long, shift2 long".format(
        docs.schema[key].dataType.simpleString()
    )
    hashing = hash_chunks(primes, BASES, chunk_chars * 4)
    single = parts.where("parts <= 1").select("k", F.lit(0).alias("no"), F.col("t").alias("chunk"))
    many = (
        parts.where("parts > 1")
        .select("k", F.posexplode(F.expr(chunks_of("t", chunk_chars))).alias("no", "chunk"))
        .repartition(F.col("k"), F.col("no"))
    )
    shifted = [
        F.expr(
            f"aggregate(c, 0L, (a, x) -> (a * x.shift{i} + x.h{i}) % {p})"
        ).alias(f"fp{i}")
        for i, p in enumerate(primes)
    ]
    whole = single.mapInPandas(hashing, schema).select(
        "k", F.col("bytes").alias("fp_len"), *[F.col(f"h{i}").alias(f"fp{i}") for i in range(3)]
    )
    fields = ["no", "bytes", *[f"{n}{i}" for n in ("h", "shift") for i in range(3)]]
    combined = (
        many.mapInPandas(hashing, schema)
        .groupBy("k")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("c"))
        .select("k", F.expr("aggregate(c, 0L, (a, x) -> a + x.bytes)").alias("fp_len"), *shifted)
    )
    return whole.unionByName(combined).withColumnRenamed("k", key)


def exact_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    primes: tuple[int, ...] = PRIMES,
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Rows are told apart by id and SHA-256 of the normalised text, which the result shows
    anyway; groups come from fingerprints and the comparison of texts.
    """
    rows = docs.select(F.col(id).alias("doc_id"), normalised(F.col(text)).alias("text")).withColumn(
        "sha", F.sha2(F.encode("text", "UTF-8"), 256)
    )
    kind = docs.schema[id].dataType.simpleString()
    # ids travel as text: pandas would turn a column of longs with nulls into doubles
    keyed = rows.withColumn("row_key", F.concat("sha", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    found = fingerprints(keyed, chunk_chars=chunk_chars, primes=primes).select(
        F.expr(f"CAST(nullif(substring(row_key, 65), '') AS {kind})").alias("doc_id"),
        F.substring("row_key", 1, 64).alias("sha"), *FP,
    )
    # Rows that repeat id and text are alike: one row with their number stands for them.
    known = stored(
        found.groupBy("doc_id", "sha", *FP).agg(F.count("*").alias("rows"))
    )
    differing = _differing(rows, known, chunk_chars)
    if differing is None:
        sorted_out = known.withColumn("round", F.lit(0))
    else:
        sorted_out = stored(
            known.join(differing, known.doc_id.eqNullSafe(differing.d_id) & (known.sha == differing.d_sha), "left")
            .withColumn("round", F.coalesce("d_round", F.lit(0)))
            .select("doc_id", "sha", *FP, "rows", "round")
        )
    group = [*FP, "round"]
    sizes = stored(
        sorted_out.groupBy(*group).agg(
            F.min(F.struct("doc_id", "sha")).alias("first"), F.sum("rows").alias("group_size")
        )
    )
    return (
        sorted_out.join(sizes, group)
        .withColumn("copy", F.explode(F.expr("sequence(1, CAST(rows AS INT))")))
        .select(
            F.col("doc_id").alias(id),
            F.col("first.doc_id").alias("keep_id"),
            F.col("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha")) & (F.col("copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def _differing(rows: DataFrame, known: DataFrame, chunk_chars: int) -> DataFrame | None:
    """``(d_id, d_sha, d_round)`` of members that are not their group's first text."""
    sizes = stored(known.groupBy(*FP).agg(F.count("*").alias("n")).where("n > 1"))
    if sizes.isEmpty():
        return None
    members = stored(known.join(sizes, FP).drop("rows"))
    # The small side names the texts wanted; ids and digests are unique in it.
    wanted = members.select(F.col("doc_id").alias("m_id"), F.col("sha").alias("m_sha"), *FP)
    texts = stored(
        rows.join(wanted, rows.doc_id.eqNullSafe(F.col("m_id")) & (rows.sha == F.col("m_sha")))
        .dropDuplicates(["doc_id", "sha"])
        .select("doc_id", "sha", "text", *FP)
    )
    out, left, step = None, members.select("doc_id", "sha", *FP), 0
    while True:
        heads = stored(
            left.groupBy(*FP).agg(F.min(F.struct("doc_id", "sha")).alias("first"), F.count("*").alias("n"))
        )
        unequal = stored(_unequal(texts, left, heads, chunk_chars))
        if unequal.isEmpty():
            return out
        step += 1
        now = unequal.select(F.col("doc_id").alias("d_id"), F.col("sha").alias("d_sha"), F.lit(step).alias("d_round"))
        # who differs again moves on to the next round's group
        out = now if out is None else stored(
            out.alias("o")
            .join(now.alias("w"), F.expr("o.d_id <=> w.d_id AND o.d_sha = w.d_sha"), "left_anti")
            .unionByName(now)
        )
        left = unequal


def _unequal(texts: DataFrame, left: DataFrame, heads: DataFrame, chunk_chars: int) -> DataFrame:
    """Members whose text differs from their group's first, compared chunk by chunk.

    The first member's chunks are repeated once for every few hundred members, so a group
    of any size spreads over tasks.
    """
    # an empty text is one empty chunk
    chunks = F.expr(f"if(text = '', array(''), {chunks_of('text', chunk_chars)})")
    at = left.join(heads, FP)
    mine = texts.drop(*FP).join(
        at.select(F.col("doc_id").alias("m_id"), F.col("sha").alias("m_sha"), *FP, "first", "n"),
        F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("sha") == F.col("m_sha")),
    )
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    heads_chunks = (
        mine.where(is_first)
        .select(*FP, F.col("n"), F.posexplode(chunks).alias("no", "head"))
        .select(*FP, "no", "head", F.explode(salts(F.col("n"))).alias("salt"))
    )
    member_chunks = mine.where(~is_first).select(
        "doc_id", "sha", *FP, salt(F.col("n"), F.col("doc_id"), F.col("sha")).alias("salt"), F.posexplode(chunks).alias("no", "chunk")
    )
    on = [*FP, "salt", "no"]
    return (
        member_chunks.join(heads_chunks, on, "left")
        .select("doc_id", "sha", *FP, F.col("chunk").eqNullSafe(F.col("head")).alias("same"))
        .groupBy("doc_id", "sha", *FP)
        .agg(F.min("same").alias("same"))
        .where("NOT same")
        .drop("same")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents
), g AS (
  SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g
"""
