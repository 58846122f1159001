"""From raw documents to token ids: five stages, each over what the one before has kept.

1. toxicity: documents that the classifier predicts to be toxic go
2. line_dedup: aligned blocks that an earlier document holds are deleted; a document goes
   if nothing is left of it
3. near_duplicates: of each group that shingles of five words link at 0.8, one row stays,
   that of the smallest id
4. decontamination: documents that hold a benchmark item go
5. tokens: ids of every text, and the digest of what they decode to

Null texts are clean, hold no lines and no item, link with nothing and have no tokens.
Stages 3 and 4 decide by text, not by id: rows of one id and different texts are different
documents. Null ids come after all others. Of rows that repeat id and text one stays, unless
the text is null or without words: such rows link with nothing, so all of them stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.bpe import decode_ids, encode, vocabulary
from repaylens.llm.common import release, stored, table
from repaylens.llm.jaccard import Rule, near_groups
from repaylens.llm.leaks import find_leaks
from repaylens.llm.lines import dedup_lines
from repaylens.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return toxicity(docs, labels).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs).where("blocks = 0 OR trim(kept_text) <> ''")
    return left.select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.when(F.col("blocks") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``, which tells texts apart; null for null texts."""
    return docs.select(*COLUMNS, F.md5(F.encode("text", "UTF-8")).alias("__key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = with_key(docs)
    found = near_groups(docs.select("__key", "text"), Rule(words=5, percent=80), id="__key")
    groups = stored(found.where("n_shingles > 0").select("__key", F.col("component_id").alias("__group")).distinct())
    counted = docs.where("text IS NOT NULL").groupBy("doc_id", "__key").agg(F.count("*").alias("__rows"))
    rows = stored(counted.join(groups, "__key"))
    release(groups)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    first = stored(rows.groupBy("__group").agg(F.min(place).alias("__first")))
    marked = rows.join(first, "__group").withColumn("__stays", place.eqNullSafe(F.col("__first")))
    marked = stored(marked.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__of"), "__stays", "__rows"))
    release(rows, first)
    same = F.expr("__key = __of AND doc_id <=> __id")
    left = docs.join(marked.where("NOT __stays OR __rows > 1"), same, "left_anti")
    # of rows that repeat id and text one comes back
    again = docs.join(marked.where("__stays AND __rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "__key"])
    return left.unionByName(again).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = with_key(docs)
    texts = docs.select(F.col("__key").alias("doc_id"), "text")
    leaks = find_leaks(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__key")).distinct()
    return docs.join(stored(leaks), "__key", "left_anti").select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # stored in between, so that no task holds both ends' tokenizers and texts
    ids = stored(encode(docs.select("doc_id", "text"), vocabulary()).select("doc_id", "ids"))
    return decode_ids(ids, vocabulary()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]
#: Learnt weights, alignment and tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            release(before)
    return docs
