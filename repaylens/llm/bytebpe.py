"""Byte-level BPE encoding and decoding with a queue of ranks under a hierarchical bitmap.

Texts are split by the pattern of the rank file; each match is encoded separately. The
pairs of neighbours in a match wait in a bucket for each merge rank, as positions of a
linked list. Words of 256 bits say which buckets hold any, and a word above them says which
words do; finding the first bit set on both levels gives the next rank. Of a rank, the leftmost position comes first,
as the tiktoken library merges. An entry whose pair has changed since is stale and skipped
when its turn comes. So a match of n bytes costs n log n at most, whatever its length.
A match that is itself a token needs no merge, also as in that library.

Matches up to ``KEEP_CHARS`` characters are remembered, those not met for longest going
when there are too many; that saves work and changes no result. Nothing is shuffled.

Defined results: null text is empty and has no ids; strings of special tokens are ordinary
text; repeated rows give equal rows; other columns are kept, except ids and decoded; an
empty table gives no rows. A text is held whole by the task that encodes it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import table

#: Matches that a task remembers twice over, and the longest of them.
KEEP, KEEP_CHARS = 250_000, 48
BIT = [1 << k for k in range(256)]


class Ranks:
    """A rank file: ids of byte strings and back."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.words = [0] * (max(self.tokens) // 256 + 1)  # all 0 again after each match

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        rank_of, longest, words, n = self.ids.get, self.longest, self.words, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wanted = [-1] * n  # rank of the pair that starts here
        buckets: dict[int, list[int]] = {}
        top = 0  # a bit for each of the words that has any
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                wanted[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions rise, so this is a heap
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= BIT[rank & 255]
                    top |= 1 << (rank >> 8)
        while top:
            block = (top & -top).bit_length() - 1
            word = words[block]
            rank = block << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[block] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if wanted[i] != rank:
                continue  # stale
            gone = after[i]
            stop = after[i] = after[gone]
            wanted[gone] = -1
            new = []
            if stop < n:
                before[stop] = i
                new.append((i, after[stop]))
            else:
                wanted[i] = -1
            if i:
                new.append((before[i], stop))
            for start, end in new:
                found = rank_of(piece[start:end]) if end - start <= longest else None
                if found is None:
                    wanted[start] = -1
                    continue
                wanted[start] = found
                if found in buckets:
                    heappush(buckets[found], start)
                else:
                    buckets[found] = [start]
                    words[found >> 8] |= BIT[found & 255]
                    top |= 1 << (found >> 8)
        out, i = [], 0
        while i < n:
            out.append(self.ids[piece[i : after[i]]])
            i = after[i]
        return out


class Encoder(dict):
    """Ids of matches as little-endian numbers of 32 bits, remembered while there is room."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.pattern = regex.compile(pattern)
        self.older: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        out = self.older.get(match)
        if out is None:
            out = np.array(self.ranks.merge(match.encode()), "<i4").tobytes()
        if len(match) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.older = dict(self)
                self.clear()
            self[match] = out
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text or "")))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _lists(parts: list[bytes]) -> pa.Array:
    """Arrow lists of the 32-bit numbers in ``parts``."""
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(docs: DataFrame, ranks: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` and, if asked, ``decoded``, the bytes that the ids stand for.

    ``ranks`` is the path of a rank file that every executor has.
    """

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(ranks, pattern)
        for part in texts:
            ids = [own.encode(text.as_py()) for text in part]
            back = [own.decode(np.frombuffer(x, "<i4")) for x in ids] if decoded else [None] * len(ids)
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(back, pa.binary())], ["ids", "decoded"])

    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    out = docs.select(*kept, both(F.col("text")).alias("__bpe"))
    return out.select(*kept, "__bpe.ids", *(["__bpe.decoded"] if decoded else []))


def decode(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``rows`` with ``decoded``, the bytes of their ``ids``; null ids have none."""

    @F.arrow_udf("binary")
    def texts(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(ranks, pattern)
        for part in ids:
            ends, numbers = part.offsets.to_numpy(), part.values.to_numpy()
            yield pa.array([own.decode(numbers[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())

    return rows.drop("decoded").withColumn("decoded", texts(F.col("ids")))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, *vocabulary(), decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
