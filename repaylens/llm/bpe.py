"""BPE encoding and decoding with reuse of chunks.

Texts are cut where a rolling hash of the last 16 bytes says so, so equal passages fall
into equal chunks wherever they stand. Chunks that several places share are encoded once,
in Spark tasks, and their ids are broadcast; the dictionary is bounded in bytes, and the
chunks that save most come first. All other chunks are encoded where they stand, so the
bound decides work and never results. No text is shuffled but the dictionary's.

A cut may split a word. Every chunk knows the ids of its first and last fragment; at a
join the word across it is encoded again, over as many chunks as it takes to reach white
space on both sides, and where that agrees with the fragments' ids nothing changes. White
space is where encodings agree for certain: the tokenizer drops it before merging.

Defined results: null text is empty and has no tokens; special tokens' strings in a text
become those tokens, as the tokenizers library does; repeated rows give equal rows; other
columns are kept, except ids and decoded; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import stored, table

WINDOW_BITS = 9  # a cut every 512 bytes, more or less
LEAST, MOST = 64, 2048
#: Text of chunks in the broadcast dictionary; the ids are smaller.
DICTIONARY_BYTES = 24_000_000
WORDS_KEPT = 500_000
# White space of the tokenizer; str.split() also takes \x1c to \x1f.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_places(data: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8, none inside a character."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):  # sums of 1, 2, 4, 8 and 16 bytes, each shifted by its age
        h[width:] += h[:-width] << np.uint32(width)
    marks = np.flatnonzero((h >> np.uint32(16)) & np.uint32((1 << WINDOW_BITS) - 1) == 0) + 1
    out, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > MOST:
            last = _whole(data, last + MOST)
            out.append(last)
        if mark == n or mark - last >= LEAST:
            last = _whole(data, mark)
            if last > (out[-1] if out else 0):
                out.append(last)
    return out


def _whole(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    ends = cut_places(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def split_words(text: str) -> list[str]:
    """Words between the tokenizer's white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in SPACE.split(text) if w]
    return text.split()


class Encoder(dict):
    """Ids of words as little-endian numbers of 32 bits, remembered for a bounded number of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = [self.tokenizer.id_to_token(k) for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = out = np.array(ids, "<u4").tobytes()
        return out

    def words(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, split_words(text)))

    def decode(self, ids: bytes) -> str:
        """As ``decode(ids, skip_special_tokens=False)`` of a tokenizer without a decoder."""
        names = self.names
        return " ".join([names[k] for k in np.frombuffer(ids, "<u4").tolist()])


def fragments(text: str) -> tuple[str, str, str] | None:
    """What stands before the first and after the last white space, and the part between; None without any."""
    first = SPACE.search(text)
    if first is None:
        return None
    body = text[first.end() :]
    stop = len(body)
    while stop and not SPACE.match(body[stop - 1]):
        stop -= 1
    return text[: first.start()], body[:stop], body[stop:]


#: Ids of a chunk's first fragment, whole words and last fragment.
Encoded = tuple[bytes, bytes, bytes]


def encode_chunk(text: str, encoder: Encoder) -> Encoded | None:
    parts = fragments(text)
    return None if parts is None else tuple(encoder.words(p) for p in parts)


def encode_text(text: str | None, encoder: Encoder, known: dict[bytes, Encoded | None]) -> bytes:
    """Ids of a whole text from its chunks; words across joins are encoded again."""
    out: list[bytes] = []
    open_text, open_ids = "", b""  # the word that the last chunk ended in, and its ids so far
    stretch: list[bytes] = []  # chunks in a row that the dictionary does not have

    def flush() -> None:
        nonlocal open_text, open_ids
        if not stretch:
            return
        whole = open_text + b"".join(stretch).decode()
        stretch.clear()
        parts = fragments(whole)
        if parts is None:
            open_text, open_ids = whole, b""
            return
        out.append(encoder.words(parts[0]) + encoder.words(parts[1]))
        open_text, open_ids = parts[2], b""

    for chunk in chunks(text):
        found = known.get(xxhash.xxh3_128_digest(chunk)) if known else None
        if found is None:
            stretch.append(chunk)
            continue
        flush()
        head, _, tail = fragments(chunk.decode())
        if open_text and head:
            again = encoder.words(open_text + head)
            # exact agreement leaves both encodings as they are
            out.append(open_ids + found[0] if again == open_ids + found[0] else again)
        else:
            out.append((open_ids or encoder.words(open_text)) + found[0])
        out.append(found[1])
        open_text, open_ids = tail, found[2]
    flush()
    out.append(open_ids or encoder.words(open_text))
    return b"".join(out)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held: dict[bytes, list[int]] = {}
        for text in batch["text"]:
            for chunk in chunks(text):
                row = held.setdefault(xxhash.xxh3_128_digest(chunk), [len(chunk), 0])
                row[1] += 1
        yield pd.DataFrame(
            {"hash": list(held), "bytes": [r[0] for r in held.values()], "n": [r[1] for r in held.values()]}
        ).astype({"bytes": "int64", "n": "int64"})


def most_saving(texts: DataFrame, dictionary_bytes: int) -> DataFrame:
    """``(hash, bytes)`` of shared chunks, those that save most bytes first, within the bound.

    Savings are counted in levels of a quarter of a power of two; the levels from the top
    that fit are taken, and no chunk has to be sorted.
    """
    shared = stored(
        texts.mapInPandas(_counted, "hash binary, bytes long, n long")
        .groupBy("hash")
        .agg(F.max("bytes").alias("bytes"), F.sum("n").alias("n"))
        .where("n > 1")
        .withColumn("level", F.floor(F.log2(F.col("bytes") * (F.col("n") - 1)) * 4).cast("int"))
    )
    levels = shared.groupBy("level").agg(F.sum("bytes").alias("bytes")).collect()  # at most some 250 rows
    total, least = 0, 1 << 30
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["bytes"]
        if total > dictionary_bytes:
            break
        least = row["level"]
    return shared.where(F.col("level") >= least).select("hash", "bytes")


def dictionary(texts: DataFrame, tokenizer: str, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[bytes, Encoded]:
    """Shared chunks and their ids, each encoded once."""
    wanted = texts.sparkSession.sparkContext.broadcast(
        frozenset(bytes(r["hash"]) for r in most_saving(texts, dictionary_bytes).collect())  # bounded by dictionary_bytes
    )
    if not wanted.value:
        return {}

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                for chunk in chunks(text):
                    name = xxhash.xxh3_128_digest(chunk)
                    if name in wanted.value and name not in seen:
                        seen.add(name)
                        rows.append((name, chunk.decode()))
            yield pd.DataFrame(rows, columns=["hash", "chunk"])

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows = [(h, encode_chunk(c, encoder)) for h, c in zip(batch["hash"], batch["chunk"])]
            rows = [(bytes(h), *e) for h, e in rows if e is not None]
            yield pd.DataFrame(rows, columns=["hash", "head", "core", "tail"])

    rows = (
        texts.mapInPandas(found, "hash binary, chunk string")
        .groupBy("hash")
        .agg(F.min("chunk").alias("chunk"))
        .mapInPandas(encoded, "hash binary, head binary, core binary, tail binary")
    )
    return {bytes(r["hash"]): (bytes(r["head"]), bytes(r["core"]), bytes(r["tail"])) for r in rows.toLocalIterator()}


def encode(
    docs: DataFrame,
    tokenizer: str,
    decode: bool = False,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """``docs`` with ``ids`` (little-endian numbers of 32 bits) and, if asked, ``decoded``.

    ``tokenizer`` is the path of a file of the tokenizers library that every executor has.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    docs = docs.select(*kept)
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs.select("text"), tokenizer, dictionary_bytes))

    @F.arrow_udf("ids binary, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(tokenizer)
        for texts in batches:
            ids = [encode_text(t.as_py(), encoder, known.value) for t in texts]
            del texts  # before the next batch is read
            decoded = pa.array([encoder.decode(x) if decode else None for x in ids], pa.string())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])

    out = docs.withColumn("__bpe", both(F.col("text"))).select(*kept, "__bpe.ids", "__bpe.decoded")
    return out if decode else out.drop("decoded")


def decode_ids(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` with ``decoded``, from their ``ids``."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(tokenizer)
        for ids in batches:
            decoded = pa.array([encoder.decode(x.as_py()) for x in ids], pa.string())
            del ids  # before the next batch is read
            yield decoded

    return rows.withColumn("decoded", texts(F.col("ids")))


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, vocabulary(), decode=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
