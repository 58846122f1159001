"""Exact n-gram Jaccard join by prefixes of tokens and token combinations.

A document is the set of hashes of its word shingles (the tokens). Tokens have one
global order: rare ones first, then frequent ones, by hash within both. Of a set of n
tokens at most m = n - ceil(t n) are missing from a set it links with. Its prefix goes on
until m + 1 losses cannot take all its signatures: a rare token is a signature by itself;
frequent tokens are spread over subclasses, and all pairs within a subclass are
signatures, of which s tokens yield s - 1 that are safe. Two sets that link then share a
signature (the tokens they share of the shorter prefix keep at least one). A signature of
the whole set finds equal sets of any size.

Frequent tokens are known from a bitmap of bounded size. It only decides the order, so any
error in it changes the work and never the result.

Equal word sequences are one node. Candidates are the pairs of a signature's nodes. They
are checked in steps: each node with the centre it shares most signatures with; then, as
long as that settles half of what is open, one pair for each two components of a signature;
at last, within signatures whose nodes are still in several components, all pairs across
components, those whose sketches agree best first. A pair that meets under several
signatures is taken at one of them. Pairs inside a component cannot change the result.

Before texts are compared, a sketch of 1,024 bits rules pairs out: each token flips one
bit, so two sketches differ in at most as many bits as the sets differ in tokens. What
differs in more bits than a link allows cannot link; nothing else is left out.

Defined results: null and blank texts have no shingles and link with nothing; a text of
fewer words than a shingle has one token, its whole sequence; repeated rows are one node;
a null id gets the component of its text's other rows, null if there are none; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.bitmaps import broadcast_bitmap, contains, opened
from repaylens.llm.common import components, release, salt, salts, stored, table

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: A token in the prefixes of more texts than this is frequent.
FREQUENT = 24
#: Longs of the sketch of a set.
SKETCH = 16
#: Tokens of a subclass of frequent ones in a prefix.
PER_SUBCLASS = 6
#: Smallest open signatures of a node by which a pair is taken only once.
LOWEST = 16
#: Rounds that check the best open pair of each node before all that are left are checked.
BEST_FIRST = 2
#: Bytes of text that are cut into words at once.
PART_BYTES = 1 << 21
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Keep the first 0 to 8 bytes of a little-endian number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bits in which the sketches of a and b differ, as SQL. Each long is a column of its own: with arrays
#: the code that Spark generates for a join of pairs passes 8,000 bytes, and the JVM would only interpret it.
DIFFERING = " + ".join(f"bit_count(a_bits{k} ^ b_bits{k})" for k in range(SKETCH))


def bits_of(x: str) -> list[Column]:
    """The longs of the column ``bits`` as columns of node ``x``."""
    return [F.col("bits")[k].alias(f"{x}_bits{k}") for k in range(SKETCH)]


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        # below, sets of a few frequent tokens have too few pairs to be safe
        if not 67 <= self.percent <= 100 or self.words < 1:
            raise ValueError("percent is 67 to 100, words at least 1")

    def losses(self, n: int) -> int:
        """How many of ``n`` tokens a linked set can lack."""
        return n - -(-self.percent * n // 100)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and 100 * both >= self.percent * (len(a) + len(b) - both)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; for a few hundred numbers faster than the hashing of np.unique."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def parts(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about PART_BYTES in the columns ``texts``, one row at least."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PART_BYTES)) + 1
    for start, stop in pairwise([0, *cuts.tolist(), len(batch)]):
        if stop > start:
            yield batch.slice(start, stop - start)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, taken eight bytes at a time."""
    if not len(words):
        return np.zeros(0, np.uint64)
    wide = pa.types.is_large_string(words.type)
    ends = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1]
    at, sizes = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
    data = bytes(words.buffers()[2] or b"") + bytes(8)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=1)
    out = sizes.astype(np.uint64) * ODD
    some = np.arange(len(sizes))
    for k in range(0, LONG_WORD, 8):
        some = some[sizes[some] > k]
        if not len(some):
            break
        chunk = eights[at[some] + k] & MASKS[np.minimum(sizes[some] - k, 8)]
        out[some] = mixed((out[some] ^ chunk) * ODD)
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[at[k] : at[k] + sizes[k]])
    return out


def split_words(texts: pa.Array) -> pa.Array:
    """Lists of what ``words_of`` finds; empty words may stand at both ends."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def shingles(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for each ``length`` consecutive hashes of words."""
    count = max(0, len(words) - length + 1)
    h = np.full(count, length, np.uint64)
    for k in range(length):
        h = (h ^ words[k : k + count]) * ODD + np.uint64(k + 1)
        h ^= h >> np.uint64(31)
    return mixed(h)


def tokens_of(split: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of each text, whose words come from ``split_words``."""
    words = split.flatten()
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    hashes = word_hashes(words)[real]
    before = np.concatenate([[0], np.cumsum(real)])
    ends = before[np.concatenate([[0], np.cumsum(counts)])].tolist()
    h = shingles(hashes, size)  # those that reach into the next text are left out below
    out = []
    for start, stop in pairwise(ends):
        length = min(size, stop - start)
        found = h[start : stop - size + 1] if length == size else shingles(hashes[start:stop], length)[: length > 0]
        out.append(distinct(found))
    return out


def keys_of(split: pa.Array) -> np.ndarray:
    """Two numbers that tell word sequences apart, for each text."""
    joined = pc.fill_null(pc.ascii_trim_whitespace(pc.binary_join(split, " ")), "").cast(pa.binary())
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, joined.to_pylist())), "<i8").reshape(-1, 2)


def lists(found: list[np.ndarray]) -> pa.Array:
    """A column of arrays of longs."""
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))


def signatures(tokens: np.ndarray, frequent: np.ndarray, rule: Rule) -> np.ndarray:
    """The signatures of one set; ``frequent`` tells which tokens are."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.uint64)
    need = rule.losses(n) + 1
    whole = np.bitwise_xor.reduce(mixed(tokens + MIX), keepdims=True)
    out = [mixed(whole + np.uint64(n))]
    rare = tokens[~frequent]
    out.append(mixed(rare[:need] ^ ODD))
    if len(rare) < need:
        common = tokens[frequent]
        top = n.bit_length() - 1
        # a set just above a power of two also meets those just below it
        levels = [top] if top == 0 or rule.percent * n >= 100 * (1 << top) else [top, top - 1]
        for level in levels:
            out.append(_pairs(common, need - len(rare), level, rule))
    return distinct(np.concatenate(out))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each of 64 * SKETCH bits."""
    places = (tokens >> np.uint64(20)) % np.uint64(64 * SKETCH)
    odd = np.bincount(places.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _pairs(common: np.ndarray, need: int, level: int, rule: Rule) -> np.ndarray:
    """Pairs within subclasses of the shortest prefix of ``common`` that is safe against ``need - 1`` losses."""
    classes = max(1, (rule.losses(1 << level) + 1) // PER_SUBCLASS)
    own = (mixed(common ^ MIX) % np.uint64(classes)).astype(np.int64)
    # the first token of a subclass is not safe, each further one is
    order = np.argsort(own, kind="stable")
    first = np.ones(len(common), bool)
    first[order[1:]] = own[order[1:]] != own[order[:-1]]
    safe = np.cumsum(~first)
    stop = int(np.searchsorted(safe, need)) + 1
    prefix, own = common[:stop], own[:stop]
    order = np.argsort(own, kind="stable")
    out, name = [], np.uint64((level + 1) * int(MIX) % (1 << 64))
    for group in np.split(prefix[order], np.flatnonzero(np.diff(own[order])) + 1):
        i, j = np.triu_indices(len(group), 1)
        out.append(mixed((group[i] * ODD ^ group[j]) + name))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _prefix_tokens(rule: Rule):
    """Tokens that may be in prefixes: those of lowest hash, a quarter more than a prefix of rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                held = []
                for tokens in tokens_of(split_words(part.column("text")), rule.words):
                    need = rule.losses(len(tokens)) + 1
                    held.append(tokens[: need + need // 4 + 4])
                found, counts = np.unique(np.concatenate(held), return_counts=True)
                yield pa.record_batch({"token": found.view(np.int64), "n": counts.astype(np.int32)})

    return run


def _signed(rule: Rule, shared):
    """Key, size and signatures of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = opened(shared)
        for batch in batches:
            for part in parts(batch, "text"):
                split = split_words(part.column("text"))
                keys = keys_of(split)
                sets = tokens_of(split, rule.words)
                sizes = np.array([len(x) for x in sets], np.int32)
                often = np.split(contains(bitmap, np.concatenate(sets)), np.cumsum(sizes[:-1]))
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "k1": np.ascontiguousarray(keys[:, 0]),
                        "k2": np.ascontiguousarray(keys[:, 1]),
                        "n": sizes,
                        "signatures": lists([signatures(x, f, rule) for x, f in zip(sets, often)]),
                        "bits": lists([sketch(x) for x in sets]),
                    }
                )

    return run


def _members(shared):
    """Signatures that more than one node may have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = opened(shared)
        for batch in batches:
            nodes, found = [], []
            for node, own in zip(batch["node"], batch["signatures"]):
                own = np.asarray(own, np.int64)
                own = own[contains(bitmap, own.view(np.uint64))]
                nodes.append(np.full(len(own), node, np.int64))
                found.append(own)
            sizes = np.repeat(batch["n"].to_numpy(np.int64), [len(x) for x in found])
            yield pd.DataFrame(
                {"signature": np.concatenate(found or [np.zeros(0, np.int64)]), "node": np.concatenate(nodes or [np.zeros(0, np.int64)]), "n": sizes}
            )

    return run


def _checked(rule: Rule):
    """Pairs of texts that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "a_text", "b_text"):
                # rows come by b, mostly
                b = part.column("b").to_numpy()
                new = np.concatenate([[True], b[1:] != b[:-1]])
                run_of = (np.cumsum(new) - 1).tolist()
                left = tokens_of(split_words(part.column("a_text")), rule.words)
                right = tokens_of(split_words(part.column("b_text").filter(pa.array(new))), rule.words)
                same = pa.array([rule.links(x, right[k]) for x, k in zip(left, run_of)], pa.bool_())
                yield part.select(["a", "b"]).filter(same)

    return run


def _of_nodes(shared):
    """Rows whose node may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = opened(shared)
        for batch in batches:
            yield batch.filter(pa.array(contains(bitmap, batch["node"].to_numpy().view(np.uint64))))

    return run


def _wanted_texts(rule: Rule, shared):
    """Key and text of documents whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = opened(shared)
        for batch in batches:
            for part in parts(batch, "text"):
                texts = part.column("text")
                keys = keys_of(split_words(texts))
                here = contains(bitmap, keys[:, 0].view(np.uint64))
                yield pa.record_batch({"k1": keys[here, 0], "k2": keys[here, 1], "text": texts.filter(pa.array(here))})

    return run


class Join:
    """The join of one table of texts; ``nodes`` holds (node, k1, k2, n, first_id)."""

    def __init__(self, docs: DataFrame, rule: Rule, id: str = "doc_id", text: str = "text"):
        self.rule = rule
        # ids travel as text: pandas would turn a column of longs with nulls into doubles
        self.kind = docs.schema[id].dataType.simpleString()
        self.rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
        texts = self.rows.select("text")
        counts = (
            texts.mapInArrow(_prefix_tokens(rule), "token long, n int")
            .groupBy("token")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") > FREQUENT)
        )
        often = stored(counts.select("token"))
        frequent = broadcast_bitmap(often, often.count())
        release(often)
        self.signed = stored(
            self.rows.mapInArrow(_signed(rule, frequent), "id string, k1 long, k2 long, n int, signatures array<long>, bits array<long>").withColumn(
                "id", F.col("id").cast(self.kind)
            )
        )
        classes = self.signed.groupBy("k1", "k2").agg(
            F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("signatures").alias("signatures"), F.first("bits").alias("bits")
        )
        frequent.destroy()
        nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
        self.ids = stored(self.signed.select("id", "k1", "k2", F.col("n").cast("long").alias("n_shingles")))
        release(self.signed)
        self.nodes = nodes
        #: Texts by node, a part for each check that needed further ones.
        self.texts: list[DataFrame] = []
        #: Component of every node that links with another, as far as links are known.
        self.labels: DataFrame | None = None

    def members(self) -> DataFrame:
        """``(signature, node, n)`` of signatures that several nodes have."""
        repeated = (
            self.nodes.select(F.explode("signatures").alias("signature"))
            .groupBy("signature")
            .agg(F.count("*").alias("n"))
            .where("n > 1")
        )
        repeated = stored(repeated.select("signature"))
        shared = broadcast_bitmap(repeated, repeated.count())
        release(repeated)
        out = stored(
            self.nodes.select("node", "n", "signatures").mapInPandas(_members(shared), "signature long, node long, n long")
        )
        shared.destroy()
        return out

    def fetch(self, nodes: DataFrame, most: int) -> None:
        """Store the texts of those ``nodes(node)``, ``most`` at most, whose texts are not at hand."""
        for part in self.texts:
            nodes = nodes.join(part.select("node"), "node", "left_anti")
        wanted = stored(nodes.join(self.nodes.select("node", "k1", "k2"), "node"), most)
        if wanted.isEmpty():
            release(wanted)
            return
        shared = broadcast_bitmap(wanted.select("k1"), most)
        found = self.rows.select("text").mapInArrow(_wanted_texts(self.rule, shared), "k1 long, k2 long, text string")
        self.texts.append(
            stored(found.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"]).select("node", "text"))
        )
        release(wanted)
        shared.destroy()

    def check(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that link. Pairs are stored, so Spark may split a node of many.

        Only texts of the pairs' nodes are shuffled.
        """
        size = pairs.count()
        nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * size)
        self.fetch(nodes, 2 * size)
        shared = broadcast_bitmap(nodes, 2 * size)
        release(nodes)
        parts = [part.mapInArrow(_of_nodes(shared), "node long, text string") for part in self.texts]
        if not parts:  # there is no pair either
            return stored(pairs.select("a", "b"))
        texts = reduce(DataFrame.unionByName, parts)
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
        found = pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_checked(self.rule), "a long, b long")
        # texts stay dealt out while they are compared; the links are few
        out = stored(found)
        shared.destroy()
        return out

    def learn(self, links: DataFrame) -> None:
        """Bring the labels up to date with new ``links``, which are stored and then removed.

        Components are formed of labels, so the work follows the new links.
        """
        known = self.labels
        if known is not None and links.isEmpty():
            release(links)
            return
        ends = links
        if known is not None:
            for side in ("a", "b"):
                own = known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
                ends = ends.join(own, side, "left").withColumn(f"{side}_c", F.coalesce(f"{side}_c", side))
            ends = ends.select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))
        merged = components(ends)
        if known is None:
            self.labels = stored(merged.withColumnRenamed("id", "node"))
            release(merged, links)
            return
        renamed = known.join(merged.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
        new = merged.join(known.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), "component")
        self.labels = stored(renamed.select("node", F.coalesce("now", "component").alias("component")).unionByName(new))
        release(known, merged, links)

    def fits(self, small: str, large: str):
        return F.expr(f"100 * least({small}, {large}) >= {self.rule.percent} * greatest({small}, {large})")

    def near_enough(self):
        """Whether sizes and sketches of a and b leave a link possible."""
        p = self.rule.percent
        return self.fits("a_n", "b_n") & F.expr(f"({DIFFERING}) * {100 + p} <= (a_n + b_n) * {100 - p}")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """``pairs(a, b, ...)`` that sizes and sketches do not rule out; pairs and nodes are stored."""
        a = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("a_n"), *bits_of("a"))
        b = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("b_n"), *bits_of("b"))
        found = pairs.join(a, "a").join(b, "b").where(self.near_enough())
        return found.select(pairs.columns)

    def join(self) -> None:
        """Find links that connect the same nodes as all links do."""
        members = self.members()
        centre = stored(
            members.groupBy("signature")
            .agg(F.min("node").alias("centre"), F.max("node").alias("other"), F.min_by("n", "node").alias("centre_n"), F.count("*").alias("size"))
            .where("centre < other")
            .drop("other")
        )
        near = stored(
            members.join(centre, "signature")
            .where("node <> centre")
            .where(self.fits("n", "centre_n"))
            .groupBy(F.col("node").alias("a"), F.col("centre").alias("b"))
            .agg(F.count("*").alias("times"))
        )
        best = stored(
            self.plausible(near)
            .groupBy("a")
            .agg(F.max(F.struct("times", (-F.col("b")).alias("c"))).alias("best"))
            .select("a", (-F.col("best.c")).alias("b"))
        )
        release(near)
        self.learn(self.check(best))
        shared = stored(members.join(centre.select("signature", "size"), "signature"))
        release(members, centre, best)
        most = None
        while True:
            rest = self.apart(shared, most and 2 * most + 1)
            release(shared)
            left = rest.count()
            if left and most is not None and left > most:
                self.across(rest)
            if left == 0 or most is not None and left > most:
                release(rest, *self.texts)
                return
            most = left // 2
            near = stored(self.between(rest, left), left)
            pairs = stored(self.plausible(near), left)
            self.learn(self.check(pairs))
            release(near, pairs)
            shared = rest

    def apart(self, shared: DataFrame, most: int | None) -> DataFrame:
        """Rows of ``shared``, ``most`` at most, whose signature has nodes of several components, with the component."""
        own = stored(
            shared.drop("component").join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node")),
            most,
        )
        several = stored(
            own.groupBy("signature")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low < high")
            .select("signature"),
            most,
        )
        out = stored(own.join(several, "signature"), most)
        release(own, several)
        return out

    def between(self, rest: DataFrame, left: int) -> DataFrame:
        """One pair for each component of a signature: its smallest node and that of the first component."""
        heads = stored(
            rest.groupBy("signature", "component").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("a_n")), left
        )
        first = stored(
            heads.groupBy("signature").agg(
                F.min("component").alias("component_b"), F.min_by("a", "component").alias("b"), F.min_by("a_n", "component").alias("b_n")
            ),
            left,
        )
        return (
            heads.join(first, "signature")
            .where("component <> component_b")
            .where(self.fits("a_n", "b_n"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )

    def across(self, rest: DataFrame) -> None:
        """Check the pairs of nodes of different components that share a signature, the best first."""
        pairs = stored(self.open_pairs(rest))
        for _ in range(BEST_FIRST):
            best = stored(pairs.groupBy("a").agg(F.min_by("b", F.struct("differing", "b")).alias("b")))
            self.learn(self.check(best))
            open_ = pairs
            for side in ("a", "b"):
                own = self.labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
                open_ = open_.join(own, side, "left").withColumn(f"{side}_c", F.coalesce(f"{side}_c", side))
            open_ = stored(
                open_.where("a_c <> b_c").join(best, ["a", "b"], "left_anti").select("a", "b", "differing")
            )
            release(pairs, best)
            pairs = open_
            if pairs.isEmpty():
                release(pairs)
                return
        self.learn(self.check(pairs))
        release(pairs)

    def open_pairs(self, rest: DataFrame) -> DataFrame:
        """``(a, b, differing)``: pairs of different components that sizes and sketches do not rule out.

        Near copies meet under most of their signatures. A pair is left out where both
        nodes list a smaller signature in common; the smallest they have always takes it.
        """
        lowest = rest.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("signature")), 1, LOWEST).alias("low"))
        rest = rest.join(self.nodes.select("node", "bits").join(lowest, "node"), "node")
        named = lambda x: [*[F.col(c).alias(f"{x}_{c}") for c in ("n", "component", "low")], *bits_of(x)]
        # One side is repeated for each few members of a signature, the other is dealt out.
        left = rest.select(
            "signature", F.col("node").alias("a"), *named("a"), salt(F.col("size"), F.col("node")).alias("salt")
        )
        right = rest.select(
            "signature", F.col("node").alias("b"), *named("b"), F.explode(salts(F.col("size"))).alias("salt")
        )
        return (
            left.join(right, ["signature", "salt"])
            .where("a < b AND a_component <> b_component")
            .where(self.near_enough())
            .where("coalesce(array_min(array_intersect(a_low, b_low)) >= signature, true)")
            .select("a", "b", F.expr(f"{DIFFERING} AS differing"))
            .distinct()
        )

    def all_links(self) -> DataFrame:
        """``(a, b)``: every link between two nodes, once.

        Every pair that shares a signature and is not ruled out by sizes and sketches is
        checked, so the work follows the links and near misses themselves.
        """
        members = self.members()
        sizes = stored(members.groupBy("signature").agg(F.count("*").alias("size")).where("size > 1"))
        # each node counts as a component of its own, so no pair is left out
        shared = stored(members.join(sizes, "signature").withColumn("component", F.col("node")))
        release(members, sizes)
        pairs = stored(self.open_pairs(shared).select("a", "b"))
        release(shared)
        out = self.check(pairs)
        release(pairs, *self.texts)
        return out

    def result(self) -> DataFrame:
        """``(id, n_shingles, component)`` of every row."""
        self.join()
        first = self.nodes.select("node", "k1", "k2", "first_id")
        placed = stored(first.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
        release(self.nodes, self.labels)
        least = stored(placed.groupBy("component").agg(F.min("first_id").alias("component_id")))
        named = stored(placed.join(least, "component").select("k1", "k2", "component_id"))
        release(placed, least)
        return (
            self.ids.join(named, ["k1", "k2"])
            # texts without shingles are one node, but link with nothing
            .select("id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        )


def near_groups(docs: DataFrame, rule: Rule = Rule(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row of ``docs``."""
    return Join(docs, rule, id, text).result().withColumnRenamed("id", id)


def near_links(
    docs: DataFrame, rule: Rule = Rule(), id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The links themselves: pairs of classes, and the class of every row.

    Rows of equal word sequences are one class, named by its smallest id. Pairs are
    ``(a_id, b_id)``, each once; rows are ``(id, class_id, class_size, n_links)``, where n_links
    counts the other classes that link. Rows without words have no links. A class whose rows
    all lack an id is named null; its pairs are listed.
    """
    join = Join(docs, rule, id, text)
    links = join.all_links()
    names = join.nodes.select("node", "k1", "k2", F.col("first_id").alias("class_id"))
    ends = stored(links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links")))
    a, b = (names.select(F.col("node").alias(x), F.col("class_id").alias(f"{x}_id")) for x in "ab")
    pairs = links.join(a, "a").join(b, "b").select("a_id", "b_id")
    sizes = stored(join.ids.groupBy("k1", "k2").agg(F.count("*").alias("class_size")))
    named = stored(names.join(ends, "node", "left").join(sizes, ["k1", "k2"]).drop("node"))
    release(ends, sizes)
    rows = join.ids.join(named, ["k1", "k2"]).select(
        F.col("id").alias(id), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return pairs, rows


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), Rule(words=4, percent=85))
