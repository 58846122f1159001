"""Line deduplication by pairwise alignment of overlapping documents.

1. Each line opens and closes one shortest run of lines of at least ``min_words`` words (a
   window). Windows travel as hashes, with their places in the document. The first document
   that holds a window, the smallest (id, text hash), is what later holders of it overlap
   with; windows of one document only propose nothing.
2. A document and an earlier one with windows in common are aligned by patience diff: lines
   with one place on both sides are anchors, of which the longest rising series stays;
   between anchors lines are aligned likewise, repeated ones in order of occurrence. Lines
   are known by the rarest shared window over them, so no text travels.
3. Runs that follow each other on both sides are blocks. A window that one alignment leaves
   out, because blocks stand in another order, is aligned once more by itself. Blocks leave
   the later document; ``matches`` tells where each stands in the earlier one.

A longer common block is the union of its windows, and each of them is aligned with its
first holder. So a line goes if any earlier document holds it in a run of ``min_words``.
Pairs are formed with first holders only: at most as many as a document has windows, however
many documents share one. A window's places are listed once for each document, so a line
that a document repeats very often costs its places and not their products.

Lines are compared after trimming and with runs of white space as one space. Blank lines
neither count nor break a run, and stay.

Defined results: null text stays null and has no lines; a null id sorts before all
others; rows that repeat id and text are one document and lose the same lines; a block
repeated within one document only is left alone; ``blocks`` counts runs of deleted lines
that no other line parts; other columns are kept whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import release, stored, table

MIN_WORDS = 40
KEY = ["doc", "th"]
#: Rounds of unique anchors within anchors; after that repeated lines are aligned in order.
DEPTH = 32


def text_hash(text: Column) -> Column:
    """Tells texts with one id apart."""
    return F.xxhash64(F.lit("text"), F.coalesce(text, F.lit("")))


def windows(text: str, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, number of lines and 128-bit hash of each shortest run, lines counted without blank ones."""
    held = [w for x in text.encode().split(b"\n") if (w := x.split())]
    ends = np.cumsum([len(w) for w in held], dtype=np.int64)
    before = np.concatenate([[0], ends])[:-1]
    places = np.arange(len(held))
    last = np.searchsorted(ends, before + min_words)
    first = np.searchsorted(before, ends - min_words, "right") - 1
    spans = np.concatenate([
        np.stack([places, last], 1)[last < len(held)],
        np.stack([first, places], 1)[first >= 0],
    ])
    if not len(spans):
        return places[:0], places[:0], np.zeros((0, 2), np.int64)
    spans = np.unique(spans, axis=0)
    digests = b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in held)
    hashes = b"".join(xxhash.xxh3_128_digest(digests[16 * a:16 * b + 16]) for a, b in spans.tolist())
    return spans[:, 0], spans[:, 1] - spans[:, 0] + 1, np.frombuffer(hashes, "<i8").reshape(-1, 2)


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines, h1, h2, starts, sizes = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own, counts, hashes = windows(text, min_words)
                if not len(own):
                    continue
                order = np.lexsort((own, hashes[:, 1], hashes[:, 0]))
                hashes = hashes[order]
                new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]).any(axis=1)]))
                rows.append(np.full(len(new), k))
                lines.append(counts[order][new])
                h1.append(hashes[new, 0])
                h2.append(hashes[new, 1])
                starts.append(own[order])
                sizes.append(np.diff(np.append(new, len(own))))
            if not rows:
                continue
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            taken = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(taken), batch.column("th").take(taken),
                    pa.array(np.concatenate(h1)), pa.array(np.concatenate(h2)), pa.array(np.concatenate(lines), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(starts), pa.int32())),
                ],
                [*KEY, "h1", "h2", "lines", "starts"],
            )

    return run


def windows_of(docs: DataFrame, min_words: int) -> DataFrame:
    """``(doc, th, h1, h2, lines, starts)``: a document's windows, each with all its places there."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), text_hash(F.col("text")).alias("th"), "text")
    return texts.mapInArrow(_windows(min_words), f"doc {kind}, th long, h1 long, h2 long, lines int, starts array<int>")


def overlaps(found: DataFrame) -> DataFrame:
    """``(doc, th, shared)``: of each document the windows that an earlier one holds first.

    An entry of ``shared`` has the earlier document, the window's lines and its places in both.
    """
    first = stored(
        found.groupBy("h1", "h2")
        .agg(F.min(F.struct(*KEY, "starts")).alias("first"), F.max(F.struct(*KEY)).alias("last"))
        .where("struct(first.doc, first.th) < last")
        .select("h1", "h2", F.struct("first.doc", "first.th").alias("first"), F.col("first.starts").alias("first_starts"))
    )
    later = found.join(first, ["h1", "h2"]).where(~F.struct(*KEY).eqNullSafe(F.col("first")))
    entry = F.struct(
        F.col("first.doc").alias("earlier"), F.col("first.th").alias("earlier_th"), "lines", "starts", "first_starts"
    )
    out = stored(later.groupBy(*KEY).agg(F.collect_set(entry).alias("shared")))  # no more than the document has windows
    release(first)
    return out


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs``, sorted by the first, whose second numbers rise."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back.append(ends[at - 1] if at else -1)
        tails[at:at + 1] = [y]
        ends[at:at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(own: dict[int, tuple[int, ...]]) -> dict[int, int]:
    """Align places of a document with those of an earlier one.

    ``own`` gives, for each line of the document, its places in the other, rising; equal
    lines have equal places. Returns place to place, rising in both.
    """
    aligned: dict[int, int] = {}
    work = [(sorted(own), -1, float("inf"), 0)]
    while work:
        places, low, high, depth = work.pop()
        alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for p in places:
            alike[own[p]].append(p)
        single, ordered = [], []
        for there, here in alike.items():
            start, stop = bisect_right(there, low), bisect_left(there, high)
            if stop - start == 1 == len(here):
                single.append((here[0], there[start]))
            ordered += zip(here, there[start:stop])
        # without unique lines, or deep down, the first occurrence meets the first, the second the second
        deep = not single or depth == DEPTH
        anchors = longest_rising(sorted(ordered if deep else single))
        aligned.update(anchors)
        if deep:
            continue
        bounds = [(-1, low), *anchors, (float("inf"), high)]
        for (p0, q0), (p1, q1) in zip(bounds, bounds[1:]):
            part = places[bisect_right(places, p0) : bisect_left(places, p1)]
            if part and q1 - q0 > 1:
                work.append((part, q0, q1, depth + 1))
    return aligned


#: Lines from a place of the document on, and their place in the earlier one.
Match = tuple[int, int, int]


def align(shared: list[tuple[int, list[int], list[int]]]) -> list[Match]:
    """``(start, lines, earlier start)`` of the common blocks of two documents.

    ``shared`` has lines and places in both documents of each window that they have in common.
    """
    # each line by the window over it that the earlier document holds least often
    own: dict[int, tuple[int, ...]] = {}
    for lines, starts, there in sorted(shared, key=lambda w: len(w[2])):
        places = [tuple(q + k for q in there) for k in range(lines)]
        for start in starts:
            for k in range(lines):
                own.setdefault(start + k, places[k])
    aligned = patience(own)
    spans, left = [], []
    stop = {}  # where the run of aligned lines over a place ends
    for p in sorted(aligned, reverse=True):
        stop[p] = stop[p + 1] if aligned.get(p + 1) == aligned[p] + 1 else p + 1
    for lines, starts, there in shared:
        held = set(there)
        for start in starts:
            if stop.get(start, 0) >= start + lines and aligned[start] in held:
                spans.append((aligned[start] - start, start, lines))
            else:
                left.append((start, lines, there))
    gone = {start + k for _, start, lines in spans for k in range(lines)}
    for start, lines, there in left:
        if any(start + k not in gone for k in range(lines)):
            # the place that continues the diagonal of what came before, if there is one
            spans.append((there[max(0, bisect_right(there, start) - 1)] - start, start, lines))
    out: list[list[int]] = []
    for off, start, lines in sorted(spans):
        if out and out[-1][0] == off and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], start + lines)
        else:
            out.append([off, start, start + lines])
    return sorted((start, end - start, start + off) for off, start, end in out)


def without(text: str, matches: list[Match]) -> tuple[str, list[int], int]:
    """The text without the lines of the matches, the numbers of these lines, and their runs."""
    held = text.split("\n")
    blank = [not line.strip(" \t\n\v\f\r") for line in held]
    change = np.zeros(len(held) + 1, np.int64)
    for start, lines, _ in matches:
        change[start] += 1
        change[start + lines] -= 1
    inside = (np.cumsum(change) > 0).tolist()
    kept, removed, count, open_run, place = [], [], 0, False, 0
    for k, line in enumerate(held):
        if not blank[k]:
            if inside[place]:
                removed.append(k)
                count += not open_run
            else:
                kept.append(line)
            open_run = inside[place]
            place += 1
        else:
            kept.append(line)
    return "\n".join(kept), removed, count


def _without(text: pd.Series, shared: pd.Series) -> pd.DataFrame:
    rows = []
    for x, entries in zip(text, shared):
        if entries is None:
            rows.append((None, None, None, None))
            continue
        pairs: dict[tuple, list] = defaultdict(list)
        for w in entries:
            pairs[w["earlier"], w["earlier_th"]].append((w["lines"], list(w["starts"]), tuple(w["first_starts"])))
        found = [(earlier, *m) for (earlier, _), windows in pairs.items() for m in align(windows)]
        rows.append((*without(x, [m[1:] for m in found]), [dict(zip(MATCH, m)) for m in sorted(found, key=lambda m: m[1:])]))
    return pd.DataFrame(rows, columns=["kept_text", "removed", "blocks", "matches"]).astype({"blocks": "Int32"})


#: Fields of a match; lines are counted without blank ones.
MATCH = ("earlier", "start", "lines", "earlier_start")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``kept_text``, ``removed`` (numbers of the deleted lines), ``blocks`` and ``matches``.

    ``docs`` has doc_id and text; other columns stay.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = stored(windows_of(docs, min_words))
    found = overlaps(held)
    release(held)
    found = found.withColumnsRenamed({c: f"__{c}" for c in found.columns})
    # not broadcast, however few documents have hits: shuffles grow in proportion to the input
    joined = docs.join(
        found.hint("merge"), docs["doc_id"].eqNullSafe(found["__doc"]) & (text_hash(docs["text"]) == found["__th"]), "left"
    )
    hit = F.col("__shared").isNotNull()
    match = f"array<struct<earlier: {kind}, start: int, lines: int, earlier_start: int>>"
    # called nondeterministic, or Spark would run it twice, in two workers a task, where a caller filters by its result
    udf = F.pandas_udf(_without, f"kept_text string, removed array<int>, blocks int, matches {match}").asNondeterministic()
    left = udf(F.when(hit, docs["text"]), F.col("__shared"))
    others = [c for c in docs.columns if c not in ("kept_text", "removed", "blocks", "matches")]
    return joined.select(
        *[docs[c] for c in others], docs["text"].alias("__text"), hit.alias("__hit"), left.alias("__left")
    ).select(
        *others,
        F.when(F.col("__hit"), F.col("__left.kept_text")).otherwise(F.col("__text")).alias("kept_text"),
        F.coalesce("__left.removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("__left.blocks", F.lit(0)).alias("blocks"),
        F.coalesce("__left.matches", F.array().cast(match)).alias("matches"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.size("removed").alias("removed_lines"),
        "removed",
        "blocks",
        F.transform("matches", lambda m: m["earlier"]).alias("earlier_docs"),
        F.length(F.coalesce("kept_text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )
