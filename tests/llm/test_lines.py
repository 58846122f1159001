"""Alignment of overlapping documents."""

import random
import time

import numpy as np
import pytest

from conftest_rows import ROWS
from repaylens.llm import lines

pytestmark = pytest.mark.filterwarnings("ignore")


def held(text):
    return [tuple(x.split()) for x in (text or "").split("\n") if x.split()]


def shared_windows(a, b, least):
    """Windows of two documents that both hold, with their places."""
    there, here = {}, {}
    for found, text in ((here, a), (there, b)):
        for start, count, h in zip(*lines.windows(text, least)):
            found.setdefault((int(count), *h.tolist()), []).append(int(start))
    return [(k[0], here[k], tuple(there[k])) for k in here if k in there]


def run_lines(a, b, least):
    """Places of ``a`` in runs of ``least`` words that ``b`` holds, by comparing all places."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            run = 0
            while i + run < len(a) and j + run < len(b) and a[i + run] == b[j + run]:
                run += 1
            if sum(map(len, a[i : i + run])) >= least:
                gone.update(range(i, i + run))
    return gone


def test_blocks_of_two_documents_are_whole_and_equal_on_both_sides():
    rng = random.Random(1)
    for round in range(300):
        pool = [" ".join(f"{c}{k}" for k in range(rng.randrange(1, 6))) for c in "abcdefgh"[: rng.randrange(2, 9)]]
        a, b = ("\n".join(rng.choice([*pool, ""]) for _ in range(rng.randrange(1, 40))) for _ in range(2))
        least = rng.choice([2, 5, 12])
        found = lines.align(shared_windows(a, b, least))
        x, y = held(a), held(b)
        for start, count, earlier in found:
            assert x[start : start + count] == y[earlier : earlier + count]
            assert sum(map(len, x[start : start + count])) >= least
        assert {s + k for s, n, _ in found for k in range(n)} == run_lines(x, y, least)


def test_alignment_keeps_order_and_a_moved_block_comes_after():
    text = [f"line {k} " + " ".join(f"w{k}x{j}" for j in range(10)) for k in range(9)]
    earlier = "\n".join(text)
    later = "\n".join([*text[5:], "own words here", *text[:5]])
    # the five lines in a row are the longest rising series, the four before them moved
    assert lines.align(shared_windows(later, earlier, 40)) == [(0, 4, 5), (5, 5, 0)]
    own = {p: (q,) for p, q in enumerate([5, 6, 7, 8, 0, 1, 2, 3, 4])}
    assert lines.patience(own) == {p: q for p, (q,) in own.items() if p >= 4}


def test_a_repeated_line_is_aligned_in_order_between_anchors():
    #            a x x b x c  against  a x b x x c
    own = {0: (0,), 1: (1, 3, 4), 2: (1, 3, 4), 3: (2,), 4: (1, 3, 4), 5: (5,)}
    assert lines.patience(own) == {0: 0, 1: 1, 3: 2, 4: 3, 5: 5}


def test_reversed_paragraphs_take_no_time():
    text = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(20_000)]
    began = time.time()
    found = lines.align(shared_windows("\n".join(text[::-1]), "\n".join(text), 40))
    assert len(found) == 20_000 and time.time() - began < 30


def test_matches_name_the_earlier_document(spark):
    text = [f"line {k} " + " ".join(f"w{k}x{j}" for j in range(10)) for k in range(8)]
    rows = [
        (1, "\n".join(["head", *text[:4]])),
        (2, "\n".join(["other", "", *text[4:]])),
        (3, "\n".join([*text[4:], "own", "", *text[:4]])),
        (None, "\n".join(text[4:])),
    ]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(m) for m in got[3]["matches"]] == [(None, 0, 4, 0), (1, 5, 4, 1)]
    assert [tuple(m) for m in got[2]["matches"]] == [(None, 1, 4, 0)]
    assert (got[3]["kept_text"], got[3]["removed"], got[3]["blocks"]) == ("own\n", [0, 1, 2, 3, 6, 7, 8, 9], 2)
    assert got[1]["matches"] == [] == got[None]["matches"]


def test_matches_of_odd_rows(odd):
    for r in lines.dedup_lines(odd).collect():
        own = held(r["text"])
        for m in r["matches"]:
            texts = [held(t) for d, t in ROWS if d == m["earlier"]]
            assert any(own[m["start"] : m["start"] + m["lines"]] == t[m["earlier_start"] : m["earlier_start"] + m["lines"]] for t in texts)


def test_registered_query_equals_brute_force(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    places = {d: [k for k, x in enumerate((t or "").split("\n")) if x.split()] for d, t in docs}
    split = {d: held(t) for d, t in docs}
    got = {r["doc_id"]: r for r in lines.op1_line_dedup(spark, folder).collect()}
    assert sorted(got) == [d for d, _ in docs]
    index = {}
    for d, own in split.items():
        for x in set(own):
            index.setdefault(x, []).append(d)
    removed = 0
    for d, t in docs:
        others = {e for x in set(split[d]) for e in index[x] if e < d}
        gone = set().union(*(run_lines(split[d], split[e], lines.MIN_WORDS) for e in others)) if others else set()
        want = sorted(places[d][p] for p in gone)
        assert got[d]["removed"] == want
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in set(want))
        assert got[d]["kept_chars"] == len(kept)
        removed += len(want)
    assert removed > 0


def test_long_rising_series():
    rng = np.random.default_rng(2)
    pairs = [(k, int(q)) for k, q in enumerate(rng.permutation(200))]
    found = lines.longest_rising(pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
    best = [1] * 200
    for i in range(200):
        best[i] += max([best[j] for j in range(i) if pairs[j][1] < pairs[i][1]], default=0)
    assert len(found) == max(best)
