"""Byte-level BPE, ranked search and hard negatives on awkward rows, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex

from conftest_rows import ROWS
from repaylens.llm import bytebpe, negatives, ranked

pytestmark = pytest.mark.filterwarnings("ignore")


# byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bytebpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.Ranks(path).ids, special_tokens={})


def test_ids_equal_the_library_on_odd_rows(odd, none, tiktoken_encoding):
    out = bytebpe.encode(odd, *bytebpe.vocabulary(), decoded=True)
    assert set(odd.columns) <= set(out.columns)
    got = Counter((r["doc_id"], r["text"], tuple(r["ids"]), bytes(r["decoded"])) for r in out.collect())
    apart = bytebpe.decode(bytebpe.encode(odd, *bytebpe.vocabulary()), *bytebpe.vocabulary())
    assert got == Counter((r["doc_id"], r["text"], tuple(r["ids"]), bytes(r["decoded"])) for r in apart.collect())
    assert got == Counter((d, t, tuple(tiktoken_encoding.encode_ordinary(t or "")), (t or "").encode()) for d, t in ROWS)
    assert bytebpe.encode(none, *bytebpe.vocabulary()).count() == 0


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    out = bytebpe.decode(rows, *bytebpe.vocabulary())
    assert {r["k"]: bytes(r["decoded"]) for r in out.collect()} == {1: b"", 2: b""}


def test_ids_of_random_and_long_matches(tiktoken_encoding):
    own, rng = bytebpe.encoder(*bytebpe.vocabulary()), random.Random(5)
    alphabets = ["aeiou tnshr", "ab", "Üñé漢字😀 ab1", "'s 've\n\t.,12\x1c\x85", "xyzzy"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([3, 20, 200]))) for _ in range(1500)]
    # single matches of very many bytes: one letter, a cycle, random letters, other scripts
    texts += ["a" * 50_000, "abc" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "漢字仮名" * 8000, " " * 9999]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<i4").tolist() == tiktoken_encoding.encode_ordinary(text)


def plain_merges(piece, ids):
    """Merges the least rank, leftmost first, by looking at all pairs each time."""
    if piece in ids:
        return [ids[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not found:
            return [ids[p] for p in parts]
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_merges_of_odd_rank_files(tmp_path):
    """Ranks that fall while merging, ranks with gaps, and buckets that fill again."""
    import base64

    rng = random.Random(6)
    for k in range(30):
        tokens = [bytes([b]) for b in b"abc"]
        for _ in range(25):
            new = rng.choice(tokens) + rng.choice(tokens)
            if new not in tokens:
                tokens.append(new)
        ranks = rng.sample(range(2000), len(tokens))
        path = tmp_path / f"{k}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in zip(tokens, ranks)))
        own, ids = bytebpe.Ranks(str(path)), dict(zip(tokens, ranks))
        for _ in range(60):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
            assert own.merge(piece) == plain_merges(piece, ids)
            assert not any(own.words)


def test_forgetting_changes_nothing(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(bytebpe, "KEEP", 3)
    own = bytebpe.Encoder(*bytebpe.vocabulary())
    text = "one two three four five one two six seven eight one nine three " * 5
    for _ in range(3):
        assert np.frombuffer(own.encode(text), "<i4").tolist() == tiktoken_encoding.encode_ordinary(text)


# ranked search

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=10):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    counts = [Counter(t) for t in terms]
    n, total = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(w for c in counts for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for (doc, _), own, c in zip(docs, terms, counts):
            m = 25 + 75 * len(own) * n // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                for w in TERM.findall((text or "").translate(LOWER))
                if w in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


ITEMS = [
    (1, "the quick Brown fox passage1x3"),
    (2, "near1 near2 near3, NEAR59"),
    (2, "x y ünïcode"),
    (3, None),
    (4, " -- "),
    (5, "and5 and5 and5 word3 the"),
    (5, "and5 and5 and5 word3 the"),
    (None, "fox"),
    (6, "nobody has this"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, 1, 0.5) for r in ITEMS], "item_id long, text string, rank int, score double")


def test_search_equals_plain_python(odd, items):
    assert found(ranked.search(odd, items)) == plain_search(ROWS, ITEMS)
    assert found(ranked.search(odd, items, k=1)) == plain_search(ROWS, ITEMS, 1)


def test_search_in_small_blocks_tiles_and_strips(odd, items, monkeypatch):
    want = plain_search(ROWS, ITEMS)
    assert found(ranked.search(odd, items, block_bytes=30)) == want
    ids, terms = ranked.read_items(items.select("item_id", "text").where("text IS NOT NULL").distinct(), 0, 1)
    query = ranked.build_query(odd, terms)
    monkeypatch.setattr(ranked, "ITEMS", 2)
    monkeypatch.setattr(ranked, "TERMS", 3)
    monkeypatch.setattr(ranked, "LAYER", 5000)  # many layers
    scores = {}
    for first, part in ranked.score_block([t for _, t in ROWS], query):
        for i, row in enumerate(part.tolist()):
            scores[first + i] = row
    monkeypatch.undo()
    whole = np.concatenate([s for _, s in ranked.score_block([t for _, t in ROWS], query)])
    assert [scores[i] for i in range(len(ids))] == whole.tolist()


def test_layers_hold_their_bound_and_add_up(monkeypatch):
    monkeypatch.setattr(ranked, "LAYER", 10)
    weight = np.array([25, 3, 4, 9, 0, 1, 31], np.int64)
    query = ranked.Query(np.array([0, 0, 0, 1, 1, 1, 1]), np.array([0, 1, 2, 0, 1, 2, 3]), weight, {}, 1, 1, 2)
    layers = list(query.layers(0, 2, np.arange(4)))
    assert all((x.sum(axis=1) <= 10).all() and (x >= 0).all() for x in layers)
    assert sum(layers).astype(int).tolist() == [[25, 3, 4, 0], [9, 0, 1, 31]]


def test_ties_go_to_the_smaller_id_across_blocks(spark, monkeypatch):
    rows = [(k, "same words here") for k in range(500, 0, -1)] + [(None, "same words here")] * 3 + [(900, "other")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(ranked, "DOCS", 16)
    got = ranked.search(docs, spark.createDataFrame([(1, "words")], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11))


def test_words_of_a_long_text_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{k}É" for k in range(3000))
    whole = [w for part in ranked.words(text) for w in part]
    monkeypatch.setattr(ranked, "PIECE", 17)
    assert [w for part in ranked.words(text) for w in part] == whole == text.encode().split()


def test_search_of_nothing(odd, none, items):
    assert ranked.search(none, items).count() == 0
    assert ranked.search(odd, items.limit(0)).count() == 0


def test_random_search(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30)))) for k in range(300)]
    asked = [(k, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 6)))) for k in range(20)]
    got = ranked.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(asked, "item_id long, text string"),
    )
    assert found(got) == plain_search(docs, asked)


# hard negatives


def plain_negatives(rows, is_anchor, rule=negatives.Mining(), scale=256):
    kept = {}
    for id, vector, label in rows:
        if id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = tuple(math.floor(scale * x) for x in vector)
        if all(abs(x * scale) <= negatives.LARGEST for x in vector):
            kept[(id, label, q)] = None
    kept = list(kept)
    out = Counter()
    for anchor in kept:
        if not is_anchor(anchor[0]):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1] == anchor[1]) for r in kept if r != anchor
        )
        for p, positive, alike in [s for s in scored if s[2]][: rule.positives]:
            inside = [
                s for s in scored if not s[2] and rule.least * -p <= 100 * -s[0] <= rule.most * -p
            ][: rule.negatives]
            out.update((anchor[0], positive, k, n, -p, -s) for k, (s, n, _) in enumerate(inside, 1))
    return out


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(df):
    return Counter(tuple(r) for r in df.select(*NAMES).collect())


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, 0.1) for r in rows], "vec_id long, embedding array<float>, label int, id int, score double")


def tens(id):
    return id % 10 == 0


@pytest.mark.parametrize("dimensions", [1, 2, 40])
def test_negatives_equal_plain_python(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    rows = [(k, np.float32(rng.normal(size=dimensions)).tolist(), int(rng.integers(0, 4))) for k in range(240)]
    got = negatives.mine(vectors(spark, rows), negatives.F.col("id") % 10 == 0)
    assert mined(got) == plain_negatives(rows, tens)


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    near = [(k, np.float32(rng.normal(size=6) + 1).tolist(), k % 3) for k in range(60)]
    odd = [
        (None, [1.0] * 6, 1), (61, None, 1), (62, [1.0] * 6, None), (63, [1.0, None] * 3, 1), (64, [float("nan")] * 6, 1),
        (65, [float("inf")] * 6, 1), (66, [], 0), (67, [1.0, 2.0], 1), (70, [0.0] * 6, 2), (68, [3e38] * 6, 1),
        (30, near[30][1], 0), (30, near[30][1], 0), (30, near[31][1], 0), (80, [-1.0] * 6, 9), (90, [2.0] * 6, -3),
    ]
    rows = near + odd + near[:5]
    assert mined(negatives.mine(vectors(spark, rows), negatives.F.col("id") % 10 == 0)) == plain_negatives(rows, tens)


def test_negatives_with_a_hot_vector_and_ties(spark):
    rows = [(k, [0.5, 0.25, 1.0], k % 2) for k in range(150)] + [(k, [0.4, 0.2, 0.9], k % 5) for k in range(150, 300)]
    got = mined(negatives.mine(vectors(spark, rows), negatives.F.col("id") % 10 == 0))
    assert got == plain_negatives(rows, tens) and got


def test_negatives_of_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, np.float32(rng.uniform(3e5, 5e5, size=20)).tolist(), k % 3) for k in range(90)]
    assert negatives.exact_type(1 << 27, 20) is np.int64
    assert mined(negatives.mine(vectors(spark, rows), negatives.F.col("id") % 10 == 0)) == plain_negatives(rows, tens)


def test_negatives_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, np.float32(rng.normal(size=8)).tolist(), int(rng.integers(0, 3))) for k in range(200)]
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 300)  # several scans
    got = negatives.mine(vectors(spark, rows), negatives.F.col("id") % 10 == 0, negatives.Mining(2, 1, 10, 90))
    assert mined(got) == plain_negatives(rows, tens, negatives.Mining(2, 1, 10, 90))


def test_bounds_shrink_the_bitmap_and_lose_nothing():
    rng = np.random.default_rng(4)
    data = np.floor(rng.normal(size=(3000, 64)) * 30)
    block = negatives.Block(np.arange(3000), np.zeros(3000, np.int64), data)
    anchor = data[17]
    scan = negatives.Scan(block, anchor, np.arange(3000))
    sizes = []
    while scan.step():
        low, high = scan.bounds()
        exact = anchor @ block.columns[:, scan.alive]
        assert (low <= exact).all() and (exact <= high).all()
        scan.keep(high >= negatives.kth(low, 5))
        sizes.append(len(scan.alive))
    assert sizes[-2] < 600 and sizes == sorted(sizes, reverse=True)
    scores, ids = negatives.best_alike(block, anchor, np.arange(3000), 5, -np.inf)
    order = np.lexsort((np.arange(3000), -(data @ anchor)))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (data @ anchor)[order].tolist()


def test_negatives_of_nothing(spark):
    none = vectors(spark, [(1, [1.0], 1)]).limit(0)
    assert negatives.mine(none, negatives.F.col("id") % 10 == 0).count() == 0
    assert negatives.mine(vectors(spark, [(10, [1.0], 1), (11, [2.0], 2)]), negatives.F.col("id") % 10 == 0).count() == 0


