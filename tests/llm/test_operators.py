"""Each operator on awkward rows, against plain Python."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_rows import ROWS
from repaylens.llm import bpe, fingerprint, jaccard, leaks, licenses, lines, shards, toxicity, trees, warc

pytestmark = pytest.mark.filterwarnings("ignore")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_delete_the_later_copy(odd):
    out = {r["doc_id"]: r for r in lines.dedup_lines(odd).where("doc_id IN (7, 8, 9)").collect()}
    assert out[8]["removed"] == [] and out[8]["kept_text"].endswith("last own line")
    assert out[9]["removed"] == [2, 3, 4, 5] and out[9]["kept_text"] == "other own line\n\nanother"
    assert out[7]["removed"] == []


def test_lines_keep_all_rows_and_columns(odd, none):
    out = lines.dedup_lines(odd)
    assert set(odd.columns) <= set(out.columns)
    assert rows_of(out, "doc_id", "text") == Counter(ROWS)
    assert out.where("doc_id = 6").first()["kept_text"] == ""
    assert lines.dedup_lines(none).count() == 0


def test_patience_aligns_rising_places():
    assert lines.patience({0: (5,), 1: (6,), 2: (1,), 3: (7,)}) == {0: 5, 1: 6, 3: 7}
    # lines that stand twice are aligned next to unique ones
    assert lines.patience({0: (0, 2), 1: (1,), 2: (0, 2)}) == {0: 0, 1: 1, 2: 2}
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(12)] for _ in range(2))
        got = lines.patience({i: tuple(j for j, y in enumerate(b) if y == x) for i, x in enumerate(a) if x in b})
        assert all(a[i] == b[j] for i, j in got.items())
        values = [got[i] for i in sorted(got)]
        assert values == sorted(set(values))


def brute_lines(rows, least):
    """Numbers of the lines in runs of ``least`` words that any earlier document holds; ids are unique."""
    split = {d: [(k, x.split()) for k, x in enumerate(t.split("\n")) if x.split()] for d, t in rows}
    out = {}
    for d, own in split.items():
        gone = set()
        for other in (split[e] for e in split if e < d):
            for i in range(len(own)):
                for j in range(len(other)):
                    run = 0
                    while i + run < len(own) and j + run < len(other) and own[i + run][1] == other[j + run][1]:
                        run += 1
                    if sum(len(w) for _, w in own[i : i + run]) >= least:
                        gone.update(k for k, _ in own[i : i + run])
        out[d] = sorted(gone)
    return out


def test_lines_equal_brute_force_over_all_earlier_documents(spark):
    rng = random.Random(6)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.randrange(1, 8))) for k in range(30)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(30)
            own += pool[a : a + rng.randrange(1, 9)] if rng.random() < 0.7 else [f"own{d}", "", pool[a]]
        rows.append((d, "\n".join(own)))
    # the whole of 102 is in 101, but each of its lines stands first in another document
    block = [" ".join(f"b{k}w{j}" for j in range(5)) for k in range(9)]
    rows += [(70 + k, f"alone{k}\n{x}") for k, x in enumerate(block)]
    rows += [(101, "\n".join(["before", *block, "after"])), (102, "\n".join(block)), (103, "\n".join([*block[5:], *block[:5]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (12, 40):
        got = {r["doc_id"]: r for r in lines.dedup_lines(df, least).collect()}
        want = brute_lines(rows, least)
        assert {d: r["removed"] for d, r in got.items()} == want
        assert all(r["kept_text"] == "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in want[d]) for d, r in got.items())
    assert want[102] == list(range(9))


def test_lines_repeated_very_often_stay_linear(spark):
    """With an array of the places of each equal line, two such documents made 4e8 numbers in one row."""
    line, count = " ".join(f"r{k}" for k in range(5)), 20_000
    rows = [(1, "\n".join(["head", *[line] * count])), (2, "\n".join([*[line] * count, "tail"]))]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["removed"], got[2]["removed"], got[2]["blocks"]) == ([], list(range(count)), 1)
    assert got[2]["kept_text"] == "tail"


# BPE


def test_bpe_equals_the_library_and_decodes(odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids
    want = Counter((d, np.array(encode(t), "<u4").tobytes(), library.decode(encode(t), skip_special_tokens=False)) for d, t in ROWS)
    for size in (bpe.DICTIONARY_BYTES, 0):
        got = bpe.encode(odd, bpe.vocabulary(), decode=True, dictionary_bytes=size)
        assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got.collect()) == want
    assert bpe.encode(none, bpe.vocabulary()).count() == 0


def test_bpe_joins_are_repaired():
    rng = random.Random(7)
    encoder = bpe.Encoder(bpe.vocabulary())
    for _ in range(60):
        text = "".join(rng.choice("ab c.é\n<|endoftext|>\x1f　") for _ in range(4000))
        parts = bpe.chunks(text)
        assert b"".join(parts).decode() == text
        known = {}
        for c in parts:
            if rng.random() < 0.6 and (e := bpe.encode_chunk(c.decode(), encoder)):
                known[__import__("xxhash").xxh3_128_digest(c)] = e
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.encode_text(text, encoder, known) == np.array(whole, "<u4").tobytes()


def test_bpe_white_space_is_the_tokenizers():
    encoder = bpe.Encoder(bpe.vocabulary())
    for c in [chr(k) for k in [*range(0x300), *range(0x1680, 0x1681), *range(0x2000, 0x2070), 0x3000, 0xFEFF]]:
        ids = encoder.tokenizer.encode(f"ab{c}cd", add_special_tokens=False).ids
        assert encoder.words(f"ab{c}cd") == np.array(ids, "<u4").tobytes(), hex(ord(c))


# exact dedup


def expected_groups():
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS]
    groups = {}
    for (d, _), x in zip(ROWS, norm):
        groups.setdefault(x, []).append(d)
    order = lambda d: (d is not None, d or 0)
    return Counter((d, min(groups[x], key=order), len(groups[x]), sha(x)) for (d, _), x in zip(ROWS, norm))


@pytest.mark.parametrize("chunk, primes", [(65_536, fingerprint.PRIMES), (100, fingerprint.PRIMES), (50, (2, 3, 2))])
def test_exact_groups(odd, none, chunk, primes):
    """Tiny chunks combine; with tiny primes nearly all fingerprints collide and texts decide."""
    docs = odd if chunk > 50 else odd.where("length(text) < 5000 OR text IS NULL")
    got = fingerprint.exact_groups(docs, chunk_chars=chunk, primes=primes)
    want = expected_groups()
    if chunk == 50:
        want = Counter({k: v for k, v in want.items() if k[0] not in (5, 6, 7)})
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.where("kept").count() == len({k[3] for k in want})
    assert fingerprint.exact_groups(none).count() == 0


def test_fingerprints_combine_by_length():
    p, r = fingerprint.PRIMES[0], fingerprint.BASES[0]
    h = lambda data: sum(c * pow(r, len(data) - 1 - k, p) for k, c in enumerate(data)) % p
    assert (h(b"abc") * pow(r, 4, p) + h(b"defg")) % p == h(b"abcdefg")


def test_a_huge_text_is_cut_once(spark):
    """Texts of 20 million characters; taking each chunk by its number would walk 3,000 million of them."""
    unit = "é😀 word\u2028 and more of it\n"
    docs = spark.range(3).selectExpr("id AS row_key", f"repeat('{unit}', 800000) || if(id = 2, 'x', '') AS text").where("row_key > 0")
    size = len(unit.encode())
    got = {r["row_key"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert {k: r["fp_len"] for k, r in got.items()} == {1: 800_000 * size, 2: 800_000 * size + 1}
    p, b = fingerprint.PRIMES[0], fingerprint.BASES[0]
    one = 0
    for byte in unit.encode():
        one = (one * b + byte) % p
    step, whole, times = pow(b, size, p), 0, 800_000
    while times:  # sum of one * step^k by doubling
        if times & 1:
            whole = (whole * step + one) % p
        one, step, times = (one * step + one) % p, step * step % p, times >> 1
    assert got[1]["fp0"] == whole and got[2]["fp0"] == (whole * b + ord("x")) % p


# shards


def test_shards(odd, none):
    got = shards.shard(odd, 24).collect()
    assert len(got) == len(ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ROWS
    )
    for s in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shards.shard(none, 24).count() == 0


@pytest.mark.parametrize("count", [1, 5, 24, 30])
def test_growth_moves_rows_only_into_the_new_shard(spark, count):
    key = F.col("id")
    rows = spark.range(20_000).select(
        shards.shard_of(key, shards.topology(count)).alias("a"), shards.shard_of(key, shards.topology(count + 1)).alias("b")
    ).collect()
    if count >= 24:
        assert all(a == b or b == count for a, b in rows)
    sizes = Counter(a for a, _ in rows)
    assert set(sizes) == set(range(count)) and max(sizes.values()) < 1.25 * 20_000 / count


@pytest.mark.parametrize("count", [1, 5, 11, 12, 20, 23, 24, 26])
def test_one_more_shard_takes_rows_only_into_itself_at_any_count(spark, count):
    docs = spark.range(5_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    got = shards.shard(docs, count).collect()
    assert {r["shard"] for r in got} == set(range(count))
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {count}


def test_a_heavier_subtree_only_gains(spark):
    from dataclasses import replace

    tree = shards.topology(24)
    rack = replace(tree.children[0].children[1], weight=8.0)
    region = replace(tree.children[0], children=(tree.children[0].children[0], rack, tree.children[0].children[2]))
    heavier = replace(tree, children=(region, tree.children[1]))
    moved = spark.range(5_000).select(
        shards.shard_of(F.col("id"), tree).alias("a"), shards.shard_of(F.col("id"), heavier).alias("b")
    ).where("a <> b").collect()
    assert moved and all(4 <= r["b"] <= 7 for r in moved)


# WARC


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "é😀\r\n\r\nWARC/1.1\r\n" * 900
    pages = [(1, "http://a/\r\nx", body), (2, None, None), (3, "u", body), (4, "u", "short"), (5, "u", "short"), (None, "u", "no id"), (6, "u", ""), (7, "u", "z" * 150), (7, "u", "z" * 150)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=1000, chunk_bytes=300, records_per_file=4)
    got = warc.read_archives(spark, str(tmp_path / "w"))
    data = [(p, (h or "").encode()) for p, _, h in pages]
    want = Counter((p, len(b), sha(b), "revisit" if p == 3 else "response", 1 if p == 3 else None, None) for p, b in data)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem") == want
    assert warc.read_archives(spark, str(tmp_path / "w")).where("problem IS NOT NULL").count() == 0
    warc.write_archives(df.limit(0), str(tmp_path / "e"))


def test_warc_says_what_is_wrong():
    import pandas as pd

    block = warc.HTTP + warc.chunked(b"a" * 500, 100)
    digest = "sha256:" + sha(b"a" * 500)
    part = lambda n, b, total=None: {"number": n, "total": total, "digest": digest if n == 1 else None, "block": b}
    cases = [
        [part(2, block[300:], len(block)), part(1, block[:300])],
        [part(1, block[:300]), part(3, block[300:], len(block))],
        [part(1, block[:300]), part(2, block[300:], len(block) + 1)],
        [part(1, block[:300]), part(2, block[300:-9], len(block) - 9)],
    ]
    out = next(warc.join_segments(iter([pd.DataFrame({"origin": list("abcd"), "segments": cases})])))
    assert out["problem"].iloc[0] is None and out["payload_bytes"].iloc[0] == 500
    assert out["problem"].notna().tolist() == [False, True, True, True]


# reply trees


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    parts = ["<|end|>", "<|turn|>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "\n", "a", "|", ">"]
    texts = [("".join(rng.choice(parts) for _ in range(12)),) for _ in range(400)]
    df = spark.createDataFrame(texts, "t string").select(
        "t", trees.escaped(F.col("t")).alias("e"), trees.escaped_role(F.col("t")).alias("r")
    )
    bad = df.where(
        (trees.unescaped(F.col("e")) != F.col("t")) | (trees.unescaped_role(F.col("r")) != F.col("t"))
        | F.col("e").rlike(r"<\|end\|>|<\|turn\|>|</s>|\[/?INST\]") | F.col("r").contains("\n")
    )
    assert bad.count() == 0


def test_branches_of_a_tree(spark):
    m = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0),
         ("t", 4, 2, "user", None, 0.5), ("t", 5, 9, "user", "orphan", 0.0), (None, 1, None, "user", "", 0.0)]
    df = spark.createDataFrame(m, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): r for r in trees.conversations(df).collect()}
    assert set(got) == {("t", 3), ("t", 4), ("t", 5), (None, 1)}
    assert [got["t", k]["rank"] for k in (3, 4, 5)] == [1, 2, 3]
    assert got["t", 4]["formatted"] == "<|turn|>user\nq<|end|>\n<|turn|>assistant\na<|end|>\n<|turn|>user\n<|end|>\n"
    (start, length), = got["t", 4]["loss"]
    assert got["t", 4]["formatted"][start : start + length] == "a"
    assert trees.conversations(df, best=1).where("tree = 't'").count() == 1
    assert trees.conversations(df.limit(0)).count() == 0


def test_long_paths_and_cycles(spark):
    chain = spark.range(1, 301).selectExpr("'c' tree", "id node", "nullif(id - 1, 0) parent", "'user' role", "string(id) text", "1.0 score")
    got = trees.conversations(chain).withColumn("turns", trees.read_turns(F.col("formatted"))).collect()
    assert len(got) == 1 and [t["text"] for t in got[0]["turns"]] == [str(k) for k in range(1, 301)]


# Jaccard join


def brute_components(rows, rule):
    words = [jaccard.words_of(t) for _, t in rows]
    k = rule.words
    sets = [{tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in words]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and group[i] != group[j] and 100 * both >= rule.percent * len(sets[i] | sets[j]):
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
                    changed = True
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return Counter((d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, group))


def test_jaccard_on_awkward_rows(odd, none):
    rule = jaccard.Rule(4, 85)
    assert rows_of(jaccard.near_groups(odd, rule), "doc_id", "n_shingles", "component_id") == brute_components(ROWS, rule)
    assert jaccard.near_groups(none, rule).count() == 0


def test_jaccard_with_frequent_tokens(spark, monkeypatch):
    """Many near copies, so that tokens are frequent and pairs of tokens decide."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = random.Random(5)
    rows = []
    for base in range(4):
        words = [f"w{base}q{k}" for k in range(30 + 40 * base)]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: len(own) - rng.randrange(0, 12)])))
    rows += [(1000 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rule = jaccard.Rule(2, 80)
    assert rows_of(jaccard.near_groups(df, rule), "doc_id", "n_shingles", "component_id") == brute_components(rows, rule)


def test_texts_are_cut_together_like_one_at_a_time(monkeypatch):
    long = "x" * 70
    texts = [None, "", " \t ", "One", " a  b\x0bc\x0cd\r\ne ", "\u00c4b \u00e4B\u00a0c \x1c d", "a a a a a", f"{long}y {long}z {long}y", f"{long[:64]} {long[:63]}",
             "q\x00 q q\x00\x00", "abcdefgh abcdefghi abcdefgh\x00", "ein zwei drei vier", "b c d e", "ONE"]
    texts += ["x " * k for k in range(6)]
    array = pa.array(["cut off", *texts]).slice(1)
    split = jaccard.split_words(array)
    words = [jaccard.words_of(t) for t in texts]
    of = {}
    for sizes in (1, 2, 4):
        for w, tokens in zip(words, jaccard.tokens_of(split, sizes)):
            n = min(sizes, len(w))
            runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
            assert len(tokens) == len(runs) and (np.diff(tokens.astype(object)) > 0).all()
            for run in runs:  # a run has one hash wherever it stands, and another one no other run has
                of.setdefault(run, set(tokens.tolist())).intersection_update(tokens.tolist())
    assert all(of.values())
    keys = list(map(tuple, jaccard.keys_of(split).tolist()))
    assert [[a == b for b in keys] for a in keys] == [[a == b for b in words] for a in words]
    # parts hold all rows, and long texts stand alone
    monkeypatch.setattr(jaccard, "PART_BYTES", 100)
    batch = pa.record_batch({"text": array})
    found = list(jaccard.parts(batch, "text"))
    assert pa.Table.from_batches(found) == pa.Table.from_batches([batch]) and len(found) > 3
    assert not list(jaccard.parts(batch.slice(0, 0), "text"))


def test_linked_sets_share_signatures():
    rng = np.random.default_rng(9)
    for percent in (70, 85):
        rule = jaccard.Rule(1, percent)
        for _ in range(400):
            n = int(rng.integers(1, 80))
            a = np.unique(jaccard.mixed(rng.integers(0, 10**6, n).astype(np.uint64)))
            b = a[rng.random(len(a)) > 0.1]
            b = np.unique(np.concatenate([b, jaccard.mixed(rng.integers(0, 10**6, int(rng.integers(0, 4))).astype(np.uint64))]))
            if not rule.links(a, b):
                continue
            often = lambda x: (x >> np.uint64(7)) % np.uint64(10) < 7  # noqa: E731, B023
            assert np.intersect1d(jaccard.signatures(a, often(a), rule), jaccard.signatures(b, often(b), rule)).size
            apart = int(np.bitwise_count((jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64)).sum())
            assert apart * (100 + percent) <= (len(a) + len(b)) * (100 - percent)


# decontamination


def test_myers_equals_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 20)))
        want = min(distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert leaks.myers(item, text)[0] == want


def test_leaks(spark, odd, none):
    item = "A rare sentence, that stands in one test of the benchmark only."
    docs = [(1, f"before {item} after"), (2, f"x {item.replace('rare', 'rxre').replace('one', 'onee').upper()} y"), (3, "a clean document of its own"), (4, None), (None, item)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "?!")], "item_id long, text string")
    got = rows_of(leaks.find_leaks(df, bench), "doc_id", "item_id", "distance")
    assert got == Counter([(1, 0, 0), (2, 0, 2), (None, 0, 0)])
    many = spark.createDataFrame([(k, f"{item} {k}") for k in range(30)], "item_id long, text string")
    whole = rows_of(leaks.find_leaks(df, many), "doc_id", "item_id", "distance")
    assert rows_of(leaks.find_leaks(df, many, block_chars=500), "doc_id", "item_id", "distance") == whole and whole
    assert leaks.find_leaks(odd, bench).count() == leaks.find_leaks(none, bench).count() == 0


def brute_leak(item, text, rate=leaks.RATE):
    """(distance, end) of the best place of whole words, over all of them."""
    own, words, found = item.split(), text.split(), []
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            part = words[i:j]
            d = distance(item, " ".join(part))
            one = len(own) >= leaks.LONG_WORDS and len(part) == len(own) and sum(x != y for x, y in zip(own, part)) < 2
            if d <= int(rate * len(item)) or one:
                found.append((d, len(" ".join(words[:j]))))
    return min(found, default=None)


def test_leaks_are_places_of_whole_words_within_the_budget():
    rng = random.Random(11)
    letters = lambda least, most: "".join(rng.choice("abc") for _ in range(rng.randrange(least, most)))
    for n in range(150):
        item = [letters(1, 9) for _ in range(rng.choice([1, 3, 9, 10, 12]))]
        if n % 9 == 0 and len(item) > 2:
            item[len(item) // 2] = letters(60, 61)
        copy = list(item)
        if n % 3 < 2:
            copy[rng.randrange(len(item))] = letters(1, 30)
        text = " ".join([letters(1, 5), *copy, letters(1, 5)])
        for _ in range(rng.randrange(2)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "a", " "]) + text[at + 1 :]
        item, text = " ".join(item), leaks.normal(text)
        if len(item) < leaks.LEAST_CHARS:
            continue
        items = [("i", item)]
        got = leaks.hits(text, items, leaks.automaton(items, leaks.RATE), leaks.RATE)
        assert (got[0][:2] if got else None) == brute_leak(item, text), (item, text)


def test_items_of_one_or_two_characters_are_whole_words(spark):
    df = spark.createDataFrame([(1, "an x marks it"), (2, "xx six taxes"), (3, "it's 42 now"), (4, "421")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "X"), (1, "42"), (2, "?!")], "item_id long, text string")
    assert rows_of(leaks.find_leaks(df, bench), "doc_id", "item_id") == Counter([(1, 0), (3, 1)])


def test_short_items_are_whole_words_and_long_ones_may_have_another_word(spark):
    long = "one rare passage of exactly twelve words stands here for this test"
    docs = [(1, "these bytes are eyes, yesterday"), (2, "Yes, they are."), (3, f"so {long.replace('passage', 'extraordinarily')} too"),
            (4, long.replace("passage", "phrase").replace("twelve", "dozen"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(0, "yes"), (1, long)], "item_id long, text string")
    assert rows_of(leaks.find_leaks(df, bench), "doc_id", "item_id", "distance", "allowed") == Counter([(2, 0, 0, 0), (3, 1, 13, 13)])


# toxicity


def test_toxicity_learns_and_scores_all_rows(spark, odd, none):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        words = [rng.choice(["tree", "river", "stone", "cloud", "field"]) for _ in range(12)]
        if bad:
            words[rng.randrange(12)] = rng.choice(["vileword", "foulname"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (10**9, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, known).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in held) for k in got)
    assert all(got[k]["predicted"] == labels[k][1] for k in held)
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, known).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-9 for k in got)
    out = toxicity.toxicity(odd, known)
    assert rows_of(out, "doc_id", "text") == Counter(ROWS) and out.where("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert toxicity.toxicity(none, known).count() == 0


def test_learning_keeps_its_state_out_of_the_driver(spark, monkeypatch):
    rows = [(k, f"word{k % 97} other{k % 13} " + ("vileword" if k % 5 == 0 else "stone")) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    sent, got, frame, context = [], [], type(df), type(spark.sparkContext)
    whole, one_by_one, broadcast = frame.collect, frame.toLocalIterator, context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    monkeypatch.setattr(frame, "collect", lambda self: [got.append(r) or r for r in whole(self)])
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, **k: (got.append(r) or r for r in one_by_one(self, **k)))
    tracemalloc.start()
    model = toxicity.learn(df, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model and len(model) < 1000 and not sent
    assert sum(len(x) for r in got for x in r if isinstance(x, bytes | bytearray)) == 12 * len(model)  # weights alone
    assert peak < 8 << toxicity.BITS  # less than one number a feature


def test_a_round_adds_the_mean_of_the_shares():
    rng, size = np.random.default_rng(3), 1 << toxicity.BITS
    z, n = np.zeros(size), np.zeros(size)
    held = {c: [] for c in ("block", "z", "n", "rounded")}
    for _ in range(2):
        groups = [
            pd.DataFrame({"order": range(9), "text": [f"a{x} b{x % 7} c" for x in rng.integers(0, 50, 9)], "toxic": rng.integers(0, 2, 9)})
            for _ in range(3)
        ]
        before = np.stack([z, n]).astype(np.float32)
        blocks = pd.DataFrame(held)
        assert (toxicity.rounded(blocks) == before).all()
        parts = []
        for k, group in enumerate(groups):
            parts += [(k, *x) for x in toxicity.added(group, toxicity.rounded(blocks), toxicity.Rates())]
            zs, ns = (x.astype(np.float64) for x in before)
            own = [(toxicity.features(t, toxicity.Words()), y) for t, y in zip(group["text"], group["toxic"])]
            toxicity.ftrl(own, zs, ns, toxicity.Rates(), toxicity.PASSES)
            z, n = z + (zs - before[0]) / 3, n + (ns - before[1]) / 3
        parts = pd.DataFrame(parts[::-1], columns=["share", "block", "at", "z", "n"])
        held = {c: [] for c in held}
        for b in range(size // toxicity.BLOCK):
            was = blocks[blocks["block"] == b] if len(blocks) else blocks
            zb, nb = toxicity.merged(parts[parts["block"] == b], was, 3)
            held["block"].append(b)
            held["z"].append(zb.tobytes())
            held["n"].append(nb.tobytes())
            held["rounded"].append(np.concatenate([zb, nb]).astype(np.float32).tobytes())
            at = slice(b * toxicity.BLOCK, (b + 1) * toxicity.BLOCK)
            assert np.allclose(zb, z[at], atol=1e-5) and np.allclose(nb, n[at], atol=1e-5)
            z[at], n[at] = zb, nb


def test_learning_without_rows(spark):
    df = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(df, none) == {}
    assert [r["score"] for r in toxicity.toxicity(df, none).collect()] == [0.5, 0.5]


def test_scoring_holds_one_batch_of_texts():
    held = []

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes())
            yield pa.array(["word " * 200_000, None, "toxic"])

    weights = np.zeros(1 << toxicity.BITS)
    weights[toxicity.features("toxic", toxicity.Words())[1:]] = 1.0
    out = [x.to_pylist() for x in toxicity.scored(batches(), weights)]
    assert all(x[1] == 0.5 and x[2] > 0.5 for x in out)
    assert max(held) < held[0] + 500_000


# licences


def test_licenses(spark, odd, none):
    texts = {
        1: "Licensed under the Apache License, Version 2.0.",
        2: "...Released under the MIT License; (c) all rights reserved. ALL RIGHTS RESERVED",
        3: "Licensed under CC BY-NC 4.0",
        4: "the license of the apache people",
        5: None,
        6: "GNU General Public License",
        7: "",
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[k]["labels"] for k in texts] == ["apache-2.0", "mit,reserved", "cc-by,cc-by-nc-4.0", "", "", "gpl", ""]
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (12, 2, 6, 9)
    assert (got[5]["n_words"], got[5]["first_word"], got[5]["score"]) == (0, None, 0.0)
    assert got[1]["spans"][0]["start"] == 0 and got[1]["score"] == pytest.approx(1.0)
    assert licenses.scan(odd).count() == len(ROWS) and licenses.scan(none).count() == 0


LATER_PARTS = {
    "mit": "IMPLIED: provided \"as is\", without warranty of any kind, express or implied, including but not limited to the"
           " warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "bsd-3-clause": "nor the names of its contributors may be used to endorse or promote products derived from this software"
                    " without specific prior written permission",
    "apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is"
                  " distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
           " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc0-1.0": "The person has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "lgpl-3.0": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either"
                " version 3 of the License, or (at your option) any later version",
    "agpl-3.0": "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "gpl-3.0": "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
}


def test_parts_of_common_licences_are_labelled(spark):
    labels = list(LATER_PARTS)
    rows = [(k, f"some words before {LATER_PARTS[x]} and after") for k, x in enumerate(labels)]
    rows += [(100, "the free software and the public domain, without fee or warranty"), (101, "provided that this notice")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, x in enumerate(labels):
        assert x in got[k]["labels"].split(","), (x, got[k]["labels"])
        assert any(s["label"] == x for s in got[k]["spans"]) and 0 < got[k]["score"] <= 1
    assert got[100]["labels"] == got[101]["labels"] == ""
    assert "lgpl-3.0" not in got[labels.index("gpl-3.0")]["labels"] and "gpl-3.0" not in got[labels.index("agpl-3.0")]["labels"].split(",")


def test_every_template_finds_itself_and_parts_of_it(spark):
    rows = [(k, t.text) for k, t in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(licenses.TEMPLATES):
        assert (t.label, 0) in {(s["label"], s["start"]) for s in got[k]["spans"]}, t


def test_templates_are_a_table(spark):
    own = spark.createDataFrame(
        [("house", "Use of this file, outside our HOUSE, needs the keeper's consent.", ["our house", "keeper's consent"])],
        "label string, text string, phrases array<string>",
    )
    docs = spark.createDataFrame(
        [(1, "note: use of this file outside our house needs the keeper s consent"), (2, "released under the MIT license"),
         (3, "use of this file outside our home needs the keeper's consent"), (4, None)],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs, templates=own).collect()}
    assert got == {1: "house", 2: "", 3: "", 4: ""}
    for wrong in ([("x", "", [])], [("x", "a b", ["c"])], [("x", "a " * 30_000, ["a"])]):
        with pytest.raises(ValueError):
            licenses.scan(docs, templates=spark.createDataFrame(wrong, own.schema))


def test_near_links_are_all_pairs_of_different_texts(spark, odd, none):
    rng = random.Random(11)
    base = [f"t{k}" for k in range(120)]
    rows = list(ROWS)
    for k in range(14):  # a group in which many, but not all, link with each other
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(120)] = f"new{k}"
        rows.append((200 + k, " ".join(words)))
    rows += [(300, " ".join(base)), (299, " ".join(base).upper())]
    rule = jaccard.Rule(4, 85)
    words = {t: tuple((t or "").encode().lower().split()) for _, t in rows}
    classes = {}
    for d, t in rows:
        classes.setdefault(words[t], []).append(d)
    name = {w: min((d for d in ids if d is not None), default=None) for w, ids in classes.items()}
    sets = {w: {w[i : i + 4] for i in range(max(1, len(w) - 3))} if w else set() for w in classes}
    order = list(classes)
    want, degree = Counter(), Counter()
    for i, x in enumerate(order):
        for y in order[:i]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                want[frozenset((name[x], name[y]))] += 1
                degree.update((x, y))
    pairs, members = jaccard.near_links(spark.createDataFrame(rows, "doc_id long, text string"), rule)
    assert Counter(frozenset((r["a_id"], r["b_id"])) for r in pairs.collect()) == want and len(want) > 8
    assert rows_of(members, "doc_id", "class_id", "class_size", "n_links") == Counter(
        (d, name[words[t]], len(classes[words[t]]), degree[words[t]]) for d, t in rows
    )
    pairs, members = jaccard.near_links(none, rule)
    assert pairs.count() == 0 == members.count()
