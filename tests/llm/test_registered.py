"""Every registered query over whole given tables, against SQL or plain Python on all contract columns."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from repaylens.llm import bpe, bytebpe

pytestmark = pytest.mark.filterwarnings("ignore")
FOLDER = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def given(sql):
    return duckdb.sql(sql.replace("@", FOLDER + "/")).fetchall()


@pytest.fixture(scope="module")
def docs():
    return dict(given("SELECT doc_id, text FROM '@documents.parquet'"))


def run(spark, name, folder=FOLDER):
    return contract.queries()[name](spark, folder)


def by_doc(spark, name, docs):
    rows = run(spark, name).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    return {r["doc_id"]: r for r in rows}


def test_ten_and_three_are_registered():
    numbers = sorted(int(m[1]) for q in contract.queries() if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14)) and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(contract.LLM_ORACLE))
def test_equals_sql(spark, name):
    assert compare(run(spark, name), connect(FOLDER), contract.oracle_sql()[name]) == []


def test_op2_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    library.no_truncation()
    library.no_padding()
    for d, r in by_doc(spark, "op2_bpe", docs).items():
        ids = library.encode(docs[d] or "", add_special_tokens=False).ids
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_op4_holds_the_law_of_keys(spark, docs):
    rows = by_doc(spark, "op4_sharding", docs)
    slots = {}
    for d, r in rows.items():
        data = (docs[d] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 24 for r in rows.values()) and len(slots) == 24


def test_op6_reads_back_every_conversation(spark):
    want = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for conv, role, text in given("SELECT conv_id, role, text FROM '@conversations.parquet' ORDER BY conv_id, turn"):
        want.setdefault(conv, []).append((role, text or ""))
    rows = run(spark, "op6_chat").collect()
    assert sorted(r["conv_id"] for r in rows) == sorted(want)
    for r in rows:
        turns = want[r["conv_id"]]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(role) + len(text) for role, text in turns)


def test_op7_equals_comparing_all_pairs(spark, docs):
    sets = {}
    for d, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for d, r in by_doc(spark, "op7_jaccard", docs).items():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[d]), root(d))


def test_op8_finds_what_holds_an_item_word_for_word(spark, docs):
    found = {(r["doc_id"]) for r in run(spark, "op8_decontamination").collect()}
    flat = lambda t: f" {' '.join((t or '').lower().split())} "
    items = [flat(t) for _, t in given("SELECT item_id, text FROM '@benchmark.parquet'") if (t or "").strip()]
    exact = {d for d, t in docs.items() if any(x in flat(t) for x in items)}
    assert exact and exact <= found


def test_op9_scores_rows_it_never_learnt_from(spark):
    folder = "/root/testdata/sf0.01"
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    rows = run(spark, "op9_toxicity", folder).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    ranked = sorted(((r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic))
    good, bad = [s for s, y in ranked if not y], [s for s, y in ranked if y]
    area = np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])
    assert len(bad) >= 10 and area > 0.8, area  # chance is 0.5


def test_op10_base_columns_equal_plain_python(spark, docs):
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for d, r in by_doc(spark, "op10_licenses", docs).items():
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), docs[d] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [
            (k, label) for phrase, label in base.items() for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        starts = [k for k, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op12_equals_the_library(spark, docs):
    import tiktoken

    path, pattern = bytebpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.Ranks(path).ids, special_tokens={})
    for d, r in by_doc(spark, "op12_byte_bpe", docs).items():
        ids = library.encode_ordinary(docs[d] or "")
        want = (len(ids), sha(",".join(map(str, ids))), sha((docs[d] or "").encode()))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
