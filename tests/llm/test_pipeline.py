"""The pipeline on small tables against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from conftest_rows import NEAR, PASSAGE
from repaylens.llm import bpe, jaccard
from test_operators import brute_components

ITEM = "A rare sentence that stands in one test of the benchmark and nowhere else at all."
BAD = ("vileword", "foulname")


def written(spark, folder, **tables):
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string"
LABEL = "doc_id long, toxic int, score double"
TEST = "item_id long, text string, doc_id int"


def test_pipeline_equals_plain_python(spark, tmp_path):
    rng = random.Random(8)
    texts, labels = {}, []
    for k in range(400):
        # words of their own, so that the bias learns what a text without known words is
        words = [f"w{rng.randrange(10**6)}" for _ in range(14)]
        if k % 5 == 0:
            words[rng.randrange(14)] = BAD[k % 2]
        texts[k] = " ".join(words)
        labels.append((k, int(k % 5 == 0), 0.0))
    texts |= {
        900: f"first own line\n{PASSAGE}\nlast own line",
        901: f"other own line\n\n{PASSAGE}\nanother",
        902: PASSAGE,
        910: NEAR,
        911: NEAR.replace("near30 ", ""),
        920: f"before it {ITEM} and after",
        921: f"again {ITEM.upper().replace('RARE', 'RXRE')} here",
        930: None,
        931: "",
        932: "a clean document of its own",
    }
    documents = [(d, t, "en", "s", None if t is None else len(t), "x") for d, t in texts.items()]
    bench = [(1, ITEM, 1), (2, None, 1), (3, "", 1)]
    folder = written(spark, tmp_path, documents=(documents, DOC), labels=(labels, LABEL), benchmark=(bench, TEST))

    left = {d: t for d, t in texts.items() if not any(b in (t or "") for b in BAD)}
    left[901] = "other own line\n\nanother"  # its copy of the passage goes
    del left[902]  # nothing but the passage
    groups = {d: least for d, _, least in brute_components(list(left.items()), jaccard.Rule(5, 80))}
    left = {d: t for d, t in left.items() if groups[d] == d}
    assert 910 in left and 911 not in left
    left = {d: t for d, t in left.items() if d not in (920, 921)}
    library = Tokenizer.from_file(bpe.vocabulary())
    want = Counter()
    for d, t in left.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), np.array(ids, "<u4").tobytes()] += 1

    got = corpus_pipeline.run(spark, folder)
    rows = got.collect()
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in rows) == want
    for r in rows:
        text = library.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_awkward_rows(odd, none, spark, tmp_path):
    folder = written(spark, tmp_path, labels=([(1, 0, 0.0)], LABEL), benchmark=([(1, ITEM, 1)], TEST))
    columns = corpus_pipeline.COLUMNS
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == columns, name
        tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert tokens.count() == docs.count()


def kept(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


def test_stages_keep_one_row_of_each_group_whatever_the_ids(spark, tmp_path):
    other = " ".join(f"other{k}" for k in range(80))
    third = " ".join(f"third{k}" for k in range(80))
    rows = [
        (None, other), (None, other), (None, other.replace("other20", "new")),  # only null ids
        (5, NEAR), (None, NEAR), (6, NEAR), (6, "a clean text of the same id"),
        (7, third), (7, third), (8, third), (7, third.replace("third9 ", "")),  # repeated id, with and without its text
        (9, None), (9, None), (None, None), (10, ""), (10, ""),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], DOC)
    got = kept(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    clean = Counter({(6, "a clean text of the same id"): 1, (9, None): 2, (None, None): 1, (10, ""): 2, (5, NEAR): 1})
    assert clean <= got
    rest = list((got - clean).elements())
    assert len(rest) == 2 and {(d, t.split()[0]) for d, t in rest} == {(None, "other0"), (7, "third0")}

    folder = written(spark, tmp_path, benchmark=([(1, ITEM, 1)], TEST))
    rows = [(None, f"x {ITEM}"), (None, "clean"), (None, None), (1, f"{ITEM} y"), (1, "clean"), (1, "clean"), (2, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], DOC)
    got = kept(corpus_pipeline.drop_contaminated(spark, docs, folder))
    assert got == Counter([(None, "clean"), (None, None), (1, "clean"), (1, "clean"), (2, "")])


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    folder = written(spark, tmp_path, documents=([], DOC), labels=([], LABEL), benchmark=([], TEST))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_a_filter_by_line_dedup_does_not_run_it_twice(spark):
    docs = spark.createDataFrame([(1, "a text", "en", "web", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    text = corpus_pipeline.drop_repeated_lines(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
