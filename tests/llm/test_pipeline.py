"""The pipeline over a small corpus with planted cases, stage by stage against brute force."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import chunks, simhash, toxicity
from tests.llm.test_dedup import slow_classes, slow_cuts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id long"


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(4000)}x" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, at = random.Random(21), tmp_path_factory.mktemp("corpus")
    passage, items = sentence(rng, 90), [(i, sentence(rng, 20)) for i in range(5)]
    texts = {i: sentence(rng, rng.randrange(60, 200)) for i in range(120)}
    for i in range(0, 120, 6):
        w = texts[i].split()
        w[5], w[20], w[33] = "blarg", "b1arg", "zwomp"
        texts[i] = " ".join(w)
    texts[201], texts[202] = texts[1], texts[1]
    texts[203], texts[204] = f"{sentence(rng, 50)} {passage} {sentence(rng, 50)}", f"{sentence(rng, 50)} {passage} {sentence(rng, 50)}"
    texts[205] = f"{sentence(rng, 50)} {items[2][1]} {sentence(rng, 50)}"
    texts[206], texts[207] = None, ""
    rows = [(i, t, None if i % 7 == 0 else "en", "s", None if t is None else len(t), "own", 5) for i, t in texts.items()]
    rows += [rows[3], (None, sentence(rng, 70), None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"), toxicity.held_out_fold(F.col("_key")))
    stage = dict(corpus_pipeline.STAGES)
    mild = stage["toxicity"](spark, docs, corpus)
    assert mild.columns == docs.columns
    bad = {r.doc_id for r in toxicity.scores(docs, lexicon).where("predicted = 1").collect()}
    assert bad == set(range(0, 120, 6)) and {r.doc_id for r in mild.collect()} == {r.doc_id for r in docs.collect()} - bad

    single = stage["simhash"](spark, mild, corpus)
    want = {c for *_, c in slow_classes([(r.doc_id, r.text) for r in mild.collect()], 4)}
    assert single.columns == docs.columns and sorted(map(str, (r.doc_id for r in single.collect()))) == sorted(map(str, want))
    assert {201, 202}.isdisjoint(want) and 1 in want

    cut = stage["chunks"](spark, single, corpus)
    kept = slow_cuts([(r.doc_id, r.text) for r in single.collect()])
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert r.text in {None if t is None else x for (i, t), x in kept.items() if i == r.doc_id}
        assert r.text is None or r.n_chars in (len(r.text), None)
    assert sum(r.n_chars or 0 for r in cut.where("doc_id in (203, 204)").collect()) < sum(r.n_chars or 0 for r in single.where("doc_id in (203, 204)").collect()) - chunks.MIN_RUN

    clean = stage["decontamination"](spark, cut, corpus)
    assert clean.columns == docs.columns and {r.doc_id for r in cut.collect()} - {r.doc_id for r in clean.collect()} == {205}

    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = stage["bpe"](spark, clean, corpus).collect()
    assert len(out) == clean.count() and all(list(r.tokens.ids) == ref.encode(r.text or "", add_special_tokens=False).ids for r in out)


def test_run_applies_all_stages(spark, corpus):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, corpus).collect()}
    assert {1, 203, 204, 206, None} <= ids and ids.isdisjoint({0, 6, 201, 202, 205})


def test_empty_corpus(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_of_one_id(spark):
    t = "some words that are told here more than once"
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (None, "x y"), (None, "x y")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.one_per_class(docs).collect()) == ["1", "None"]
