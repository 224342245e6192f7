import os
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity

SF = "/root/testdata/sf0.1"


def plain_logits(model, text):
    """Scores by the formula, a word and a window at a time."""
    words = toxicity.Words()
    ids, grams, _, _ = toxicity.read([text], words)
    vectors = [sum(model.table[g] for g in grams[i]) / toxicity.GRAMS for i in ids] + [np.zeros(toxicity.DIM, np.float32)] * 2
    total = float(model.base)
    out = model.out.reshape(len(toxicity.WIDTHS), -1)
    for filters, bias, weights, width in zip(model.filters, model.bias, out, toxicity.WIDTHS):
        starts = range(max(1, len(ids)))
        answers = [sum(vectors[s + j] @ filters[j] for j in range(width) if s + j < len(vectors)) for s in starts]
        total += float(np.maximum(np.max(answers, axis=0) + bias, 0) @ weights)
    return total


def test_logits_equal_the_formula():
    model = toxicity.Model(3)
    texts = ["one two three four", "five", "the the a six seven", "x " * 50]
    words = toxicity.Words()
    ids, grams, counts, _ = toxicity.read(texts, words)
    assert model.logits(ids, grams, counts) == pytest.approx([plain_logits(model, t) for t in texts], rel=1e-4, abs=1e-5)


def test_held_out_accuracy_on_the_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    right = sum(got[i]["predicted"] == y for i, y in known.items())
    assert all(got[i]["held_out"] for i in known)
    assert right >= 0.95 * len(known)


def frames(spark):
    bad, good = "vile awful hateful slur", "kind calm pleasant words"
    rows = [(i, f"{bad if i % 4 == 0 else good} number {i}", 1, 0.5) for i in range(40)]
    rows += [(100, None, 1, 0.5), (101, "", 1, 0.5), (102, " \t\n ", 1, 0.5), (103, bad + " more " * 30000, 1, 0.5), (None, good, 1, 0.5), (1, good, 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held int, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(7, None), (999, 1), (None, 1)], "doc_id long, toxic int")
    return docs, labels


def test_odd_rows(spark):
    docs, labels = frames(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["predicted"] for i in (100, 101, 102)] == [0, 0, 0]
    assert 0 < got[100]["score"] == got[102]["score"] <= toxicity.THRESHOLD / 2
    assert (got[103]["predicted"], got[None]["predicted"], got[None]["held_out"]) == (1, 0, False)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {100, 101, 102, None} <= {r["doc_id"] for r in kept.collect()}


def test_no_rows_and_one_class(spark):
    docs, labels = frames(spark)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_the_driver_gets_the_model_and_no_text(spark, monkeypatch):
    docs, labels = frames(spark)
    docs = docs.where("doc_id < 40 and text like '%number%'")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = [i for i in sorted(rows) if zlib.crc32(str(i).encode()) % 4 != 2]
    whole, driver = toxicity.fit, os.getpid()

    def elsewhere(*args):
        assert os.getpid() != driver
        return whole(*args)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    model = toxicity.train(docs, labels)
    y = np.array([int(i % 4 == 0) for i in ids])
    held = np.array([r["h"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("pmod(xxhash64(doc_id), 5) = 0 h").collect()])
    want = whole([rows[i] for i in ids], y, np.ones(len(ids)), held)
    assert np.array_equal(model.table, want.table) and np.array_equal(model.out, want.out)
