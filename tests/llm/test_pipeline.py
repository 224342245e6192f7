import hashlib

import tokenizers
from test_jaccard import brute as linked
from test_lines import distance

import corpus_pipeline
from tidemark.llm import decontaminate, lines, toxicity
from tidemark.llm.common import settle, table, written
from tidemark.llm.queries import byte_bpe_path

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def plain_lines(docs):
    """Every non-blank line that equals an earlier one, or is long and near one, goes; documents left without words go."""
    seen, long_, out = set(), [], {}
    for i in sorted(docs):
        kept = []
        for raw in docs[i].split("\n") if docs[i] else []:
            line = raw.strip(" ")
            near = len(line) >= lines.MIN_CHARS and any(abs(len(line) - len(s)) <= lines.EDITS and lines.within(line, s) for s in long_)
            if not line.strip() or not (line in seen or near):
                kept.append(raw)
            if line.strip() and line not in seen:
                seen.add(line)
                if len(line) >= lines.MIN_CHARS:
                    long_.append(line)
        text = "\n".join(kept) if docs[i] else docs[i]
        if text == docs[i] or text.strip():
            out[i] = text
    return out


def test_stages_equal_brute_force(spark):
    assert distance("ab", "b") == 1
    docs = table(spark, SF, "documents")
    texts, columns = rows_of(docs), docs.columns
    model = toxicity.train(docs, table(spark, SF, "labels"))
    judge = toxicity.Judge(model) if model else None
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        if name == "bpe":
            library = tokenizers.Tokenizer.from_file(byte_bpe_path())
            got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in out.collect()}
            ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
            assert got == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}
            continue
        assert out.columns == columns
        if name == "toxicity":
            want = {i: t for i, t in texts.items() if judge is None or judge.scores([None if t is None else t.encode()])[0] < toxicity.THRESHOLD}
        elif name == "line_dedup":
            want = plain_lines(texts)
        elif name == "near_duplicates":
            want = {i: texts[i] for i, (_, c) in linked(sorted(texts.items())).items() if c == i}
        else:
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            index, tokens = decontaminate.Index(items), decontaminate.Tokens()
            want = {i: t for i, t in texts.items() if not decontaminate.leaks_of(index, [t], tokens)}
        assert rows_of(out) == want, name
        docs, texts = out, want


def test_each_stage_begins_with_the_memory_of_the_one_before_given_back(spark, monkeypatch):
    docs = table(spark, SF, "documents").limit(3)
    begun = []
    monkeypatch.setattr(corpus_pipeline, "settle", begun.append)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, SF)
        assert len(begun) == n


def test_settling_shrinks_the_heap(spark):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    held = [gateway.new_array(jvm.long, 25_000_000) for _ in range(6)]
    before = jvm.Runtime.getRuntime().totalMemory()
    assert before > 1_200_000_000
    for array in held:
        gateway.detach(array)
    del held
    settle(spark)
    assert jvm.Runtime.getRuntime().totalMemory() < before - 500_000_000
