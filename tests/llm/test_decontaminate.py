import random

import numpy as np

from tidemark.llm import decontaminate

ITEM = "Maria buys 12 red apples at the market near Boston and gives 5 of them to her brother Paul before lunch."
SHORT = "Maria buys nine apples today. Maria eats two of them. Maria sells three of them. Maria keeps all the rest."


def found(text, item):
    return decontaminate.leaks_of(decontaminate.Index([("i", item)]), [text], decontaminate.Tokens())


def test_copies_in_another_case_are_leaks():
    for text in (ITEM, ITEM.upper(), ITEM.lower(), "some words before " + ITEM.upper() + " and after"):
        assert [(n, of, exact) for _, _, n, of, exact in found(text, ITEM)] == [(21, 21, True)], text


def test_names_that_begin_sentences_may_be_others():
    assert [(n, exact) for _, _, n, _, exact in found(SHORT.replace("Maria", "Ben"), SHORT)] == [(20, False)]


def test_other_numbers_in_capitals():
    assert found(ITEM.replace("12", "40").replace("5", "7").upper(), ITEM)


def test_other_text_is_no_leak():
    assert not found("Maria sells old books in the street behind Boston and takes none of them home to her sister.", ITEM)


def test_leaks_of_a_table(spark):
    docs = spark.createDataFrame([(1, ITEM.upper()), (2, "nothing of the kind"), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 7)]


def test_one_conflict_does_not_hide_the_rest_of_a_passage():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    words[20], words[120] = "5", "5"
    item = " ".join(words)
    words[120] = "6"
    assert [n for _, _, n, _, _ in found(" ".join(words), item)] == [179]
    named = [*words[:30], "Maria", *words[30:60], "Paul", *words[60:]]
    merged = ["Ben" if w in ("Maria", "Paul") else w for w in named]
    assert [n for _, _, n, _, _ in found(" ".join(merged), " ".join(named))] == [len(named) - 31]


def test_longest_consistent_part_equals_brute_force():
    rng = random.Random(4)
    for _ in range(2000):
        n = rng.randrange(1, 14)
        mine, theirs = ([rng.choice("abc") for _ in range(n)] for _ in range(2))
        kinds = np.array([[rng.choice([0, 2]) for _ in range(n)], [2] * n])
        sure = lambda a, b: all(
            (mine[i] == mine[j]) == (theirs[i] == theirs[j]) for i in range(a, b) for j in range(a, b) if all(kinds[0, k] or mine[k] != theirs[k] for k in (i, j))
        )
        parts = [(b - a, mine[a:b] == theirs[a:b]) for a in range(n) for b in range(a + 1, n + 1) if sure(a, b)]
        assert decontaminate.consistent(kinds, mine, theirs) == max(parts, default=(0, False))


def test_texts_are_not_shuffled_to_drop_a_few_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 200")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")  # of the texts' columns, not of the ids found
    try:
        plan = decontaminate.decontaminate(docs, spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
