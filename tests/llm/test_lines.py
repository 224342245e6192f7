import random

import numpy as np

from tidemark.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "z" + text[at + 1 :]])
    return text


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        b = edited(rng, a, rng.randrange(5)) if rng.random() < 0.7 else "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        assert lines.within(a, b) == (distance(a, b) <= lines.EDITS), (a, b)


def keys(line, which):
    return {int(sig[0]) for _, sig, *_ in getattr(lines.Text([line]), which)()}


def test_every_near_line_is_asked_for_and_met_by_rare_grams():
    rng = random.Random(2)
    for _ in range(1500):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(9, 40)))
        b = edited(rng, a, rng.randrange(3))
        if distance(a, b) <= lines.EDITS and len(b) > 6:
            assert keys(a, "index") & keys(b, "asked"), (a, b)


def test_rare_grams_bring_near_lines_together(spark):
    rng = random.Random(8)
    stock = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(6)] + ["a" * 40, "ab" * 20, "-" * 33]
    some = sorted({edited(rng, rng.choice(stock), rng.randrange(6)) for _ in range(160)})
    rows = [(k, (False, k, 0), line, True) for k, line in enumerate(some)]
    frame = spark.createDataFrame(rows, "lid long, o struct<nil boolean, id long, pos int>, line string, asks boolean")
    got = {tuple(r) for r in lines.by_rare_grams(frame).collect()}
    want = {(i, j) for i in range(len(some)) for j in range(i) if distance(some[i], some[j]) <= lines.EDITS}
    assert want <= got
    assert want


def test_variants_of_a_template_do_not_all_meet(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(k, (False, k, 0), f"the same long opening of a line, then {word()} and the same long end of the line", True) for k in range(400)]
    frame = spark.createDataFrame(rows, "lid long, o struct<nil boolean, id long, pos int>, line string, asks boolean")
    assert lines.by_rare_grams(frame).count() < 400 * 20


def test_clashing_columns_and_other_ids(spark):
    line = "a line that is long enough to be compared"
    rows = [("b", line, "x", 1, 2, 3, 4), ("a", line + "s", "y", 1, 2, 3, 4), (None, line, "z", 1, 2, 3, 4)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, id string, places int, _n_lines int, _id int, lid int")
    got = {r["doc_id"]: r["text"] for r in lines.report(frame).collect()}
    assert got == {"a": line + "s", "b": "", None: ""}
    assert lines.deduplicated(frame).columns == frame.columns


def brute(rows):
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for raw in text.split("\n") if text else []:
            line = raw.strip(" ")
            if len(line) < lines.MIN_CHARS:
                kept.append(raw)
                continue
            if not any(abs(len(line) - len(s)) <= lines.EDITS and distance(line, s) <= lines.EDITS for s in seen):
                kept.append(raw)
            seen.append(line)
        out[i] = "\n".join(kept) if text else text
    return out


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    stock = ["".join(rng.choice("abcdef gh") for _ in range(rng.randrange(28, 50))).strip() for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(stock), rng.randrange(4)) if rng.random() < 0.8 else "short" for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rows += [(60, ""), (61, None), (62, "x" * 5000), (63, "x" * 5001)]
    got = {r["doc_id"]: r["text"] for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert lines.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_short_lines_go_in_query_and_pipeline(spark, tmp_path):
    import corpus_pipeline

    from tidemark.llm import queries

    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdef gh") for _ in range(rng.randrange(1, 29))).strip() or "e" for _ in range(25)]
    rows = [(i, "\n".join(rng.choice([*stock, "", "  ", "\t", f"line {i}"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(60, rows[0][1]), (61, "And ornd.\n\n And ornd. \nAnd ornd"), (62, "And ornd."), (63, None), (64, "")]
    seen, want = set(), {}
    for i, text in rows:
        kept = []
        for raw in text.split("\n") if text else []:
            line = raw.strip(" ")
            if line not in seen or not line.strip():
                kept.append(raw)
            seen.add(line)
        want[i] = "\n".join(kept) if text else text
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in queries.op7_lines(spark, str(tmp_path)).collect()} == want
    left = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    texts = dict(rows)
    assert {r["doc_id"] for r in left.collect()} == {i for i, t in want.items() if t == texts[i] or t.strip()}


def test_texts_of_lines_leave_the_shared_folder(spark, tmp_path, monkeypatch):
    import uuid

    from tidemark.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/tidemark-{uuid.uuid4().hex}")
    rng = random.Random(11)
    stock = ["".join(rng.choice("abcdef gh") for _ in range(40)).strip() for _ in range(30)]
    rows = [(i, "\n".join(edited(rng, rng.choice(stock), rng.randrange(4)) for _ in range(5))) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert [set(spark.read.parquet(str(p)).columns) for p in tmp_path.iterdir()] == [{"id", "places"}]


def test_the_powers_of_a_layout_are_kept_and_right():
    long_, short = lines.Text(["an older, longer line \U0001f600"] * 50), lines.Text(["some line"])
    assert lines.powers(lines.BASE, 9) is lines.powers(lines.BASE, 5)
    assert lines.powers(lines.BASE, 9)[:10].tolist() == [pow(lines.BASE, k, 1 << 64) for k in range(10)]
    whole = lines.Text(["x" * 900, "some line \U0001f600", "some line"])
    assert short.hashes(np.array([0]), np.array([9])) == whole.hashes(np.array([900]), np.array([9])) == whole.hashes(np.array([911]), np.array([9]))
    assert long_.hashes(np.array([22]), np.array([1])) == whole.hashes(np.array([910]), np.array([1]))


def test_a_filter_of_two_bits_holds_all_of_its_own_and_few_others(spark):
    some = lines.mix(np.arange(40_000, dtype=np.uint64))
    bits = lines.two_bits(spark.createDataFrame([(int(v),) for v in some.view(np.int64)], "sig long"), len(some))
    assert lines.held(bits, some).all()
    others = lines.mix(np.arange(10**6, 2 * 10**6, dtype=np.uint64))
    assert lines.held(bits, others).mean() < 0.005 < lines.contains(bits, others).mean()
