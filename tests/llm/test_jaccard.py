import random
import re

from tidemark.llm import jaccard


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    rng = random.Random(4)
    rows = []
    for n in (3, 9, 25, 60, 140):
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(n)] = f"v{rng.randrange(400)}"
            rows.append(" ".join(own[: n - rng.randrange(max(1, n // 8))]))
    rows += ["", None, "Same  words\tHERE", "same words here", "one", " \n "]
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sets_that_share_segments_but_cannot_link_are_not_verified(spark, monkeypatch):
    rng, asked = random.Random(6), []
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base[:180] + [f"d{i}x{k}" for k in range(120)])) for i in range(30)]
    rows += [(100 + i, rows[i][1].replace(f"d{i}x{rng.randrange(120)} ", "z ")) for i in range(5)]
    whole = jaccard.verified

    def counted(pairs, sets):
        asked.append(pairs.count())
        return whole(pairs, sets)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert 5 <= sum(asked) <= 10


def test_links_of_earlier_turns_are_not_gone_through_again(spark, monkeypatch):
    asked, base = [], [f"w{k}" for k in range(90)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: 6 * i] + [f"v{i}"] + base[6 * i + 1 :])) for i in range(1, 15)]  # each links with the first alone
    whole = jaccard.components

    def recorded(edges):
        asked.append({(r["a"], r["b"]) for r in edges.collect()})
        return whole(edges)

    monkeypatch.setattr(jaccard, "components", recorded)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert len(asked) >= 2 and all(asked)
    assert sum(map(len, asked)) == len(set().union(*asked))
