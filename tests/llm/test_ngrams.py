import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ngrams
from tidemark.llm.common import pack, unpack

ROWS = [(1, "The rain in the north"), (2, "the sun in the south\tand rain"), (3, None), (4, ""), (5, "unheard of"), (30, "rain the"), (38, "In the north rain"), (38, "In the north rain")]
ROWS += [(40 + k, "the rain in " * 200 + "spain") for k in range(3)]


def brute(rows, order):
    """Interpolated n-gram probabilities by the formula, from plain counts."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    read = [(i, [*(t or "").lower().split(), "</s>"]) for i, t in rows]
    count = Counter()
    for i, own in read:
        if not held[i]:
            padded = ["<s>", *own]
            for k in range(1, order + 1):
                count.update(tuple(padded[a : a + k]) for a in range(len(padded) - k + 1))
    n = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))
    v = sum(len(g) == 1 and g != ("<s>",) for g in count)

    def p(word, context):
        if not context:
            return (count[word,] + 0.1) / (n + 0.1 * (v + 1))
        c, shorter = count[context], p(word, context[1:])
        return (count[*context, word] + ngrams.PRIOR * shorter) / (c + ngrams.PRIOR) if c else shorter

    out = []
    for i, own in read:
        padded = ["<s>", *own]
        base = sum(math.log10(p(w, ())) for w in own)
        score = sum(math.log10(p(padded[k], tuple(padded[max(0, k - order + 1) : k]) if k >= order - 1 else tuple(padded[:k]))) for k in range(1, len(padded)))
        out.append((i, held[i], len(own), sum(count[w,] > 0 for w in own), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("order", [2, 4])
@pytest.mark.parametrize("size", [700, 100_000])
def test_scores_equal_brute_force(spark, size, order):
    frame = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, block int, range int")
    got = sorted(tuple(r) for r in ngrams.score(frame, order=order, block_bytes=size, range_bytes=size).collect())
    want = brute(ROWS, order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:])


def test_the_walk_takes_arcs_and_failure_arcs_and_carries_its_state():
    texts, learns = pa.array(["a b c", "a b d", "x b d"]), np.array([True, True, False])
    totals, grams = ngrams.Grams(texts, 3, learns).own, ngrams.Grams(texts, 3)
    machine = ngrams.Automaton(grams, totals, int(totals[(grams.keys & np.uint64(1)) > 0].sum()), 5, 3, 30.0)
    state = machine.gram_state
    assert machine.fail[state[grams.place[1][1]]] == state[grams.place[0][1]]  # (a b) fails to (b)
    assert state[grams.place[0][8]] == 0  # x was not learnt: no state
    whole = machine.walk()
    machine.fail_weight[:] = 0
    assert not np.allclose(whole, machine.walk())  # failure arcs weigh
    assert np.isclose(whole[0], machine.walk()[0]) or whole[0] < 0


def test_numbers_are_packed_whole():
    for values in ([], [0], [255, 256], [1 << 63, 3]):
        values = np.array(values, np.uint64)
        assert (unpack(pack(values), len(values)) == values).all()


def test_odd_ids_and_empty_table(spark):
    frame = spark.createDataFrame([("x", " a b\x0b "), (None, "a")], "doc_id string, text string")
    assert {(r["doc_id"], r["n_tokens"]) for r in ngrams.score(frame).collect()} == {("x", 3), (None, 2)}
    assert ngrams.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
