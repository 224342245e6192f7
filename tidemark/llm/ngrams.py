"""LM scoring (operator 2): a weighted backoff automaton over smoothed n-grams.

States are contexts of up to `ORDER` - 1 words seen in training, and the empty one. The
empty state has an arc for each word, weighing log10((c + 0.1) / (N + 0.1 (V + 1))).
Any other state has an arc for each word seen after its context, weighing
log10((c(context word) + m P) / (c(context) + m)) with P what the next shorter context
gives the word, and a failure arc to that shorter context, weighing
log10(m / (c(context) + m)). Arcs and failure arcs of a state sum to one. An arc leads
to the state of the longest end of what was read that is a state.

A text is read once from left to right: from the state of a text's beginning, each
token takes the state's arc, or failure arcs until a state has one, adding up their
weights. Many texts are walked side by side. Long texts are walked in pieces of
`PIECE` tokens, each from the state that the tokens before it lead to, so a text's
length doesn't matter.

The model grows with the corpus and is nowhere whole. Texts are dealt into blocks of
about `BLOCK_BYTES` by a hash. Each block sends its n-grams' hashes, sorted, once each,
with its own training counts to as many ranges of the hashes as the corpus asks for;
each range sums them up and answers each block with the totals in the order they were
asked for. The block builds the slice of the automaton that its texts can walk. Keys
and totals travel packed in bytes, as wide as their greatest difference or value.

Defined results: a null or empty text is its end token alone; repeated rows count each
time; a null doc_id is not held out; without training rows N and V are 0 and every
token has the base probability 1; an empty table gives no rows; texts are read whole;
other columns don't matter. Rows equal in id and text share a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U, bucket_count, by_block, hashed_column, mix, pack, range_of, text_bytes, unpack, written

ORDER = 2
PRIOR = 30.0  # m: how much a shorter context counts
ADD = 0.1
BLOCK_BYTES = 12_000_000
RANGE_BYTES = 4_000_000  # of text a range of hashes
PIECE = 256
END, BEGIN = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Grams:
    """The n-grams of a block's texts: sorted distinct keys, and each token's place among them by order.

    A key is a hash; its lowest bit tells words (1) from longer n-grams and the
    beginning (0). place[k] is -1 where a text has no n-gram of k + 1 tokens ending at
    the token; an n-gram of two or more may begin with the text's beginning. Texts
    that only ask (`learns` given) get their own training counts and no places.
    """

    def __init__(self, texts: pa.Array, order: int, learns: np.ndarray | None = None):
        flat, words = hashed_column(texts)
        self.counts = counts = words + 1
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        token = np.empty(total, U)
        inner = np.ones(total, bool)
        inner[ends - 1] = False
        token[inner], token[~inner] = flat, END
        self.inner = inner
        self.nth = nth = np.arange(total) - np.repeat(ends - counts, counts)
        low = ~U(3)  # the second bit is free for what a token does here
        begin = mix(np.array([BEGIN])) & low
        grams, real = [mix(token) & low | U(1)], [np.ones(total, bool)]
        for k in range(2, order + 1):
            context = np.empty(total, U)
            context[1:] = grams[-1][:-1]
            if k == 2:
                context[nth == 0] = begin[0]
            grams.append(mix(context * U(0x9E3779B97F4A7C15) + token + U(k)) & low)
            real.append(nth >= k - 2)
        if learns is not None:
            flag = learns.astype(U) * U(2)
            each = np.repeat(flag, counts)
            keys = np.sort(np.concatenate([begin | flag, *[(g | each)[r] for g, r in zip(grams, real, strict=True)]]))
            learnt = (keys & U(2)) > 0
            keys &= ~U(2)
            if np.any(keys[1:] < keys[:-1]):  # a word's bit below the flag
                rank = np.argsort(keys)
                keys, learnt = keys[rank], learnt[rank]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            self.keys = keys[first]
            self.own = np.add.reduceat(learnt.astype(np.int64), np.flatnonzero(first))
            return
        keys = np.concatenate([begin, *[g[r] for g, r in zip(grams, real, strict=True)]])
        rank = np.argsort(keys)
        keys = keys[rank]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        number = np.empty(len(keys), np.int32)
        number[rank] = np.cumsum(first) - 1
        self.keys = keys[first]
        self.begin, at = int(number[0]), 1
        self.place = []
        for r in real:
            place = np.full(total, -1, np.int32)
            n = int(np.count_nonzero(r))
            place[r] = number[at : at + n]
            self.place.append(place)
            at += n

    def cuts(self, ranges: int) -> np.ndarray:
        """Where each range of the keys begins, and the end of the last."""
        return np.searchsorted(range_of(self.keys, ranges), np.arange(ranges + 1))


class Automaton:
    """The slice of the automaton that one block's texts can walk; states and words are numbers.

    arc: sorted state * words + word; weight and target beside it. fail, fail_weight
    and start by state; gram_state: the state of each n-gram, 0 (the empty one) if none.
    """

    def __init__(self, grams: Grams, totals: np.ndarray, tokens: int, distinct: int, order: int, prior: float):
        c = totals.astype(np.float64)
        n = len(totals)
        self.grams, self.order, self.words = grams, order, n
        p = np.where((grams.keys & U(1)) > 0, (c + ADD) / (tokens + ADD * (distinct + 1)), 0.0)
        self.base, self.known = np.log10(np.where(p > 0, p, 1.0)), totals > 0
        # The states: contexts seen in training, numbered from 1.
        context = np.zeros(n, bool)
        context[grams.begin] = True
        for place in grams.place[: order - 1]:
            context[place[grams.inner & (place >= 0)]] = True
        is_state = context & (totals > 0)
        self.gram_state = np.where(is_state, np.cumsum(is_state), 0)
        many = int(is_state.sum()) + 1
        count = np.concatenate([[0.0], c[is_state]])
        self.fail = np.zeros(many, np.int64)
        self.fail_weight = np.log10(np.where(count > 0, prior / (count + prior), 1.0))
        self.start = int(self.gram_state[grams.begin])
        arcs, weights, targets = [], [], []
        for k, place in enumerate(grams.place):
            seen = np.flatnonzero(place >= 0)
            one = np.full(n, -1, np.int64)
            one[place[seen]] = seen  # one token that ends each n-gram tells its context, word and shorter end
            gram = np.flatnonzero(one >= 0)
            first = one[gram]
            word = grams.place[0][first]
            shorter = grams.place[k - 1][first] if k else np.zeros(len(first), np.int64)
            if k == 0:
                state = np.zeros(len(first), np.int64)
            else:
                known = totals[gram] > 0
                gram, first, word, shorter = gram[known], first[known], word[known], shorter[known]
                before = grams.place[k - 1][first - 1] if k > 1 else np.where(grams.nth[first] > 0, grams.place[0][first - 1], grams.begin)
                state = self.gram_state[before]
                p[gram] = (c[gram] + prior * p[shorter]) / (c[before] + prior)
                own = self.gram_state[gram]
                self.fail[own[own > 0]] = self.gram_state[shorter[own > 0]]
            arcs.append(state.astype(np.int64) * n + word)
            weights.append(np.log10(p[gram]))
            own = self.gram_state[gram]
            targets.append(np.where(own > 0, own, self.gram_state[shorter]) if k else own)
        arcs = np.concatenate(arcs)
        rank = np.argsort(arcs)
        self.arc, self.weight, self.target = arcs[rank], np.concatenate(weights)[rank], np.concatenate(targets)[rank]

    def walk(self) -> np.ndarray:
        """log10 probability of each text: all pieces of all texts in step, each carrying its state."""
        grams = self.grams
        counts, word = grams.counts, grams.place[0]
        pieces = (counts + PIECE - 1) // PIECE
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = (np.cumsum(counts) - counts)[text] + nth * PIECE
        length = np.minimum(counts[text] - nth * PIECE, PIECE)
        state = np.full(len(text), self.start, np.int64)
        later = np.flatnonzero(nth > 0)
        state[later] = self.after(at[later] - 1)
        order = np.argsort(-length, kind="stable")
        at, length, state, owner = at[order], length[order], state[order], text[order]
        score = np.zeros(len(text))
        for step in range(int(length[0]) if len(length) else 0):
            moving = np.arange(np.searchsorted(-length, -step, "left"))  # the pieces longer than step
            w = word[at[moving] + step]
            while len(moving):
                code = state[moving] * self.words + w
                found = np.minimum(np.searchsorted(self.arc, code), len(self.arc) - 1)
                taken = self.arc[found] == code
                score[moving[taken]] += self.weight[found[taken]]
                state[moving[taken]] = self.target[found[taken]]
                moving, w = moving[~taken], w[~taken]  # the empty state has an arc for every word
                score[moving] += self.fail_weight[state[moving]]
                state[moving] = self.fail[state[moving]]
        return np.bincount(owner, weights=score, minlength=len(counts))

    def after(self, at: np.ndarray) -> np.ndarray:
        """The state that reading up to each of some tokens leads to: of the longest end that is one."""
        state = np.zeros(len(at), np.int64)
        for place in self.grams.place[: self.order - 1]:
            gram = place[at]
            longer = np.where(gram >= 0, self.gram_state[gram], 0)
            state = np.where(longer > 0, longer, state)
        return state


def asked(rows: DataFrame, n_blocks: int, ranges: int, order: int) -> DataFrame:
    """(range, block, n, keys, counts): the packed n-grams of each block by range of their hashes."""

    def run(batches):
        for block, parts in by_block(batches, 0):
            learns = np.concatenate([part.column(1).to_numpy(zero_copy_only=False) for part in parts])
            grams = Grams(pa.concat_arrays([part.column(2) for part in parts]), order, learns)
            cuts = grams.cuts(ranges)
            own = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            for k in range(0, len(own), 64):
                part = own[k : k + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _, _ in part], pa.int32()),
                        pa.array([block] * len(part), pa.int32()),
                        pa.array([b - a for _, a, b in part], pa.int32()),
                        pa.array([pack(np.diff(grams.keys[a:b], prepend=grams.keys[a])) for _, a, b in part], pa.binary()),
                        pa.array([grams.keys[a].item() - (1 << 63) for _, a, _ in part], pa.int64()),
                        pa.array([pack(grams.own[a:b]) for _, a, b in part], pa.binary()),
                    ],
                    ["range", "block", "n", "keys", "first", "counts"],
                )

    dealt = rows.select("block", "learns", "text").repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block")
    return dealt.mapInArrow(run, "range int, block int, n int, keys binary, first long, counts binary")


def answered(asks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, totals, tokens, distinct): packed totals in the order asked for; N and V of each range under block -1."""

    def run(batches):
        for number, parts in by_block(batches, 0):
            blocks, keys, counts = [], [], []
            for part in parts:
                for b, n, k, f, c in zip(*(part.column(i).to_pylist() for i in range(1, 6)), strict=True):
                    blocks.append(b)
                    keys.append(np.cumsum(unpack(k, n), dtype=U) + U(f + (1 << 63)))
                    counts.append(unpack(c, n).astype(np.int64))
            sizes = [len(k) for k in keys]
            distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
            words = (distinct & U(1)) > 0
            ends = np.cumsum(sizes)
            for k in range(0, len(blocks), 256):
                part = range(k, min(k + 256, len(blocks)))
                packed = [pack(total[where[ends[i] - sizes[i] : ends[i]]]) for i in part]
                nothing = [0] * len(packed)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(packed), pa.int32()), pa.array([blocks[i] for i in part], pa.int32()), pa.array(packed, pa.binary()), pa.array(nothing, pa.int64()), pa.array(nothing, pa.int64())], ["range", "block", "totals", "tokens", "distinct"])
            sums = [int(total[words].sum())], [int(np.count_nonzero(total[words]))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())], ["range", "block", "totals", "tokens", "distinct"])

    dealt = asks.repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    return dealt.mapInArrow(run, "range int, block int, totals binary, tokens long, distinct long")


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents."""
    size = text_bytes(docs) + docs.count() * 16
    n_blocks, ranges = bucket_count(size, block_bytes), bucket_count(size, range_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    rows = docs.select(block.alias("block"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    totals = written(answered(asked(rows.withColumn("learns", ~F.col("held_out")), n_blocks, ranges, order), ranges))
    sums = totals.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = int(sums[0] or 0), int(sums[1] or 0)
    none = lambda kind_, name: F.lit(None).cast(kind_).alias(name)
    answers = totals.where("block >= 0").select("block", "range", "totals", none(kind, "doc_id"), none("boolean", "held_out"), none("string", "text"))
    texts = rows.select("block", F.lit(ranges).alias("range"), none("binary", "totals"), "doc_id", "held_out", "text")

    def run(batches):
        for _, parts in by_block(batches, 0):
            packed, docs_ = [], []
            for part in parts:
                is_text = part.column(1).to_numpy(zero_copy_only=False) == ranges
                answer = part.filter(pa.array(~is_text))
                packed += zip(answer.column(1).to_pylist(), answer.column(2).to_pylist(), strict=True)
                own = part.filter(pa.array(is_text))
                docs_.append(own)
            texts_ = pa.concat_arrays([own.column(5) for own in docs_])
            if not len(texts_):
                continue
            grams = Grams(texts_, order)
            cuts = grams.cuts(ranges)
            total = np.zeros(len(grams.keys), np.int64)
            for r, raw in packed:
                total[cuts[r] : cuts[r + 1]] = unpack(raw, int(cuts[r + 1] - cuts[r]))
            machine = Automaton(grams, total, tokens, distinct, order, prior)
            starts = np.cumsum(grams.counts) - grams.counts
            word = grams.place[0]
            known = np.add.reduceat(machine.known[word].astype(np.int64), starts)
            base = np.add.reduceat(machine.base[word], starts)
            full, at = machine.walk(), 0
            for own in docs_:
                a, at = at, at + own.num_rows
                if own.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [own.column(3), own.column(4), pa.array(grams.counts[a:at]), pa.array(known[a:at]), pa.array(np.full(at - a, tokens, np.int64)), pa.array(base[a:at]), pa.array(full[a:at])],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    dealt = answers.unionAll(texts).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block")
    return dealt.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
