"""Toxicity (operator 9): a convolutional text classifier, trained here in numpy.

A word's vector is the mean of hashed embeddings of the word and of its first three,
four and five letters, so that forms never seen share what their stems taught. Filters
of one, two and three words run over the whole text; each filter's largest answer
anywhere counts (max pooling); a logistic layer sums them up. One embedding dimension
starts from the log-odds of each hash, the rest from noise; Adagrad does the rest.

The classifier is fitted on a bounded sample: at most `PER_CLASS` labelled documents a
class, those of the smallest hashes of their ids, of at most `MAX_CHARS` characters. A
fifth of them is set aside to calibrate: for each language, told from the text's
function words alone, the threshold that gives the best F1 at the labels' own mix is
moved to the score `THRESHOLD`. One task fits it; the driver gets the model alone.

Defined results: a text without words (null, empty, blank) has the share of toxic among
the labels learnt from as its score, but at most half of `THRESHOLD`: nothing in it can
be toxic; long texts are scored whole; labels without a document, null labels and rows
held out are not learnt from; a document labelled twice counts once, as toxic if either
says so; with labelled documents of one class or none the score is 0 everywhere, and with
few of each the model is fitted on those; repeated rows give repeated results; an empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binaries, slices

PER_CLASS = 2500
MAX_CHARS = 60_000
THRESHOLD = 0.3
ROWS = 1 << 16
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
GRAMS = 4
EPOCHS = 4
BATCH = 32
FEW = 20  # a language with fewer of a class is calibrated with all texts

# Frequent function words by language; a text's language is the one with most of them.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with be this at by from or an".split(),
    "de": "der die und das ist nicht ein eine zu den von mit sich auf dem des im für auch werden".split(),
    "fr": "le les et des est une que qui dans pour pas sur du au avec sont elle il ce plus".split(),
    "es": "el los las y una por con para del se su al lo como más pero sus o este sí".split(),
}
LANGUAGES = list(FUNCTION_WORDS)
EDGE = " \t.,;:!?\"'()[]{}<>«»„“”‘’…*_-–—"


class Words(dict):
    """Small integer of each distinct raw word; the arrays beside it hold its hashes and language."""

    LIMIT = 1 << 18

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.grams: list[tuple] = []
        self.lang: list[int] = []

    def __missing__(self, raw: str) -> int:
        word = raw.strip(EDGE)
        i = self[raw] = len(self.grams)
        if word:
            keys = (word, "3" + word[:3], "4" + word[:4], "5" + word[:5])
            self.grams.append(tuple(1 + xxhash.xxh3_64_intdigest(k.encode("utf-8", "replace")) % (ROWS - 1) for k in keys))
        else:
            self.grams.append((0,) * GRAMS)
        self.lang.append(next((n for n, k in enumerate(LANGUAGES) if word in _FUNCTION[k]), -1))
        return i


_FUNCTION = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}


def read(texts: list, words: Words):
    """(hashes of all words, flat; words a text; language a text)."""
    if len(words) > Words.LIMIT:
        words.reset()
    flat: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.lower().split() if text else []
        counts[i] = len(own)
        flat += own
    ids = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
    grams = np.array(words.grams, np.int32).reshape(-1, GRAMS)
    lang = np.array(words.lang, np.int64)
    said = lang[ids] if len(ids) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)[said >= 0]
    tally = np.bincount(doc * len(LANGUAGES) + said[said >= 0], minlength=len(texts) * len(LANGUAGES)).reshape(len(texts), -1)
    return ids, grams, counts, tally.argmax(1)


class Model:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(0)
        self.shift = np.zeros(len(LANGUAGES))
        self.prior = 0.0  # the score of a text without words

    def begin(self, log_odds: np.ndarray) -> None:
        """The first dimension as log-odds, seen by the first filter of each width."""
        self.table[:, 0] = log_odds
        for f in self.filters:
            f[:, 1:, 0] = 0
            f[:, 0, 0] = 1 / len(f)
        self.out[::FILTERS] = 0.5

    def forward(self, vectors: np.ndarray, counts: np.ndarray):
        """(pooled answers, where each was found) for texts laid out one after another, each followed by two blanks."""
        ends = np.cumsum(counts + 2)
        starts = ends - counts - 2
        pooled, places = [], []
        for f, b, w in zip(self.filters, self.bias, WIDTHS, strict=True):
            n = len(vectors) - w + 1
            answers = vectors[:n] @ f[0]
            for j in range(1, w):
                answers += vectors[j : n + j] @ f[j]
            # A window may end in a text's blanks; it begins at one of its words or, without any, at a blank.
            stops = np.maximum(starts + 1, ends - 2)
            top = np.empty((len(counts), answers.shape[1]), np.float32)
            at = np.empty(top.shape, np.int64)
            for k, (s, e) in enumerate(zip(starts, stops, strict=True)):
                own = answers[s:e]
                at[k] = own.argmax(0) + s
                top[k] = answers[at[k], np.arange(answers.shape[1])]
            pooled.append(top + b)
            places.append(at)
        return np.concatenate(pooled, 1), places

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        total = self.table[grams[:, 0]].copy()
        for k in range(1, GRAMS):
            total += self.table[grams[:, k]]
        return total / GRAMS

    def logits(self, ids, grams, counts) -> np.ndarray:
        """Of texts given as flat word numbers."""
        word = self.vectors(grams) if len(grams) else np.zeros((1, DIM), np.float32)
        total = len(ids) + 2 * len(counts)
        flat = np.zeros((total, DIM), np.float32)
        ends = np.cumsum(counts + 2)
        place = np.ones(total, bool)
        place[ends - 1] = place[ends - 2] = False
        if len(ids):
            flat[place] = word[ids]
        pooled, _ = self.forward(flat, counts)
        return np.maximum(pooled, 0) @ self.out + self.base


def fit(texts: list, labels: np.ndarray, weights: np.ndarray, held: np.ndarray, seed: int = 5) -> Model:
    """A model of texts and labels (0, 1); rows held only calibrate; weights restore the labels' own mix there."""
    words = Words()
    ids, grams, counts, lang = read(texts, words)
    starts = np.cumsum(counts) - counts
    model = Model(seed)
    train = np.flatnonzero(~held)
    if not len(train):
        train = np.arange(len(labels))
    seen = np.zeros((2, ROWS))
    for i in train:
        own = np.unique(grams[np.unique(ids[starts[i] : starts[i] + counts[i]])])
        seen[labels[i], own] += 1
    model.begin(np.log((seen[1] + 2) / (seen[0] + 2)).astype(np.float32) * (np.arange(ROWS) > 0))
    rng = np.random.default_rng(seed)
    squares: dict = {}

    def step(name, value, grad, rate=0.05):
        squares[name] = squares.get(name, 0.0) + grad * grad
        value -= (rate * grad / (np.sqrt(squares[name]) + 1e-6)).astype(np.float32)

    table_squares = np.zeros((ROWS, DIM), np.float32)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            own = [ids[starts[i] : starts[i] + counts[i]] for i in part]
            n = counts[part]
            used, inverse = np.unique(np.concatenate(own), return_inverse=True)
            flat_grams = np.zeros((len(inverse) + 2 * len(part), GRAMS), np.int32)
            ends = np.cumsum(n + 2)
            place = np.ones(len(flat_grams), bool)
            place[ends - 1] = place[ends - 2] = False
            flat_grams[place] = grams[used][inverse]
            vectors = np.zeros((len(flat_grams), DIM), np.float32)
            vectors[place] = model.vectors(grams[used])[inverse]
            pooled, places = model.forward(vectors, n)
            active = np.maximum(pooled, 0)
            logit = active @ model.out + model.base
            error = (1 / (1 + np.exp(-logit)) - labels[part]) / len(part)
            back = error[:, None] * model.out[None, :] * (pooled > 0)
            touched = np.zeros_like(vectors)
            grads = []
            for k, (f, w) in enumerate(zip(model.filters, WIDTHS, strict=True)):
                g, at = back[:, k * FILTERS : (k + 1) * FILTERS], places[k]
                df = np.zeros_like(f)
                for j in range(w):
                    df[j] = np.einsum("bfd,bf->df", vectors[at + j], g)
                    np.add.at(touched, (at + j).ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                grads.append((f"f{k}", f, df, f"b{k}", model.bias[k], g.sum(0)))
            step("out", model.out, active.T @ error + 1e-4 * model.out)
            base = np.array([model.base])
            step("base", base, np.array([error.sum()]))
            model.base = base[0]
            for a, f, df, c, b, db in grads:
                step(a, f, df)
                step(c, b, db)
            hit = np.flatnonzero(np.abs(touched).sum(1))
            if len(hit):
                rows = flat_grams[hit].ravel()
                change = np.repeat(touched[hit] / GRAMS, GRAMS, axis=0)
                at, where = np.unique(rows, return_inverse=True)
                total = np.zeros((len(at), DIM), np.float32)
                np.add.at(total, where, change)
                table_squares[at] += total * total
                model.table[at] -= 0.05 * total / (np.sqrt(table_squares[at]) + 1e-6)
                model.table[0] = 0
    left = np.flatnonzero(held)
    if len(left) and 0 < labels[left].sum() < len(left):
        at = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in left]) if len(left) else np.zeros(0, np.int64)
        logit = model.logits(ids[at], grams, counts[left])
        y, w, own = labels[left], weights[left], lang[left]
        general = best_cut(logit, y, w)
        for k in range(len(LANGUAGES)):
            mine = own == k
            enough = min(y[mine].sum(), (1 - y[mine]).sum()) >= FEW
            model.shift[k] = best_cut(logit[mine], y[mine], w[mine]) if enough else general
    return model


def best_cut(logit: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The logit above which calling a text toxic gives the best F1; among equals, the middle one."""
    order = np.argsort(-logit, kind="stable")
    hit, wrong = np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
    f1 = 2 * hit / (hit + wrong + (w * y).sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[len(best) // 2]
    below = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] - 1
    return float((logit[order[k]] + below) / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model fitted on a bounded sample of the labelled documents that are not held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    totals = dict(known.groupBy("toxic").count().collect())
    if len(totals) < 2:
        return None
    draw = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == c).orderBy(draw, "doc_id").limit(per_class) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1]).withColumn("held", F.pmod(draw, F.lit(5)) == 0)  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_CHARS).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"), F.first("held").alias("held"))

    def fitted(batches):
        """The model of all rows, pickled; the rows are the bounded sample, so one task holds them and no text goes to the driver."""
        texts, y, held = [], [], []
        for batch in batches:
            texts += [None if t is None else t.decode("utf-8", "replace") for t in binaries(batch.column(0))]
            y += batch.column(1).to_pylist()
            held += batch.column(2).to_pylist()
        y = np.array(y, np.int64)
        if not len(y) or y.min() == y.max():
            return
        weights = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, y, weights, np.array(held, bool)))], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic", "held").mapInArrow(fitted, "model binary").collect()
    if not found:
        return None
    model = pickle.loads(found[0]["model"])
    model.prior = min(THRESHOLD / 2, totals[1] / (totals[0] + totals[1]))
    return model


class Judge:
    """Scores texts with a model; lives in a worker."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.level = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def scores(self, raw: list) -> np.ndarray:
        out = []
        for a, b in slices(raw, 1 << 20):
            ids, grams, counts, lang = read([None if t is None else t.decode("utf-8", "replace") for t in raw[a:b]], self.words)
            used, at = np.unique(ids, return_inverse=True)
            x = self.model.logits(at, grams[used], counts) - self.model.shift[lang] + self.level
            own = 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -500, 500)))
            out.append(np.where(counts > 0, own, self.model.prior))
        return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # ROWS x DIM floats, whatever the input

    def run(batches):
        judge = Judge(shipped.value)
        for batch in batches:
            s = judge.scores(binaries(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic, in one pass that moves no text; all columns stay."""
    model = train(docs, labels)
    if model is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        judge = Judge(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array(judge.scores(binaries(batch.column(at))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
