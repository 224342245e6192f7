"""Benchmark decontamination (operator 4): hash-joined template windows.

A text's tokens become a template: numbers, names (capitalised words that don't
begin a sentence) and units after a number turn into typed placeholders, other
words keep their letters. Every window of `WINDOW` template tokens of a benchmark
item is indexed by its hash; every window of every document is looked up. So are two
more templates: one in which a capitalised word that begins a sentence is a name too
(names come there as well), one without names, of case-folded words (capitals come
in any text). Hits on one diagonal (document position less item position) are joined
to runs: there a token is the item's word in any case, or a number, unit or
capitalised word for another. The slots must be consistent: one value of the item
always stands for the same value in the document, and different values for different
ones; of a run in which they are not, the longest part in which they are counts. A run of `MIN_RUN` tokens, or of the whole of a
shorter item, is a leak, whether the slots' values are the same (exact) or not.

The items are a query set: they are taken in blocks of bounded size, each block
broadcast and run against all documents, so an index of any size works.

Defined results: null, empty and very short texts match nothing; items without a
window of at least `MIN_LITERALS` literal words are compared through the windows
that have them, and if there is none they match nothing; a repeated item id or
document row gives a row for each; documents are read whole.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import U, binaries, mix, slices, written

WINDOW = 8
MIN_LITERALS = 4
MIN_RUN = 13
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32_000_000
SLICE = 1 << 20  # bytes of text that are looked up at a time

# Units that may follow a number.
UNITS = set("""
    mm cm m km inch inches foot feet ft yard yards mile miles mg g kg t lb lbs oz ton tons tonne tonnes ml cl l litre litres liter liters gallon gallons
    second seconds sec s minute minutes min hour hours h day days week weeks month months year years
    dollar dollars cent cents euro euros pound pounds usd eur percent degrees kmh mph watt watts volt volts kb mb gb tb
""".split())

NUMBER, NAME, UNIT = 1, 2, 3
TEMPLATES = 3
CAPITAL, ENDS, DIGIT, MEASURE, WORD = 1, 2, 4, 8, 16
STRIP = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
NUMBER_WORD = regex.compile(r"^\p{N}[\p{N}.,:/%-]*$")


class Tokens(dict):
    """Small integer of each distinct raw token; rows of the tables beside it tell its form."""

    LIMIT = 1 << 18

    def __init__(self):
        super().__init__()
        self.words: list[str] = []
        self.hashes = array("Q")
        self.flags = array("B")

    def __missing__(self, raw: str) -> int:
        import xxhash

        word = STRIP.sub("", raw)
        low = word.casefold()
        flags = WORD if word else 0
        if word[:1].isupper():
            flags |= CAPITAL
        if raw[-1] in ".!?:" or (not word):
            flags |= ENDS
        if NUMBER_WORD.match(word):
            flags |= DIGIT
        if low in UNITS:
            flags |= MEASURE
        i = self[raw] = len(self.words)
        self.words.append(low)
        self.hashes.append(xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")))
        self.flags.append(flags)
        return i


def template(texts: list, tokens: Tokens):
    """Flat ids, word hashes, slot kinds by the three templates and each text's token count; tokens without letters or digits are left out.

    Kinds of the first template: names within a sentence; of the second: names at its start too; of the third: no names.
    """
    if len(tokens) > Tokens.LIMIT:
        tokens.__init__()
        tokens.clear()
    flat: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = text.replace("\n", " . ").split()  # a line ends a sentence
            counts[i] = len(own)
            flat += own
    ids = np.fromiter(map(tokens.__getitem__, flat), np.int64, len(flat))
    hashes, flags = np.array(tokens.hashes, U), np.array(tokens.flags, np.uint8)
    own, form = hashes[ids] if len(ids) else np.zeros(0, U), flags[ids] if len(ids) else np.zeros(0, np.uint8)
    begins = np.ones(len(ids), bool)
    begins[1:] = (form[:-1] & ENDS) > 0
    starts = np.cumsum(counts) - counts
    begins[starts[counts > 0]] = True
    word = (form & WORD) > 0
    doc = np.repeat(np.arange(len(texts)), counts)
    ids, own, form, begins, doc = ids[word], own[word], form[word], begins[word], doc[word]
    digit, capital = (form & DIGIT) > 0, (form & CAPITAL) > 0
    after = np.zeros(len(ids), bool)
    after[1:] = digit[:-1] & (doc[1:] == doc[:-1])
    after &= (form & MEASURE) > 0
    kinds = np.zeros((TEMPLATES, len(ids)), np.uint8)
    kinds[0, capital & ~begins] = NAME
    kinds[1, capital] = NAME
    kinds[:, digit] = NUMBER
    kinds[:, after] = UNIT
    return ids, own, kinds, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def mixed(own: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Hashes of the tokens of a template."""
    return mix(np.where(kind > 0, kind.astype(U), own))


def window_hashes(x: np.ndarray, size: int, place: np.ndarray | None = None) -> np.ndarray:
    """Hash of the window that starts at each place of a flat array, or at some (the last size-1 places have none)."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n if place is None else len(place), U)
    for k in range(size):
        total = (total ^ (x[k : k + n] if place is None else x[place + k])) * U(0x9E3779B97F4A7C15)
        total ^= total >> U(29)
    return total


class Index:
    """Windows of a bounded block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]]):
        tokens = Tokens()
        ids, own, kinds, counts = template([t for _, t in items], tokens)
        starts = np.cumsum(counts) - counts
        self.items = [i for i, _ in items]
        self.words = [[tokens.words[j] for j in ids[s : s + c]] for s, c in zip(starts, counts, strict=True)]
        self.own = [own[s : s + c] for s, c in zip(starts, counts, strict=True)]
        self.kinds = [kinds[:, s : s + c] for s, c in zip(starts, counts, strict=True)]
        found: dict[int, set] = {}
        for k, (o, forms) in enumerate(zip(self.own, self.kinds, strict=True)):
            size = min(WINDOW, len(o))
            if size == 0:
                continue
            for kind in forms:
                for at, h in enumerate(window_hashes(mixed(o, kind), size)):
                    if np.count_nonzero(kind[at : at + size] == 0) >= min(MIN_LITERALS, size):
                        found.setdefault(size, set()).add((int(h), k, at))
        self.sizes = {}
        for size, rows in found.items():
            rows = sorted(rows)
            keys = np.array([r[0] for r in rows], U)
            near = np.zeros(1 << 20, bool)
            near[(keys & U((1 << 20) - 1)).astype(np.int64)] = True
            self.sizes[size] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), near)

    def look_up(self, own: np.ndarray, kinds: np.ndarray, doc: np.ndarray):
        """(place in the flat array, item, place in the item) of every window of a document that is indexed."""
        forms = [mixed(own, kind) for kind in kinds]
        other = [np.concatenate([[0], np.cumsum(x != forms[0])]) for x in forms[1:]]
        for size, (keys, item, at, near) in self.sizes.items():
            n = len(own) - size + 1
            if n <= 0:
                continue
            whole = doc[:n] == doc[size - 1 :]
            for x, differs in zip(forms, [None, *other], strict=True):
                # Only where a window isn't the same by the first template.
                some = None if differs is None else np.flatnonzero(whole & (differs[size:] > differs[:n]))
                h = window_hashes(x, size, some)
                seen = near[(h & U((1 << 20) - 1)).astype(np.int64)]
                place = np.flatnonzero(seen & whole) if some is None else some[seen]
                h = h[place] if some is None else h[seen]
                low = np.searchsorted(keys, h, "left")
                high = np.searchsorted(keys, h, "right")
                for p, a, b in zip(place[high > low], low[high > low], high[high > low], strict=True):
                    for j in range(a, b):
                        yield int(p), int(item[j]), int(at[j])


def consistent(kinds, item_words: list[str], doc_words: list[str]) -> tuple[int, bool]:
    """Tokens of the longest part of a run in which slots stand for each other one to one, and whether all its values are the same.

    kinds: by the first and the second template. A sentence's first word is a slot
    where the document has another one. Of parts of one length, one of the same values.
    """
    there: dict = {}
    back: dict = {}
    rows = list(zip(*kinds[:2].tolist(), item_words, doc_words, strict=True))
    best, low, other = (0, False), 0, 0
    for high, (within, kind, a, b) in enumerate(rows):
        if within or a != b:
            x, y = (kind, a), (kind, b)
            while there.get(x, (b,))[0] != b or back.get(y, (a,))[0] != a:
                out, form, c, d = rows[low]
                low += 1
                if out or c != d:
                    other -= c != d
                    for known, key, value in ((there, (form, c), d), (back, (form, d), c)):
                        left = known.pop(key)[1] - 1
                        if left:
                            known[key] = (value, left)
            there[x] = (b, there.get(x, (b, 0))[1] + 1)
            back[y] = (a, back.get(y, (a, 0))[1] + 1)
            other += a != b
        best = max(best, (high + 1 - low, not other))
    return best


def leaks_of(index: Index, texts: list, tokens: Tokens):
    """(text number, item number, tokens matched, item tokens, exact) of the leaks in some texts."""
    ids, own, forms, counts = template(texts, tokens)
    doc = np.repeat(np.arange(len(texts)), counts)
    starts = np.cumsum(counts) - counts
    diagonals: dict = {}
    for place, item, at in index.look_up(own, forms, doc):
        diagonals.setdefault((int(doc[place]), item, place - at), []).append(at)
    slots = forms[1]  # all that may be slots
    best: dict = {}
    for (d, item, shift), hits in diagonals.items():
        theirs, kinds, words = index.own[item], index.kinds[item], index.words[item]
        low, high = max(0, int(starts[d]) - shift), min(len(theirs), int(starts[d] + counts[d]) - shift)
        equal = own[shift + low : shift + high] == theirs[low:high]
        equal |= (slots[shift + low : shift + high] == kinds[1, low:high]) & (kinds[1, low:high] > 0)
        done = -1
        for at in sorted(hits):
            if at < done:
                continue
            a = at
            while a > low and equal[a - 1 - low]:
                a -= 1
            b = at
            while b < high and equal[b - low]:
                b += 1
            done = b
            if b - a < min(MIN_RUN, len(theirs)):
                continue
            n, same = consistent(kinds[:, a:b], words[a:b], [tokens.words[j] for j in ids[shift + a : shift + b]])
            if n >= min(MIN_RUN, len(theirs)):
                best[d, item] = max(best.get((d, item), (0, False)), (n, same))
    return [(d, item, n, len(index.own[item]), same) for (d, item), (n, same) in best.items()]


def blocks(benchmark: DataFrame):
    """The items in blocks of bounded number and size; one block at a time is on the driver."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


SCHEMA = "doc_id {doc}, item_id {item}, n_matched int, n_item int, exact boolean"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched, n_item, exact): documents that hold a benchmark item, re-parameterised or not."""
    spark = docs.sparkSession
    schema = SCHEMA.format(doc=docs.schema["doc_id"].dataType.simpleString(), item=benchmark.schema["item_id"].dataType.simpleString())
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for items in blocks(benchmark):
        shipped = spark.sparkContext.broadcast(Index(items))

        def run(batches, shipped=shipped):
            index, tokens = shipped.value, Tokens()
            for batch in batches:
                raw = binaries(batch.column(1))
                found = []
                for a, b in slices(raw, SLICE):
                    texts = [None if t is None else t.decode("utf-8", "replace") for t in raw[a:b]]
                    found += [(a + d, index.items[item], n, of, bool(same)) for d, item, n, of, same in leaks_of(index, texts, tokens)]
                rows = pa.array([f[0] for f in found], pa.int64())
                columns = [pa.array([f[k] for f in found], kind) for k, kind in ((1, item_type), (2, pa.int32()), (3, pa.int32()), (4, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], ["doc_id", "item_id", "n_matched", "n_item", "exact"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay."""
    # Written first, so that no text is shuffled while it is searched, nor afterwards where the ids are few enough to be broadcast.
    held = written(leaks(docs, benchmark).select(F.col("doc_id").alias("_held")).distinct())
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("_held")), "left_anti")
