"""Line dedup (operator 7): segment-partition edit join of lines.

A line of at least `MIN_CHARS` characters (white space at its ends aside) is dropped
where an earlier line, by (doc_id, place), is within `EDITS` edits. A shorter one, in
which two edits can make another word of any, is dropped where an earlier line is
equal, from a length of `shortest` characters on: 1 for the queries, so that of all
equal lines only the first stays. Blank lines stay. Equal lines are found by their hash. Distinct lines are split into EDITS + 1 segments
of almost equal length: of two lines within EDITS edits, one holds some segment of the
other whole, within a few places of where it was. Every line is indexed by its
segments and asks, for each length within EDITS, for the substrings at those places
(multi-match-aware: no more than the edits on both sides allow). Candidates are
verified by a banded bit-parallel automaton.

Pieces are hashed by sums of powers over a whole batch of lines, so that any substring
costs two look-ups; pieces that no other line can have are dropped where they arise, by
bounded bit filters of the index, and nothing else is.

Whether a line goes depends on one earlier line near it, so each line first meets the
earliest line of its buckets, and what is settled asks no more. Lines still open whose
buckets hold others meet these by rare q-grams: of lines within `EDITS` edits, each
lacks at most `EDITS` * `GRAM` distinct q-grams of the other, so in any one order of all
q-grams the first `EDITS` * `GRAM` + 1 of both have one in common; the order is by
frequency, rare ones first. One of those common q-grams is where it was but for
`EDITS` places, so q-grams that both lines have once must be near in place. An edit
takes and adds two pairs of neighbouring characters at most, so the parities of their
counts in `PARITIES` bins differ in at most 4 `EDITS` bins. A popular line or template thus costs one comparison a line,
and its variants meet only those that share what is rare in them.

Defined results: null and empty texts have no lines and stay as they are; a text may
lose all its lines and is empty then; very long lines are compared whole; rows with
one doc_id are one document's, an equal line at an equal place of them is one line;
rows with a null doc_id come last in the order; ids of any type that has an order are
taken; an empty table gives no rows; other columns don't matter, whatever their names.
"White space at its ends" is spaces (U+0020).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U, drop_written, mix, unused, written
from tidemark.llm.jaccard import bit_filter, contains

EDITS = 2
MIN_CHARS = 30
GRAM = 4  # characters of a q-gram
PARITIES = 256  # bins of pairs of characters
COUNTERS = 1 << 20  # of q-grams by hash, whatever the input
BASE = 0x9E3779B97F4A7C15
HALF = U(32)


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most edits; one machine word of bits for the band of each error count."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))  # the common start and end can go
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    full = (1 << (2 * edits + 1)) - 1
    # Bit k of state d: the first i - edits + k characters of a are within d edits of the first i of b.
    state = [((1 << (d + 1)) - 1) << edits for d in range(edits + 1)]
    valid = [((1 << (min(len(a), d) + 1)) - 1) << edits for d in range(edits + 1)]
    state = [s & v & full for s, v in zip(state, valid, strict=True)]
    for i, c in enumerate(b):
        match = 0
        for k in range(2 * edits + 1):
            j = i - edits + k
            if 0 <= j < len(a) and a[j] == c:
                match |= 1 << k
        inside = 0
        for k in range(2 * edits + 1):
            if 0 <= i + 1 - edits + k <= len(a):
                inside |= 1 << k
        new = [state[0] & match & inside]
        for d in range(1, edits + 1):
            new.append(((state[d] & match) | (state[d - 1] >> 1) | state[d - 1] | (new[d - 1] << 1)) & inside & full)
        state = new
        if not state[-1]:
            return False
    end = len(a) - len(b) + edits
    return 0 <= end <= 2 * edits and bool(state[-1] >> end & 1)


def cuts(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line; the last ones are a character longer."""
    parts = edits + 1
    short, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def pieces(lengths: np.ndarray, edits: int = EDITS):
    """(start, size) of each of the edits + 1 segments, for many lengths; as `cuts`."""
    parts = edits + 1
    short, longer = lengths // parts, lengths % parts
    at = np.zeros(len(lengths), np.int64)
    for i in range(parts):
        size = short + (i >= parts - longer)
        yield at, size
        at = at + size


POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n at least; the worker keeps those of its longest layout so far of at most 2 ** 21 characters."""
    kept = POWERS.get(base)
    if kept is None or len(kept) <= n:
        kept = np.cumprod(np.concatenate([[U(1)], np.full(n, U(base))]))
        if n <= 1 << 21:
            POWERS[base] = kept
    return kept


MIXED = mix(np.arange(1 << 16, dtype=U) + U(1))  # of the characters of the basic plane


class Text:
    """Lines laid out one after another, with hashes of all their substrings at hand."""

    def __init__(self, lines: list[str]):
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.length) - self.length
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(codes)
        self.back = powers(pow(BASE, -1, 1 << 64), n)
        mixed = MIXED[codes] if not n or codes.max() < len(MIXED) else mix(codes.astype(U) + U(1))
        self.sums = np.zeros(n + 1, U)
        np.cumsum(mixed * powers(BASE, n)[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the substrings of `size` characters from each place of the layout."""
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def signatures(self, line: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, part: int) -> np.ndarray:
        """Of substrings of some lines, as the given segment of a line of a length."""
        return mix(self.hashes(self.start[line] + at, size) ^ (length.astype(U) * U(16) + U(part)) * U(0xD6E8FEB86659FD93))

    def index(self, edits: int = EDITS):
        """(line, signature) of the segments of all lines."""
        every = np.arange(len(self.length))
        for i, (at, size) in enumerate(pieces(self.length, edits)):
            yield every, self.signatures(every, at, size, self.length, i)

    def asked(self, edits: int = EDITS):
        """(line, signature, whether it is a segment of the line itself) of the substrings by which a line of any near length may be found."""
        for d in range(-edits, edits + 1):
            length = self.length + d
            for i, (start, size) in enumerate(pieces(np.maximum(length, 0), edits)):
                # i edits at most lie to the left of the first equal segment, edits - i to its right.
                low = np.maximum(np.maximum(0, start - i), start - d - (edits - i))
                high = np.minimum(np.minimum(self.length - size, start + i), start - d + (edits - i))
                for k in range(-i, i + 1):
                    at = start + k
                    own = np.flatnonzero((low <= at) & (at <= high) & (length > 0))
                    if len(own):
                        yield own, self.signatures(own, at[own], size[own], length[own], i), d == 0 and k == 0

    def grams(self):
        """(line, hash, place) of the distinct q-grams of all lines, sorted by line; place -1: there are several; a line shorter than one is one."""
        size = np.minimum(self.length, GRAM)
        count = self.length - size + 1
        line = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
        value = mix(self.hashes(self.start[line] + at, size[line]))
        order = np.lexsort((value, line))
        line, value, at = line[order], value[order], at[order]
        first = np.ones(len(line), bool)
        first[1:] = (line[1:] != line[:-1]) | (value[1:] != value[:-1])
        alone = np.ones(len(line), bool)
        alone[:-1] = first[1:]
        return line[first], value[first], np.where(alone, at, -1)[first]


    def parities(self) -> np.ndarray:
        """(lines, PARITIES / 64): bits that tell whether a bin's pairs of neighbouring characters are odd in number."""
        count = np.maximum(self.length - 1, 0)
        line = np.repeat(np.arange(len(count)), count)
        at = self.start[line] + np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
        bins = (mix(self.hashes(at, np.full(len(at), 2))) % U(PARITIES)).astype(np.int64)
        odd = np.bincount(line * PARITIES + bins, minlength=len(count) * PARITIES).astype(np.uint8) & 1
        return np.packbits(odd.reshape(-1, PARITIES), axis=1).view(np.int64)


def parts_of(batch: pa.RecordBatch, column: int, limit: int = 1 << 20):
    """(first row, lines) of a batch in parts of about `limit` characters."""
    lines, start, size = batch.column(column).to_pylist(), 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= limit or i + 1 == len(lines):
            yield start, lines[start : i + 1]
            start, size = i + 1, 0


def occurrences(docs: DataFrame, text: bool, shortest: int) -> DataFrame:
    """(o, h1, h2[, line]) of all lines long enough, without blank ones; o: their place in the order."""
    id_ = F.col("doc_id")
    rows = docs.select(id_.isNull().alias("nil"), id_.alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    rows = rows.select(F.struct("nil", "id", "pos").alias("o"), F.trim("raw").alias("line")).where((F.length("line") >= shortest) & F.col("line").rlike(r"\S"))
    return rows.select("o", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *([F.col("line")] if text else []))


def two_bits(values: DataFrame, count: int) -> np.ndarray:
    """Filter of signatures (sig) by two bits each, at the leading bits of both halves; see `held`."""
    turned = F.shiftleft("sig", 32).bitwiseOR(F.shiftrightunsigned("sig", 32))
    return bit_filter(values.select(F.explode(F.array("sig", turned)).alias("sig")), "sig", count)


def held(bits: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Whether each signature passes a filter of two bits; all those in it do."""
    keep = contains(bits, sig)
    some = np.flatnonzero(keep)
    keep[some] = contains(bits, sig[some] << HALF | sig[some] >> HALF)
    return keep


def near(lines: DataFrame) -> DataFrame:
    """(lid) of the distinct lines (lid, o, line) that are near an earlier one; lines: a written table."""
    spark = lines.sparkSession
    rows = lines.select("lid", "o", "line")
    kind = lines.schema["o"].dataType.simpleString()
    schema = f"sig long, lid long, o {kind}"

    def sigs(batches):
        for batch in batches:
            for _, own in parts_of(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig for _, sig in Text(own).index()]).view(np.int64))], ["sig"])

    def verify(batches):
        for batch in batches:
            keep = [within(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["lid"]).filter(pa.array(keep, pa.bool_()))

    def settled(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        texts = texts.select("lid", "line")
        both = pairs.join(texts.withColumnRenamed("line", "x"), "lid").join(texts.select(F.col("lid").alias("other"), F.col("line").alias("y")), "other")
        return written(both.select("lid", "x", "y").mapInArrow(verify, "lid long").distinct())

    member = F.struct("o", "lid")
    sizes = written(lines.select("line").mapInArrow(sigs, "sig long").groupBy("sig").agg((F.count("*") > 1).alias("shared")))
    # Another line's segment may be any of the index; a line's own counts only where another has it too.
    n, n_shared = sizes.agg(F.count("*"), F.count_if("shared")).first()
    known = spark.sparkContext.broadcast((bit_filter(sizes, "sig", n), two_bits(sizes.where("shared"), n_shared)))
    drop_written(sizes)

    def probe_rows(batches):
        any_, company = known.value
        for batch in batches:
            for start, own in parts_of(batch, 2):
                found = []
                for line, sig, mine in Text(own).asked():
                    keep = held(company, sig) if mine else contains(any_, sig)
                    found.append((line[keep] + start, sig[keep]))
                line, sig = (np.concatenate(x) for x in zip(*found, strict=True))
                at = pa.array(line)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["sig", "lid", "o"])

    asks = written(rows.mapInArrow(probe_rows, schema))
    known.unpersist()
    asked = asks.select("sig").distinct()
    wanted = spark.sparkContext.broadcast(two_bits(asked, asks.count()))

    def index_rows(batches):
        for batch in batches:
            for start, own in parts_of(batch, 2):
                for line, sig in Text(own).index():
                    keep = held(wanted.value, sig)
                    at = pa.array(line[keep] + start)
                    yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["sig", "lid", "o"])

    index = written(rows.mapInArrow(index_rows, schema).join(asked, "sig", "left_semi"))
    wanted.unpersist()
    first = index.groupBy("sig").agg(F.min(member).alias("m"), F.count("*").alias("size"))
    hits = written(asks.join(first, "sig").where(F.col("m") < member).select("sig", "lid", "o", F.col("m.lid").alias("other"), "size"), asks)
    texts = chosen(rows, hits.select("lid").unionAll(index.join(hits.select("sig").distinct(), "sig", "left_semi").select("lid")))
    gone = settled(hits.select("lid", "other").distinct(), texts)
    # A bucket of one is done with its earliest line; others go on for the lines not yet settled.
    open_ = written(hits.where("size > 1").join(gone, "lid", "left_anti").select("sig", "lid"), hits)
    if open_.isEmpty():
        drop_written(open_, index, texts)
        return gone
    members = index.join(open_.select("sig").distinct(), "sig", "left_semi").select("lid")
    asking = open_.select("lid", F.lit(True).alias("asks"))
    involved = members.select("lid", F.lit(False).alias("asks")).unionAll(asking).groupBy("lid").agg(F.max("asks").alias("asks"))
    involved = written(texts.join(involved, "lid"), open_, index)
    pairs = written(by_rare_grams(involved))
    left = settled(pairs, texts)
    drop_written(involved, pairs, texts)
    return gone.unionAll(left)


def chosen(lines: DataFrame, lids: DataFrame) -> DataFrame:
    """The lines (lid, o, line) with one of the lids, and few others: no text of the rest is shuffled."""
    lids = written(lids.distinct())
    bits = lines.sparkSession.sparkContext.broadcast(bit_filter(lids.select(F.xxhash64("lid").alias("key")), "key", lids.count() << 3))
    drop_written(lids)

    def run(batches):
        for batch in batches:
            yield batch.select(names).filter(pa.array(contains(bits.value, batch.column(0).to_numpy(zero_copy_only=False).view(U))))

    names = ["lid", "o", "line"]
    kind = lines.schema["o"].dataType.simpleString()
    out = written(lines.select(F.xxhash64("lid").alias("key"), *names).mapInArrow(run, f"lid long, o {kind}, line string"))
    bits.unpersist()
    return out


def by_rare_grams(lines: DataFrame) -> DataFrame:
    """(lid, other): pairs of a line (lid, o, line, asks) that asks and an earlier one, all those within EDITS edits among them."""
    spark = lines.sparkSession
    kind = lines.schema["o"].dataType.simpleString()

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, own in parts_of(batch, 0):
                _, value, _ = Text(own).grams()
                total += np.bincount((value % U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = lines.select("line").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    often = np.zeros(COUNTERS, np.int64)
    often[found["at"].to_numpy()] = found["n"].to_numpy()
    shipped = spark.sparkContext.broadcast(often)

    def rare(batches):
        often, lacks = shipped.value, EDITS * GRAM
        for batch in batches:
            for start, own in parts_of(batch, 2):
                text = Text(own)
                line, value, place = text.grams()
                odd = text.parities()
                order = np.lexsort((value, often[(value % U(COUNTERS)).astype(np.int64)], line))
                line, value, place = line[order], value[order], place[order]
                count = np.bincount(line, minlength=len(own))
                nth = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
                keep = nth <= lacks
                # Lines of few distinct q-grams may have none in common: they meet by length.
                few = np.flatnonzero(count <= 2 * lacks)
                line = np.concatenate([line[keep], few])
                value = np.concatenate([value[keep], np.zeros(len(few), U)])
                place = np.concatenate([place[keep], np.full(len(few), -1)])
                at = pa.array(line + start)
                size = np.fromiter(map(len, own), np.int64, len(own))[line]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(size), pa.array(place), *(batch.column(k).take(at) for k in (0, 1, 3)), *(pa.array(odd[line, k]) for k in range(odd.shape[1]))], names)

    bits = [f"odd{k}" for k in range(PARITIES // 64)]
    names = ["gram", "size", "place", "lid", "o", "asks", *bits]
    rows = lines.select("lid", "o", "line", "asks").mapInArrow(rare, f"gram long, size long, place long, lid long, o {kind}, asks boolean, {', '.join(f'{b} long' for b in bits)}")
    asks = rows.where("asks").select("gram", F.explode(F.sequence(F.col("size") - EDITS, F.col("size") + EDITS)).alias("size"), "place", "lid", "o", *bits)
    earlier = rows.select("gram", "size", F.col("place").alias("_place"), F.col("lid").alias("other"), F.col("o").alias("_o"), *[F.col(b).alias(f"_{b}") for b in bits])
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"_{b}"))) for b in bits), F.lit(0))
    there = (F.least("place", "_place") < 0) | (F.abs(F.col("place") - F.col("_place")) <= EDITS)
    both = (F.col("gram") == F.col("_gram")) & (F.col("size") == F.col("_size"))
    earlier = earlier.withColumnsRenamed({"gram": "_gram", "size": "_size"})
    return asks.join(earlier, both & there & (apart <= 4 * EDITS) & (F.struct("_o", "other") < F.struct("o", "lid"))).select("lid", "other").distinct()


def dropped(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """(id, places): places of the lines that go, of each document with any."""
    hashes = ["h1", "h2"]
    first = written(occurrences(docs, True, shortest).groupBy(*hashes).agg(F.min(F.struct("o", "line")).alias("f"), F.count("*").alias("n")).select(*hashes, "f.o", "f.line", "n", F.monotonically_increasing_id().alias("lid")))
    long_ = first.where(F.length("line") >= MIN_CHARS)
    gone = near(long_)
    lost = first.join(gone, "lid").select("o")
    repeated = first.where("n > 1").select(*hashes, F.col("o").alias("_o"))
    copies = occurrences(docs, False, shortest).join(repeated, hashes).where("o <> _o").select("o")
    places = F.collect_set("o.pos").alias("places")  # a document's own lines at most
    return written(copies.unionAll(lost).groupBy("o.id").agg(places), first, gone)


def dedup(docs: DataFrame, shortest: int = MIN_CHARS) -> tuple[DataFrame, str, str]:
    """docs with text without the lines that go, and the names of two further columns: number of lines, of those dropped."""
    id_, places, n_lines, n_dropped = (unused(c, docs) for c in ("_id", "_places", "_n_lines", "_n_dropped"))
    gone = dropped(docs.select("doc_id", "text"), shortest).select(F.col("id").alias(id_), F.col("places").alias(places))
    # Half of all documents may lose lines, too many to broadcast: the texts are shuffled once, at any size.
    rows = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & F.col(places).isNotNull(), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(places, s["i"]))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    counted = rows.withColumn(n_lines, count(lines)).withColumn(n_dropped, count(F.col(places)))
    return counted.withColumn("text", text).select(*docs.columns, n_lines, n_dropped), n_lines, n_dropped


def report(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of all documents."""
    rows, n_lines, n_dropped = dedup(docs.select("doc_id", "text"), shortest)
    return rows.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), "text")


def deduplicated(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """docs with the lines left; documents that lost all their words go, n_chars is counted anew, all columns stay."""
    rows, _, n_dropped = dedup(docs, shortest)
    rows = rows.where((F.col(n_dropped) <= 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
