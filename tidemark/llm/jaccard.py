"""N-gram Jaccard join (operator 1): universe partition, pigeonhole, exact verification.

A document's set is its distinct word shingles. Documents with equal sets form one
class, and classes are what is joined. Classes fall into size bands whose bounds grow
by 5/4, so that only equal or neighbouring bands can link. For each band, a hash deals
the universe of shingles into a fixed number of segments. A class of n shingles and a
partner no larger than it differ in at most 2n/9 shingles if they link (similarity
0.8), so of any floor(2n/9)+1 segments at least one is equal in both. There are a
quarter more segments than that; a class is a candidate only through the cheapest of
them: segments that no other class has cost nothing and are taken first, then those
with the fewest rows. A common passage therefore costs nothing to most documents.

Pairs of one bucket are never all formed at once: each class is first compared with
two classes of each of its buckets, what links becomes one component, and only
buckets that still hold several components are searched on, across components alone;
once that no longer halves the work, they are searched whole.
A candidate is verified on the whole sets, unless the
parities of their numbers of shingles in `PARITIES` bins show more shingles of one set
alone than a link allows, a condition that all links meet. No class is left out by this, so the
components are those of the complete link graph.

Defined results: null and empty texts have size 0 and are their own component; fewer
words than a shingle make one shingle; repeated rows give repeated results, since they
are equal sets; a null doc_id is never the name of a component unless all its
members have none; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U, bucket_count, by_block, drop_written, hashed_column, mix, pack, range_of, unpack, unused, written

WORDS = 5
STARS = 4  # passes by two representatives a bucket before buckets are searched whole
WORK = 8  # a whole search begins once it makes at most so many pairs a bucket row
RANGE = 2_000_000  # segment hashes that are counted at a time
PARITIES = 512  # bins of shingles
BITS = (20, 28)  # least and greatest log2 of the filter's bits, at most 32 MB


def bands(upto: int) -> list[tuple[int, int]]:
    """Size bands (first, last): last is floor(5/4 first), so a link spans at most two of them."""
    out, low = [], 1
    while low <= upto:
        out.append((low, low * 5 // 4))
        low = out[-1][1] + 1
    return out


BANDS = bands(1 << 40)
FIRST = np.array([b[0] for b in BANDS], np.int64)


def segments_of(band: int) -> int:
    """Segments of a band: a quarter more than its largest class needs."""
    need = 2 * BANDS[band][1] // 9 + 1
    return need + (need + 3) // 4


SEGMENTS = np.array([segments_of(b) for b in range(len(BANDS))], np.int64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after another, and their numbers."""
    flat, n = hashed_column(texts)
    x = mix(flat)
    starts = np.cumsum(n) - n
    size = np.minimum(n, words)
    count = np.where(n > 0, n - size + 1, 0)
    total = np.repeat(size.astype(U), count)
    place = np.arange(len(total)) - np.repeat(np.cumsum(count) - count - starts, count)
    wide = np.repeat(size, count)
    all_whole = bool((wide == words).all())
    for k in range(words):
        some = slice(None) if all_whole else np.flatnonzero(wide > k)
        step = (total[some] ^ x[place[some] + k]) * U(0x9E3779B97F4A7C15)
        total[some] = step ^ (step >> U(29))
    total = mix(total)
    ends = np.cumsum(count)
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        total[a:b].sort()
    first = np.ones(len(total), bool)
    first[1:] = total[1:] != total[:-1]
    first[(ends - count)[count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    return total[first], kept[ends] - kept[ends - count]


def classes_of(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit name of each set, whatever its order; 0 for the empty set."""
    sums = np.concatenate([[U(0)], np.cumsum(mix(flat ^ U(0x632BE59BD9B4E019)), dtype=U)])
    ends = np.cumsum(n)
    total = mix(sums[ends] - sums[ends - n])
    return np.where(n > 0, mix(total ^ mix(n.astype(U)) * U(3)), U(0)).view(np.int64)


def signatures(flat: np.ndarray, n: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number a set): a hash of the shingles in each segment of the set's partition, in any order."""
    m = SEGMENTS[band]
    starts = np.cumsum(m) - m
    doc = np.repeat(np.arange(len(n)), n)
    x = mix(flat ^ (band.astype(U) * U(0x9E3779B9) + U(1))[doc])
    at = ((x >> U(32)) * m.astype(U)[doc] >> U(32)).astype(np.int64) + starts[doc]
    sums = np.zeros(int(m.sum()), U)
    np.add.at(sums, at, mix(x))
    nth = np.arange(len(sums)) - np.repeat(starts, m)
    salt = nth.astype(U) + (np.repeat(band, m).astype(U) + U(1) << U(32))
    return mix(sums ^ mix(salt)), m


ODD = [f"odd{k}" for k in range(PARITIES // 64)]


def parities(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, PARITIES / 64): bits that tell whether a bin's shingles are odd in number."""
    bins = (mix(flat ^ U(0x2545F4914F6CDD1D)) >> U(64 - PARITIES.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(n)), n) * PARITIES + bins, minlength=len(n) * PARITIES).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, PARITIES), axis=1).view(np.int64)


def may_link():
    """Whether two sets (n, odd0, ...; _n, _odd0, ...) can link: each shingle of one alone turns one bin, and a ninth of both sizes may be such."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in ODD), F.lit(0))
    return (9 * apart <= F.col("n") + F.col("_n")) & near_sizes()


def near_sizes():
    return 100 * F.least("n", "_n") >= 80 * F.greatest("n", "_n")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cid) of all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                flat, n = shingle_sets(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(classes_of(flat, n))], ["doc_id", "n", "cid"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, cid long")


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 22):
    """Slices of a batch of about `limit` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(upto[1:] != upto[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def chosen(docs: DataFrame, needed: DataFrame, count: int):
    """Filter of the rows of docs (key, text) by the document ids in needed (rep): a few others pass too."""
    keyed = needed.select(F.xxhash64("rep").alias("key"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(keyed, "key", count << 3))
    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text")

    def sets(batches):
        """(names, shingles, numbers) of the sets of some rows."""
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for part in text_slices(batch.filter(pa.array(contains(bits.value, key))), 1):
                flat, n = shingle_sets(part.column(1))
                yield classes_of(flat, n), flat, n

    return rows, sets


def segment_rows(sets, batches):
    """(set number, name, size, own band?, signatures, their set numbers) of sets that may link with others than their equals."""
    for cid, flat, n in sets(batches):
        enough = n >= 4  # 2n/9 < 1 for any partner otherwise: only equal sets link
        flat, cid, n = flat[np.repeat(enough, n)], cid[enough], n[enough]
        if not len(n):
            continue
        band = np.searchsorted(FIRST, n, "right") - 1
        for step in (0, 1):
            sig, m = signatures(flat, n, band + step)
            yield cid, n, step == 0, sig, np.repeat(np.arange(len(n)), m)


def shared(rows: DataFrame, sets, entries_: int) -> DataFrame:
    """(sig, cost): segment hashes that several classes have, and how many. Hashes travel sorted and packed, by range."""
    ranges = bucket_count(entries_, RANGE)

    def packed(sigs):
        keys, count = np.unique(np.concatenate(sigs), return_counts=True)
        cuts = np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1))
        own = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        for k in range(0, len(own), 256):
            part = own[k : k + 256]
            columns = (
                pa.array([r for r, _, _ in part], pa.int32()),
                pa.array([b - a for _, a, b in part], pa.int32()),
                pa.array([keys[a].item() - (1 << 63) for _, a, _ in part], pa.int64()),
                pa.array([pack(np.diff(keys[a:b], prepend=keys[a])) for _, a, b in part], pa.binary()),
                pa.array([pack(count[a:b]) for _, a, b in part], pa.binary()),
            )
            yield pa.RecordBatch.from_arrays(list(columns), ["range", "n", "first", "keys", "counts"])

    def emit(batches):
        held, size = [], 0
        for _, _, _, sig, _ in segment_rows(sets, batches):
            held.append(sig)
            size += len(sig)
            if size >= RANGE:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def merge(batches):
        for _, parts in by_block(batches, 0):
            keys, counts = [], []
            for part in parts:
                for n, f, k, c in zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    keys.append(np.cumsum(unpack(k, n), dtype=U) + U(f + (1 << 63)))
                    counts.append(unpack(c, n).astype(np.int64))
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            total = np.add.reduceat(counts, first)
            yield pa.RecordBatch.from_arrays([pa.array(keys[first][total > 1].view(np.int64)), pa.array(total[total > 1])], ["sig", "cost"])

    dealt = rows.mapInArrow(emit, "range int, n int, first long, keys binary, counts binary").repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    return dealt.mapInArrow(merge, "sig long, cost long")


def members_of(rows: DataFrame, sets, known) -> DataFrame:
    """(sig, cid, n, own): the segment hashes of each class, in its own band and the next, that pass the filter known."""

    def run(batches):
        for cid, n, own, sig, at in segment_rows(sets, batches):
            keep = contains(known.value, sig)
            at = at[keep]
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(cid[at]), pa.array(n[at].astype(np.int64)), pa.array(np.full(len(at), own))], ["sig", "cid", "n", "own"])

    return rows.mapInArrow(run, "sig long, cid long, n long, own boolean")


def contains(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    shift = 64 - int(len(bits) * 64).bit_length() + 1
    at = values >> U(shift)
    return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) > 0


def bit_filter(values: DataFrame, column: str, count: int) -> np.ndarray:
    """Bits at the leading bits of each value; their number is bounded, so a full filter only lets more pass."""
    log = min(BITS[1], max(BITS[0], count.bit_length() + 5))
    at = F.shiftrightunsigned(F.col(column), 64 - log)
    words = values.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - log}) & 63 as int))")).alias("b"))
    out = np.zeros(1 << (log - 6), U)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(U)
    return out


def candidate_sets(docs: DataFrame, needed: DataFrame, count: int) -> DataFrame:
    """(cid, n, set, odd0, odd1, ...) of the classes in needed (cid, rep), a few of them more than once, and few others."""
    rows, sets = chosen(docs, needed, count)

    def run(batches):
        for cid, flat, n in sets(batches):
            cuts, odd = np.cumsum(n), parities(flat, n)
            own = pa.array([flat[b - a : b].tobytes() for a, b in zip(n.tolist(), cuts.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n.astype(np.int64)), own, *(pa.array(odd[:, k]) for k in range(len(ODD)))], ["cid", "n", "set", *ODD])

    return written(rows.mapInArrow(run, f"cid long, n long, set binary, {', '.join(f'{c} long' for c in ODD)}"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each node's component; label passing with pointer jumps, a written table a round."""
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        before = labels
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "least").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("over"))
        new = written(step.join(jump, "to").select("node", "old", F.least("to", "over").alias("root")), before)
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            drop_written(both)
            return labels


def links(docs: DataFrame, all_sizes: DataFrame) -> DataFrame | None:
    """(node, root) of the classes that link with another class; None where no bucket holds two."""
    spark = docs.sparkSession
    reps = written(all_sizes.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    count, total = reps.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return None
    texts, sets_ = chosen(docs, reps, count)  # of each class, one document
    hits = written(shared(texts, sets_, int(total) * 5 // 8 + count))
    n_hits = hits.count()
    if n_hits == 0:
        return None
    bits = spark.sparkContext.broadcast(bit_filter(hits, "sig", n_hits))
    rows = written(members_of(texts, sets_, bits).join(hits, "sig").distinct(), hits)  # one shuffle by sig serves both
    bits.unpersist()
    # Cost-based choice: a class needs floor(2n/9)+1 segments; those without company are free.
    top = int(rows.agg(F.max("n")).first()[0])
    segments = F.lit(0)
    for k, (low, _) in enumerate(bands(top)):  # some fifty bands at most
        segments = F.when(F.col("n") >= low, segments_of(k)).otherwise(segments)
    mine = rows.where("own")
    by_cost = Window.partitionBy("cid").orderBy("cost", "sig")
    mine = mine.withColumn("_rank", F.row_number().over(by_cost)).withColumn("_hot", F.count("*").over(Window.partitionBy("cid")))
    need = F.floor(2 * F.col("n") / 9) + 1 - (segments - F.col("_hot"))
    probes = written(mine.where(F.col("_rank") <= need).select("sig", "cid", "n"))
    rows = written(rows.join(probes.select("sig").distinct(), "sig", "left_semi"), rows)  # no other bucket is looked into

    wanted = written(rows.select("cid").distinct().join(reps.select("cid", "rep"), "cid"))  # every class that asks or is asked
    sets = candidate_sets(docs, wanted, wanted.count())
    traits = written(sets.select("cid", "n", *ODD).dropDuplicates(["cid"]), wanted)
    theirs = traits.withColumnsRenamed({"cid": "other", "n": "_n"} | {c: f"_{c}" for c in ODD})
    tried = labels = last = None
    members, asking = (f.select("sig", "cid", "n", F.col("cid").alias("root")) for f in (rows, probes))
    for turn in range(STARS + 1):
        if turn:
            # Roots only merge: a bucket of one root is done with, and later turns read what is still open alone.
            members = written(moved(members, merged), members)
            open_ = members.groupBy("sig").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("size")).where("_lo <> _hi").select("sig", "size")
            open_ = written(open_)
            members = written(members.join(open_.select("sig"), "sig", "left_semi"), members)
            asking = written(moved(asking, merged).join(open_, "sig").select("sig", "cid", "n", "root", "size"), asking, open_)
            work = asking.agg(F.sum("size")).first()[0]
            if not work:
                break
        if not turn or (turn < STARS and work > WORK * n_hits and (last is None or 2 * work < last)):
            draw = F.xxhash64("cid", F.lit(turn))
            stars = members.groupBy("sig").agg(*(pick(F.struct(draw.alias("d"), "cid", "n", "root")).alias(c) for c, pick in (("x", F.min), ("y", F.max))))
            stars = stars.select("sig", F.explode(F.array("x", "y")).alias("s")).select("sig", F.col("s.cid").alias("other"), F.col("s.n").alias("_n"), F.col("s.root").alias("other_root"))
            pairs = asking.join(stars, "sig").where("root <> other_root").where(near_sizes())
            pairs = ordered(pairs).join(traits, F.col("a") == F.col("cid")).drop("cid").join(theirs, F.col("b") == F.col("other")).where(may_link())
            done = False
        else:
            partner = members.select("sig", F.col("cid").alias("other"), F.col("root").alias("other_root")).join(theirs, "other")
            smaller = (F.col("_n") < F.col("n")) | ((F.col("_n") == F.col("n")) & (F.col("other") < F.col("cid")))
            pairs = ordered(asking.drop("n").join(traits, "cid").join(partner, "sig").where(F.col("root") != F.col("other_root")).where(smaller).where(may_link()))
            done = True
        last = work if turn else None
        pairs = pairs.select("a", "b", "ra", "rb")
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs.select("a", "b") if tried is None else tried.unionAll(pairs.select("a", "b"))
        found = verified(pairs, sets).join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        merged = components(written(found))  # of roots: what earlier turns linked is not gone through again
        labels = merged if labels is None else written(followed(labels, merged))
        if done:
            break
    drop_written(sets, traits, rows, probes, reps, *([members, asking] if turn else []), tried)
    return labels


def ordered(pairs: DataFrame) -> DataFrame:
    """(a, b, ra, rb): each pair of classes once, the smaller first, and the roots of both."""
    swap = F.col("cid") > F.col("other")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(either("cid", "other").alias("a"), either("other", "cid").alias("b"), either("root", "other_root").alias("ra"), either("other_root", "root").alias("rb")).distinct()


def moved(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows (sig, cid, n, root) with the roots that merged (node, root) gives."""
    new = merged.where("node <> root").select("node", F.col("root").alias("_new"))
    return rows.join(new, F.col("root") == F.col("node"), "left").select("sig", "cid", "n", F.coalesce("_new", "root").alias("root"))


def followed(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, root) after roots of labels, and nodes not in it, have merged."""
    new = merged.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    old = labels.join(new, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
    return old.unionAll(merged.join(labels, "node", "left_anti").select("node", "root"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents."""
    all_sizes = written(sizes(docs))
    labels = links(docs, all_sizes)
    filled = all_sizes.where("n > 0")
    if labels is None:
        named = filled.groupBy("cid").agg(F.min("doc_id").alias("component_id"))
    else:
        per = filled.groupBy("cid").agg(F.min("doc_id").alias("rep"))
        per = written(per.join(labels, F.col("cid") == F.col("node"), "left").select("cid", "rep", "root"))
        many = per.where("root is not null").groupBy("root").agg(F.min("rep").alias("component_id"))
        linked = per.where("root is not null").join(many, "root").select("cid", "component_id")
        named = linked.unionAll(per.where("root is null").select("cid", F.col("rep").alias("component_id")))
    empty = all_sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.join(named, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(empty)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; all columns stay."""
    name = unused("_kept", docs)
    kept = join(docs.select("doc_id", "text")).where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(written(kept), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")  # few ids are broadcast, no text is shuffled then
