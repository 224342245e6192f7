"""Media columns (operator 10): cropped and edited copies by local image descriptors.

Corners are found at several scales of each picture's grey values; round every
corner, binary tests turned by the corner's own orientation give 128 bits. `TABLES`
Hamming tables of a part of the bits each are probed for all keys within `FLIPS` bits:
of `NEAR` flipped bits, some part has no more, so every two descriptors within `NEAR`
bits meet. Pictures of which `INLIERS` corners met as many of the other are verified:
nearest descriptors within `NEAR` bits, of which `INLIERS` or more must follow one
turn, scale and shift. No link is lost before that.

All classes are joined with all: pictures with equal pixels form one class, classes are
linked in pairs, and linked classes form a group. The tables are built in blocks of
bounded size, each broadcast and run against all classes. The pictures whose id is
divisible by `EVERY` are marked as queries, and some columns tell of links with them.
There is no cap on corners, entries, candidates or links.

Formats: binary PGM and PPM (P5, P6, one byte a value), decoded with numpy.

Defined results: a null, empty or unreadable picture is a class of its own without
links (unreadable ones with equal bytes share a class); a picture without corners
links with nothing but its equals; repeated rows are equal pictures; a null id is no
query, and names a class only where all its members have none; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U, binaries, mix, written
from tidemark.llm.jaccard import components

EVERY = 50
LEVELS = 3  # scales, each half of the one before
LEAST = 24  # no scale has a shorter side
RADIUS = 7  # of the tests round a corner
QUALITY = 0.02  # a corner's least response, as a share of the picture's greatest
NEAR = 20  # bits of 128
TABLES = 7
FLIPS = NEAR // TABLES  # bits of a table's key
BLOCK_CORNERS = 1 << 19
MEETINGS = 1 << 20  # compared at a time
INLIERS = 8
SHIFT, TURN, ZOOM = 3.0, 0.35, 0.35  # what one motion may differ by: pixels, radians, log of the scale
TURNS = 32

# x, y: in half pixels of the picture.
KEYPOINT = np.dtype([("x", "<u2"), ("y", "<u2"), ("zoom", "u1"), ("turn", "u1"), ("bits", "<u8", (2,))])
HEADER = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def tests() -> np.ndarray:
    """(TURNS, 128, 2, 2): row and column offsets of the pairs of points compared, for each turn.

    A corner's orientation points to its bright side, so points apart along it differ
    nearly always the same way; the pairs lie across it and tell corners apart better.
    """
    rng = np.random.default_rng(10)
    points, most = [], RADIUS - 0.5
    while len(points) < 128:
        p, q = rng.uniform(-most, most, (2, 2))
        q[0] = p[0] + rng.uniform(-1, 1)
        if max(np.hypot(*p), np.hypot(*q)) <= most and np.hypot(*(p - q)) >= 3:
            points.append((p, q))
    angle = np.arange(TURNS) * (2 * np.pi / TURNS)
    turned = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]).transpose(2, 0, 1)
    return np.rint(np.einsum("tij,npj->tnpi", turned, np.array(points))).astype(np.int64)[..., ::-1]


TESTS = tests()
DISC = np.array([(y, x) for y in range(-6, 7) for x in range(-6, 7) if x * x + y * y <= 36], np.int64)


def decoded(raw: bytes | None) -> np.ndarray | None:
    """Grey values (rows x columns, uint8) of a picture; None if it can't be read."""
    head = HEADER.match(raw) if raw else None
    if not head or int(head[4]) > 255:
        return None
    width, height, planes = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
    if not width or not height or len(raw) - head.end() < width * height * planes:
        return None
    values = np.frombuffer(raw, np.uint8, width * height * planes, head.end()).reshape(height, width, planes)
    return values[..., 0] if planes == 1 else (values @ np.array([77, 150, 29]) >> 8).astype(np.uint8)


def encoded(grey: np.ndarray) -> bytes:
    """A picture as binary PGM."""
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, np.uint8).tobytes()


def summed(x: np.ndarray) -> np.ndarray:
    """Sums of 3 x 3 neighbours, the border repeated; x: (pictures, rows, columns)."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), "edge")
    p = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return p[..., :-2] + p[..., 1:-1] + p[..., 2:]


def corners(grey: np.ndarray):
    """(picture, row, column) of the corners: local maxima of the smaller eigenvalue of the gradients' spread."""
    gx, gy = np.zeros_like(grey), np.zeros_like(grey)
    gx[..., 1:-1] = grey[..., 2:] - grey[..., :-2]
    gy[:, 1:-1] = grey[:, 2:] - grey[:, :-2]
    xx, yy, xy = summed(gx * gx), summed(gy * gy), summed(gx * gy)
    force = summed((xx + yy) - np.sqrt((xx - yy) ** 2 + 4 * xy * xy))
    inner = force[:, RADIUS:-RADIUS, RADIUS:-RADIUS]
    peak = np.ones(inner.shape, bool)
    rows, columns = force.shape[1:]
    for dy in (-2, -1, 0, 1, 2):
        for dx in (-2, -1, 0, 1, 2):
            other = force[:, RADIUS + dy : rows - RADIUS + dy, RADIUS + dx : columns - RADIUS + dx]
            if (dy, dx) > (0, 0):
                peak &= inner > other
            elif (dy, dx) < (0, 0):
                peak &= inner >= other
    peak &= inner > np.maximum(QUALITY * force.max((1, 2)), 1.0)[:, None, None]
    picture, y, x = np.nonzero(peak)
    return picture, y + RADIUS, x + RADIUS


def described(stack: np.ndarray) -> list[np.ndarray]:
    """Key points (KEYPOINT) of each picture of a stack of equal shape."""
    level, found, owner = stack.astype(np.float32), [], []
    for zoom in range(LEVELS):
        if zoom:
            h, w = level.shape[1] // 2 * 2, level.shape[2] // 2 * 2
            level = (level[:, 0:h:2, 0:w:2] + level[:, 1:h:2, 0:w:2] + level[:, 0:h:2, 1:w:2] + level[:, 1:h:2, 1:w:2]) / 4
        if min(level.shape[1:]) < LEAST:
            break
        smooth = summed(level)
        picture, y, x = corners(smooth)
        if not len(picture):
            continue
        disc = smooth[picture[:, None], y[:, None] + DISC[:, 0], x[:, None] + DISC[:, 1]]
        moment = (disc - disc.mean(1, keepdims=True)) @ DISC.astype(np.float32)
        turn = np.rint(np.arctan2(moment[:, 0], moment[:, 1]) * (TURNS / (2 * np.pi))).astype(np.int64) % TURNS
        at = TESTS[turn]
        values = smooth[picture[:, None, None], y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
        bits = np.packbits(values[..., 0] < values[..., 1], axis=1).view("<u8")
        own = np.zeros(len(picture), KEYPOINT)
        step = 1 << zoom
        own["x"], own["y"], own["zoom"], own["turn"], own["bits"] = 2 * x * step + step - 1, 2 * y * step + step - 1, zoom, turn, bits
        found.append(own)
        owner.append(picture)
    if not found:
        return [np.zeros(0, KEYPOINT)] * len(stack)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.split(found[order], np.cumsum(np.bincount(owner, minlength=len(stack)))[:-1])


def inliers(a: np.ndarray, b: np.ndarray) -> int:
    """Greatest number of corners of a with a near corner of b that follow one motion; one corner of b counts once."""
    if len(a) < INLIERS or len(b) < INLIERS:
        return 0
    apart = np.bitwise_count(a["bits"][:, None, :] ^ b["bits"][None, :, :]).sum(2)
    to = apart.argmin(1)
    keep = apart[np.arange(len(a)), to] <= NEAR
    if np.count_nonzero(keep) < INLIERS:
        return 0
    p, q, to = a[keep], b[to[keep]], to[keep]
    turn = (q["turn"].astype(np.float64) - p["turn"]) * (2 * np.pi / TURNS)
    zoom = q["zoom"].astype(np.float64) - p["zoom"]
    motion = np.exp2(zoom) * np.exp(1j * turn)
    here, there = p["x"] / 2 + 0.5j * p["y"], q["x"] / 2 + 0.5j * q["y"]
    off = np.abs(there[None] - (there[:, None] + motion[:, None] * (here[None] - here[:, None])))
    near = off <= SHIFT + 0.15 * np.abs(here[None] - here[:, None]) * np.abs(motion)[:, None]
    near &= np.abs(np.angle(np.exp(1j * (turn[None] - turn[:, None])))) <= TURN
    near &= np.abs(zoom[None] - zoom[:, None]) * np.log(2) <= ZOOM
    return len(np.unique(to[near[near.sum(1).argmax()]]))


class Tables:
    """Hamming tables of the corners of a bounded block of pictures."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.cids = [cid for cid, _ in rows]
        each = [np.frombuffer(raw, KEYPOINT) for _, raw in rows]
        counts = np.array([len(e) for e in each], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
        self.points = np.concatenate([np.zeros(0, KEYPOINT), *each])
        self.bits = np.ascontiguousarray(self.points["bits"])
        self.tables, at = [], 0
        for i in range(TABLES):
            width = 128 // TABLES + (i < 128 % TABLES)
            keys = part(self.bits, at, width)
            offsets = np.zeros((1 << width) + 1, np.int32)
            offsets[1:] = np.cumsum(np.bincount(keys, minlength=1 << width))
            masks = [sum(1 << k for k in c) for n in range(FLIPS + 1) for c in itertools.combinations(range(width), n)]
            self.tables.append((at, width, np.array(masks, np.int64), offsets, np.argsort(keys, kind="stable").astype(np.int32)))
            at += width

    def near(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(corner, corner of the block) of all pairs within NEAR bits, each once."""
        found = [np.zeros(0, np.int64)]
        for at, width, masks, offsets, order in self.tables:
            keys = (part(bits, at, width)[:, None] ^ masks).ravel()
            low = offsets[keys]
            size = offsets[keys + 1] - low
            some = np.flatnonzero(size)
            low, size, corner = low[some].astype(np.int64), size[some].astype(np.int64), some // len(masks)
            total = np.cumsum(size)
            cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, MEETINGS)))
            for a, b in zip(cuts, [*cuts[1:], len(size)], strict=True):
                n = size[a:b]
                place = order[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                mine = np.repeat(corner[a:b], n)
                keep = np.bitwise_count(self.bits[place] ^ bits[mine]).sum(1, dtype=np.uint8) <= NEAR
                found.append(mine[keep] * len(self.bits) + place[keep])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.bits)), both % max(1, len(self.bits))

    def meet(self, each: list[np.ndarray]):
        """(picture, picture of the block) of those of which INLIERS corners meet INLIERS corners of the other."""
        of = np.repeat(np.arange(len(each)), [len(e) for e in each])
        mine, theirs = self.near(np.concatenate([e["bits"] for e in each]))
        many = len(self.cids)
        pair, keep = of[mine] * many + self.owner[theirs], None
        for side, n in ((mine, len(of)), (theirs, len(self.bits))):
            named, count = np.unique(np.unique(pair * n + side) // n, return_counts=True)
            named = named[count >= INLIERS]
            keep = named if keep is None else np.intersect1d(keep, named)
        yield from zip((keep // many).tolist(), (keep % many).tolist(), strict=True)


def part(bits: np.ndarray, at: int, width: int) -> np.ndarray:
    """`width` of the 128 bits of each descriptor, from bit `at`."""
    word, shift = divmod(at, 64)
    out = bits[:, word] >> U(shift)
    if shift + width > 64:
        out = out | bits[:, word + 1] << U(64 - shift)
    return (out & U((1 << width) - 1)).astype(np.int64)


def features(media: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, cid, points): class and packed key points of every picture."""

    def run(batches):
        for batch in batches:
            raw = binaries(batch.column(1))
            for start in range(0, len(raw), 128):
                some = raw[start : start + 128]
                cid, points, shapes = [None] * len(some), [b""] * len(some), {}
                for k, data in enumerate(some):
                    grey = decoded(data)
                    if grey is not None:
                        shapes.setdefault(grey.shape, []).append((k, grey))
                    elif data is not None:
                        cid[k] = xxhash.xxh3_64_intdigest(data, 1)
                for shape, own in shapes.items():
                    each = max(1, (1 << 19) // (shape[0] * shape[1]))
                    for a in range(0, len(own), each):
                        part = own[a : a + each]
                        for (k, grey), found in zip(part, described(np.stack([g for _, g in part])), strict=True):
                            cid[k] = xxhash.xxh3_64_intdigest(b"%d %d " % shape + grey.tobytes())
                            points[k] = found.tobytes()
                named = [None if c is None else c - (1 << 64) if c >> 63 else c for c in cid]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start : start + 128], pa.array(named, pa.int64()), pa.array(points, pa.binary())], ["id", "cid", "points"])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(F.col(id_column), F.col(column)).mapInArrow(run, f"id {kind}, cid long, points binary")


def blocks(classes: DataFrame):
    """Classes in blocks of a bounded number of corners; one block at a time is on the driver."""
    held, size = [], 0
    for cid, points in classes.toLocalIterator():
        held.append((cid, bytes(points)))
        size += len(points) // KEYPOINT.itemsize
        if size >= BLOCK_CORNERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(found: DataFrame) -> DataFrame:
    """(query, cid, n_inliers): links of all classes with others, in the directions that pass; found: written features."""
    spark = found.sparkSession
    rows = found.where(f"cid is not null and octet_length(points) >= {INLIERS * KEYPOINT.itemsize}")
    classes = written(rows.groupBy("cid").agg(F.first("points").alias("points")))
    schema, out = "query long, cid long, n_inliers int", None
    for held in blocks(classes):
        shipped = spark.sparkContext.broadcast(Tables(held))

        def run(batches, shipped=shipped):
            tables = shipped.value
            for batch in batches:
                cids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                links = []
                for start in range(0, len(cids), 8):
                    each = [np.frombuffer(r, KEYPOINT) for r in raw[start : start + 8]]
                    for k, other in tables.meet(each):
                        a, b = cids[start + k], tables.cids[other]
                        if a < b:  # each pair once
                            points = tables.points[tables.starts[other] : tables.starts[other + 1]]
                            ways = (a, b, inliers(each[k], points)), (b, a, inliers(points, each[k]))
                            links += [way for way in ways if way[2] >= INLIERS]
                columns = [pa.array([x[i] for x in links], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["query", "cid", "n_inliers"])

        links = written(classes.select("cid", "points").mapInArrow(run, schema))
        shipped.unpersist()
        out = links if out is None else out.unionByName(links)
    return out if out is not None else spark.createDataFrame([], schema)


def copies(media: DataFrame, id_column: str = "media_id", column: str = "image", every: int = EVERY) -> DataFrame:
    """(id, class_id, group_id, n_links, is_query, n_found, n_queries, best_query) of every picture.

    class_id: smallest id with the same pixels. n_links: other classes linked with this
    one, whichever of the two has the inliers; group_id: smallest id of the classes
    linked with this one directly or over others. n_found: other classes linked with a
    query's class (null for others). n_queries: other classes with a query in them
    that link with this picture; best_query: the one with most inliers, by class_id.
    """
    found = written(features(media, id_column, column))
    links = written(search(found))
    members = found.groupBy("cid").agg(F.min("id").alias("class_id"), F.max(F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))).alias("asked")).where("cid is not null")
    members = written(members)
    named = links.join(members.where("asked").select(F.col("cid").alias("query"), F.col("class_id").alias("_name")), "query")
    by_class = named.groupBy("cid").agg(F.count("*").alias("n_queries"), F.max_by("_name", F.struct("n_inliers", -F.col("_name"))).alias("best_query"))
    by_query = links.groupBy("query").agg(F.count("*").alias("n_found")).withColumnRenamed("query", "cid")
    pairs = links.select(F.least("query", "cid").alias("a"), F.greatest("query", "cid").alias("b")).distinct()
    labels = components(pairs).withColumnRenamed("node", "cid")
    groups = members.join(labels, "cid").groupBy("root").agg(F.min("class_id").alias("group_id"))
    linked = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    linked = linked.join(labels, "cid").join(groups, "root").drop("root")
    classes = members.join(by_class, "cid", "left").join(by_query, "cid", "left").join(linked, "cid", "left")
    out = found.select("id", "cid").join(classes, "cid", "left")
    is_query = F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))
    n_found = F.when(is_query, F.coalesce("n_found", F.lit(0)))
    return out.select(F.col("id").alias(id_column), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("group_id", "class_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), is_query.alias("is_query"), n_found.alias("n_found"), F.coalesce("n_queries", F.lit(0)).alias("n_queries"), "best_query")


# Pictures for pages: the tables hold no media, so a page's lead picture is drawn.

CANVAS, SIDE, BOXES = 112, 80, 40
VIEWS = 8


def scene(title: bytes) -> np.ndarray:
    """Grey boxes on a canvas, placed by the title's hash: equal titles, equal scenes."""
    seed = U(xxhash.xxh3_64_intdigest(title))
    draw = mix(seed + np.arange(BOXES * 5, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(40)
    y, x, h, w, grey = draw.astype(np.int64).reshape(5, BOXES)
    out = np.full((CANVAS, CANVAS), 128, np.uint8)
    for a, b, c, d, g in zip((y % (CANVAS - 6)).tolist(), (x % (CANVAS - 6)).tolist(), (h % 22 + 7).tolist(), (w % 22 + 7).tolist(), (grey % 216 + 20).tolist(), strict=True):
        out[a : a + c, b : b + d] = g
    return out


def view(whole: np.ndarray, kind: int) -> np.ndarray:
    """One of eight crops and edits of a scene."""
    crop = lambda a, b, n=SIDE: whole[a : a + n, b : b + n]
    if kind == 0:
        return crop(16, 16)
    if kind == 1:
        return crop(8, 24)
    if kind == 2:
        return crop(24, 8)
    if kind == 3:  # brighter
        return np.minimum(crop(16, 16).astype(np.int64) + 19, 255).astype(np.uint8)
    if kind == 4:  # less contrast
        return (crop(12, 20).astype(np.int64) * 7 // 10 + 40).astype(np.uint8)
    if kind == 5:  # turned
        return np.rot90(crop(16, 16)).copy()
    if kind == 6:  # a caption over it
        out = crop(16, 16).copy()
        out[-14:] = 250
        return out
    return crop(8, 8, SIDE + 16)  # a larger part


def page_pictures(pages: DataFrame) -> DataFrame:
    """(page_id, image): the lead picture of every page, its scene by title and its view by id; null html has none."""

    def run(batches):
        for batch in batches:
            ids = [0 if i is None else i for i in batch.column(0).to_pylist()]
            for start in range(0, len(ids), 256):
                own = batch.slice(start, 256)
                views = (mix(np.array([i % (1 << 64) for i in ids[start : start + 256]], U)) % U(VIEWS)).tolist()
                images = [None if t is None else encoded(view(scene(t), v)) for t, v in zip(binaries(own.column(1)), views, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(images, pa.binary())], ["page_id", "image"])

    title = F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", title.alias("title")).mapInArrow(run, f"page_id {kind}, image binary")
