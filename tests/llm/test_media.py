import numpy as np

from tidemark.llm import media, queries

SF = "/root/testdata/sf0.001"


def picture(title, kind=0):
    return media.encoded(media.view(media.scene(title), kind))


def by_id(rows, key="media_id"):
    return {r[key]: r for r in rows.collect()}


def test_every_crop_and_edit_of_a_queried_picture_is_found(spark):
    rows = [(50 * s + k, picture(b"scene %d" % s, k)) for s in range(12) for k in range(media.VIEWS)]
    got = by_id(media.copies(spark.createDataFrame(rows, "media_id long, image binary")))
    for s in range(12):
        assert got[50 * s]["n_found"] == media.VIEWS - 1
        for k in range(1, media.VIEWS):
            assert (got[50 * s + k]["n_queries"], got[50 * s + k]["best_query"]) == (1, 50 * s)


def test_links_equal_those_of_all_pairs_compared(spark):
    drawn = media.page_pictures(spark.read.parquet(f"{SF}/pages.parquet"))
    rows = {r["page_id"]: media.decoded(bytes(r["image"])) for r in drawn.collect()}
    points = {k: media.described(g[None])[0] for k, g in rows.items()}
    got = by_id(media.copies(drawn, "page_id", every=5), "page_id")
    alike = lambda a, b: rows[a].shape == rows[b].shape and np.array_equal(rows[a], rows[b])
    for q in (k for k in rows if k % 5 == 0):
        linked = {got[k]["class_id"] for k in rows if not alike(q, k) and media.inliers(points[q], points[k]) >= media.INLIERS}
        assert got[q]["n_found"] == len(linked)


def test_odd_rows(spark):
    rows = [(0, None, "a"), (1, b"", "a"), (2, b"P5 9 9 255\nshort", "a"), (3, b"P5 9 9 255\nshort", "a"), (50, picture(b"x"), "b"), (50, picture(b"x"), "b"), (51, picture(b"x"), None), (None, picture(b"x", 1), None), (7, b"P5 1 1 255\n\x00", "c"), (8, media.encoded(np.full((40, 60), 9)), "c")]
    frame = spark.createDataFrame(rows, "media_id long, image binary, cid string")
    got = media.copies(frame).collect()
    assert len(got) == len(rows)
    named = {r["media_id"]: r["class_id"] for r in got}
    assert (named[0], named[2], named[3], named[50], named[51], named[None]) == (0, 2, 2, 50, 50, None)
    assert [r["n_found"] for r in got if r["media_id"] == 50] == [1, 1]
    assert media.copies(frame.limit(0)).count() == 0


def test_colour_and_comments_are_read():
    grey = media.view(media.scene(b"y"), 2)
    colour = b"P6\n# made by hand\n80 80\n255\n" + np.repeat(grey[..., None], 3, 2).tobytes()
    assert np.abs(media.decoded(colour).astype(int) - grey).max() <= 1


def test_the_query_returns_every_page(spark):
    got = queries.op10_media(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def noisy(grey, rng, spread):
    return np.clip(grey + rng.normal(0, spread, grey.shape), 0, 255).astype(np.uint8)


def rescaled(grey, by):
    at = np.clip((np.arange(int(len(grey) * by)) + 0.5) / by - 0.5, 0, len(grey) - 1)
    low = np.minimum(at.astype(int), len(grey) - 2)
    rest = at - low
    rows = grey[low] * (1 - rest)[:, None] + grey[low + 1] * rest[:, None]
    return np.rint(rows[:, low] * (1 - rest) + rows[:, low + 1] * rest).astype(np.uint8)


def test_noisy_and_rescaled_copies_are_found_wherever_consensus_links_them(spark):
    rng, drawn = np.random.default_rng(1), {}
    for s in range(12):
        whole = media.view(media.scene(b"scene %d" % s), 0)
        for k, grey in enumerate([whole, noisy(whole, rng, 8), noisy(whole, rng, 16), rescaled(whole, 0.9), rescaled(whole, 1.15), rescaled(whole, 1.3)]):
            drawn[50 * s + k] = grey
    points = {k: media.described(g[None])[0] for k, g in drawn.items()}
    got = by_id(media.copies(spark.createDataFrame([(k, media.encoded(g)) for k, g in drawn.items()], "media_id long, image binary")))
    for q in range(0, 600, 50):
        assert got[q]["n_found"] == sum(media.inliers(points[q], points[k]) >= media.INLIERS for k in drawn if k != q)
    assert sum(got[q]["n_found"] for q in range(0, 600, 50)) >= 45


def test_copies_link_without_any_query_among_them(spark):
    ids = {(s, k): 50 * s + k + 1 for s in range(6) for k in range(media.VIEWS)}
    drawn = {i: media.view(media.scene(b"scene %d" % s), k) for (s, k), i in ids.items()}
    points = {i: media.described(g[None])[0] for i, g in drawn.items()}
    got = by_id(media.copies(spark.createDataFrame([(i, media.encoded(g)) for i, g in drawn.items()], "media_id long, image binary")))
    for (s, _), i in ids.items():
        linked = [j for j in drawn if j != i and max(media.inliers(points[i], points[j]), media.inliers(points[j], points[i])) >= media.INLIERS]
        assert (got[i]["n_links"], got[i]["group_id"], got[i]["n_queries"]) == (len(linked), ids[s, 0], 0)
        assert set(linked) >= {ids[s, k] for k in range(media.VIEWS)} - {i}
