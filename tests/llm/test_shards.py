import zlib
from collections import defaultdict

from tidemark.llm import queries, shards

SF = "/root/testdata/sf0.01"


def test_sizes_slots_and_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_shards(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_several_blocks_and_ranges_with_equal_rows(spark):
    docs = spark.createDataFrame([(i // 3, "same" if i % 2 else None) for i in range(500)], "doc_id long, text string")
    got = shards.shuffle_shards(docs, 4, list(map(docs.__getitem__, docs.columns)), block_rows=20).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(125)]
