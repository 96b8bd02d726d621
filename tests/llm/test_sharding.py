import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import sharding


def sizes_of(rows):
    out = Counter()
    for r in rows:
        out[r.shard] += len((r.text or "").encode()) + 1
    return out


def check_slots(rows):
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_near_equal_bytes_with_a_hot_group_of_copies(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randint(0, 300)) for i in range(2000)] + [(5000 + i, "copy " * 20) for i in range(1500)]
    rows += [(None, None), (-1, None), (3, ""), (3, ""), (9000, "ß" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = sharding.shard_documents(df, 8).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    size = sizes_of(out)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(size[k] - mean) <= 0.002 * mean + 8001 for k in size)
    check_slots(out)
    assert {r.shard for r in out if r.text == "copy " * 20} != {out[0].shard}
    again = sharding.shard_documents(df.repartition(3), 8).collect()
    pick = lambda rs: sorted((repr(r.doc_id), r.text or "", r.shard, r.slot) for r in rs if r.text != "")
    assert pick(again) == pick(out)


def test_few_rows_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "q", 2), (2, "bb", 6, "r", 3)],
                               "doc_id long, text string, shard int, slot string, __x int")
    out = sharding.shard_documents(df, 8)
    assert out.columns == ["doc_id", "text", "__x", "shard", "slot"] and out.count() == 2
    assert sharding.shard_documents(df.limit(0), 8).count() == 0
    assert {r.shard for r in sharding.shard_documents(df, 1).collect()} == {0}


def test_boundaries_count_exact_bytes(spark):
    rnd = random.Random(4)
    data = [(rnd.choice([5, rnd.getrandbits(62), rnd.getrandbits(20)]), rnd.randint(1, 50)) for _ in range(3000)]
    keys = spark.createDataFrame(data, "__key long, __size long")
    total = sum(s for _, s in data)
    for k, b in enumerate(sharding.boundaries(keys, 5, 0.0, probes=3), 1):
        err = abs(sum(s for x, s in data if x < b) - total * k / 5)
        best = min(abs(sum(s for x, s in data if x < c) - total * k / 5) for c in {x for x, _ in data} | {1 << 62})
        assert err == best


def test_query_digest(spark, sf):
    from tessera.llm.queries import QUERIES

    rows = QUERIES["op8_sharding"](spark, sf).collect()
    src = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(src)
    for r in rows:
        t = (src[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    check_slots(rows)
