"""The pipeline stage by stage: each decision against the operator or brute force on what it was given."""

import random

import corpus_pipeline
from tessera.llm import simhash, tiling
from tessera.llm.suffix_dedup import dedup_texts

from .test_simhash import brute_fp


def fixture(spark, tmp_path):
    rnd = random.Random(9)
    vocab = ["garden", "window", "table", "silver", "morning", "river", "idea", "stone", "thinner", "lantern", "meadow"]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", "s", "ly"]) for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        words = text(rnd.randint(20, 60)).split()
        toxic = int(rnd.random() < 0.25)
        if toxic:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "moron", "scumbag"])
        docs.append((i, " ".join(words), "en", "s", len(words)))
        labels.append((i, 1, toxic))
    passage = text(40)
    item = text(18)
    docs += [(1000, "one " + passage + " two", "en", "s", 1), (1001, "three " + passage + " four", "en", "s", 1)]
    docs += [(1002 + k, "copied text that is the same in all of its copies", "en", "s", 1) for k in range(5)]
    docs += [(1010, "before " + item + " after", "en", "s", 1), (1011, None, None, None, None), (1012, "", "", "", 0)]
    bench = [(0, item), (1, "another item of the benchmark that is nowhere")]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, {i for i, _, t in labels if t}, passage, item


def test_stages_take_effect_in_order(spark, tmp_path):
    sf, toxic, passage, item = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, dtypes = docs.columns, docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontamination", "packing"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], sf)
        out.write.parquet(f"{sf}/stage{k}")
        seen.append(spark.read.parquet(f"{sf}/stage{k}"))
        if k < 4:
            assert seen[-1].columns == columns and seen[-1].dtypes == dtypes
    rows = [{r.doc_id: r.text for r in d.collect()} if k < 5 else d.collect() for k, d in enumerate(seen)]
    # toxicity: rejects the toxic documents, keeps the clean ones, null and empty texts too
    gone = set(rows[0]) - set(rows[1])
    assert len(gone ^ toxic) <= 0.05 * len(toxic) and not gone & {1000, 1001, 1002, 1010, 1011, 1012}
    # SimHash: one document of each group, the smallest id, by brute force over all pairs
    fps = {i: brute_fp(t) for i, t in rows[1].items()}
    root = {i: i for i in fps}
    for _ in range(len(fps)):
        before = dict(root)
        for i in fps:
            root[i] = min(root[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 2)
        if root == before:
            break
    assert set(rows[2]) == {i for i in fps if root[i] == i}
    # suffix dedup: the later document loses the shared passage
    assert set(rows[3]) == set(rows[2])
    want = {r.doc_id: r.text for r in dedup_texts(seen[2]).collect()}
    assert rows[3] == want and passage not in rows[3][1001] and passage in rows[3][1000]
    assert all(rows[3][i] == rows[2][i] for i in rows[2] if i is not None and rows[2][i] is None)
    # decontamination
    assert set(rows[3]) - set(rows[4]) == {1010}
    assert tiling.contaminated(seen[4], spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    # packing: every document in whole
    ids = {}
    for r in rows[5]:
        ids[r.doc_id] = ids.get(r.doc_id, 0) + r.length
        assert r.length <= 2048 and r.offset + r.length <= 2048
    assert set(ids) == set(rows[4])
    assert all(ids[r.doc_id] == r.doc_tokens for r in rows[5])


def test_run_equals_the_stages_and_takes_empty_tables(spark, tmp_path):
    sf, *_ = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
    key = lambda d: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in d.collect())
    whole = lambda d: sorted({(r.doc_id, r.doc_tokens) for r in d.collect()})
    ran = corpus_pipeline.run(spark, sf)
    assert whole(ran) == whole(docs) and len(key(ran)) > 0
    empty = f"{sf}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_kept_rows_are_unchanged_and_repeats_are_dropped(spark):
    rows = [(1, "a b c d", "x", 3), (1, "a b c d", "x", 3), (2, "a b c d", "y", 4), (None, "a b c d", "z", 5), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, low string, fp int")
    got = sorted((tuple(r) for r in simhash.keep_one_per_group(df).collect()), key=repr)
    assert got == sorted([rows[0], rows[3], rows[4]], key=repr)
