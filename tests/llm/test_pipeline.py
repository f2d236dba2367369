import itertools
import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import shingles
from tidemark.llm import decontam, minhash, sharding
from tidemark.llm.common import placed, written


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rest = [c for c in out.columns if c not in ("shard", "slot")]
        assert rest == docs.columns and 0 < out.count() <= docs.count(), name
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[-2:] == ["shard", "slot"] and 0 < out.count() < docs.count()


def test_run_is_the_stages_by_brute_force(spark):
    """What the quality stage keeps, then all pairs of documents, then all documents with
    all items; mixing and sharding drop nothing."""
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in corpus_pipeline.good(spark, docs, sf).collect()}
    sets, up = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(rows), 2):
        a, b = sets[i], sets[j]
        if a and b and 10 * len(a & b) >= 8 * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    kept = [i for i in rows if root(i) == i]
    ids = {}
    items = [np.array([ids.setdefault(w, len(ids) + 1) for w in decontam.words_of(r.text)], np.int64) for r in bench.collect()]
    clean = set()
    for i in kept:
        x = np.array([ids.get(w, 0) for w in decontam.words_of(rows[i])], np.int64)
        if not any(len(y) and len(x) and np.isin(y, x).sum() >= 0.6 * len(y) - 1e-9 and decontam.align(y, x)[0] >= 0.6 for y in items):
            clean.add(i)
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(clean) and len(clean) < len(kept) < len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_keep_the_mix(spark):
    """Sources of equal size, shares 2 to 1: every shard has them at these weights from its first
    slot on, within a stretch, for the first round (180 blocks of 16 rows)."""
    docs = spark.range(6000).selectExpr("id doc_id", "concat('text ', id) text", "'en' lang", "if(id % 2 = 0, 'src0', 'src4') source", "length(concat('text ', id)) n_chars")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = written(corpus_pipeline.mixed(spark, docs, ""), "mix")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files.inputFiles()) == 4
    first = placed(files, "p").where("p < 2880").groupBy("source").count().collect()
    assert all(abs(r["count"] - (1920 if r.source == "src0" else 960)) <= 16 for r in first)
    out = corpus_pipeline.sharded(spark, files, "").collect()
    assert sorted(r.doc_id for r in out) == list(range(6000))
    assert sorted(map(tuple, out)) == sorted(map(tuple, corpus_pipeline.sharded(spark, files, "").collect()))
    for k in range(8):
        mine = sorted((r.slot, r.source) for r in out if r.shard == k)
        assert [s for s, _ in mine] == list(range(750))
        for n in range(64, 2880 // 8, 8):
            assert abs(sum(s == "src0" for _, s in mine[:n]) - n * 2 / 3) <= sharding.STRETCH_ROWS / 8
    empty = written(docs.where("false"), "none")
    assert corpus_pipeline.sharded(spark, empty, "").count() == 0
    with pytest.raises(ValueError, match="all rows"):
        placed(files.where("doc_id > 100"), "p")


def test_near_duplicate_stage_links_from_80_percent(spark):
    """Texts of 100 shingles; 10 or 11 of them changed leave a similarity of 0.82 or 0.80."""
    rng = random.Random(8)
    rows, expected = [], set()
    for i in range(40):
        base = ["u%d" % rng.randrange(10**6) for _ in range(104)]
        cut = 10 + i % 4  # of the shingles at the end: (100 - cut) / (100 + cut) in common
        near = [*base[: 104 - cut], *["z%d.%d" % (i, k) for k in range(cut)]]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        expected |= {2 * i} if 10 * (100 - cut) >= 8 * (100 + cut) else {2 * i, 2 * i + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert {r.doc_id for r in stage(spark, docs, None).collect()} == expected
    assert {r.doc_id for r in minhash.deduplicate(docs).collect()} == {d for d, _ in rows}


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in entry.queries() if x.startswith("op")}
    assert "pipeline" in entry.queries()
