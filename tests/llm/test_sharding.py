import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelspark.llm.sharding import permute, shard


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 1000, 4097])
def test_permutation_is_a_bijection(spark, n):
    a = int(-(-(n**0.5) // 1))
    b = -(-n // a)
    lit = lambda x: F.lit(x).cast("long")
    for seed in (1, 2):
        image = [r[0] for r in spark.range(n).select(permute(F.col("id"), lit(n), lit(a), lit(b), seed)).collect()]
        assert sorted(image) == list(range(n))


def check(rows, shards, texts):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_law_and_digests(small):
    texts = [(r.doc_id, r.text) for r in small.collect()]
    one = shard(small, 24).collect()
    check(one, 24, texts)
    again = shard(small.repartition(7), 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in one} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert {(r.doc_id, r.shard) for r in shard(small, 24, seed=8).collect()} != {(r.doc_id, r.shard) for r in one}


def test_odd_rows(odd_docs, no_docs):
    rows = shard(odd_docs, 5).collect()
    check(rows, 5, [(r.doc_id, r.text) for r in odd_docs.collect()])
    check(shard(odd_docs, 5, bucket_rows=2).collect(), 5, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert shard(no_docs, 5).collect() == []


def test_many_copies_are_split(spark):
    docs = [(None, None)] * 57 + [(1, "a")] * 20 + [(2, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(shard(df, 5, bucket_rows=2, chunk_rows=8).collect(), 5, docs)


def test_no_python_on_executors(small):
    plan = shard(small, 24)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
