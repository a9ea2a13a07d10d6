import hashlib
import random
import re

from panelspark.llm.decontaminate import WuManber, automata, decontaminate, hits


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, window=10):
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            p = words(t)
            m = min(window, len(p))
            for i in range(len(p) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == p[i : i + m]:
                        hit.update(range(j, j + m))
                        found.add(str(item))
        out.setdefault(doc, []).append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return {k: sorted(v) for k, v in out.items()}


def result(df):
    out = {}
    for r in hits(df).collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    return {k: sorted(v) for k, v in out.items()}


def random_tables(seed):
    rng = random.Random(seed)
    text = lambda lo, hi: " ".join(rng.choice(["a", "b", "C", "dé", "e5", "—", "x.y"]) for _ in range(rng.randint(lo, hi)))
    items = [(i, text(0, 16)) for i in range(8)] + [(99, None), (100, "")]
    docs = [(i, text(0, 60)) for i in range(20)]
    docs += [(50 + i, text(0, 9) + " " + (t or "").upper() + ", " + text(0, 5)) for i, t in items]
    return docs, items


def test_against_brute_force(spark):
    for seed in range(4):
        docs, items = random_tables(seed)
        d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert result(decontaminate(d, i, window=4)) == brute_force(docs, items, 4)


def test_blocks_give_the_same(spark):
    docs, items = random_tables(9)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(decontaminate(d, i, window=4, block_bytes=20)) == brute_force(docs, items, 4)


def test_small_table(spark, small):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in small.collect()]
    got = result(decontaminate(small, items))
    assert got == brute_force(docs, [(r.item_id, r.text) for r in items.collect()])
    assert any(v[0][4] for v in got.values())


def test_jumps_never_skip_an_occurrence():
    rng = random.Random(1)
    for _ in range(300):
        m = rng.randint(1, 6)
        patterns = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(m)): {"x"} for _ in range(5)}
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        got = [s for s, _ in WuManber(m, patterns).search(text)]
        assert got == [s for s in range(len(text) - m + 1) if tuple(text[s : s + m]) in patterns]
    assert automata([("x", b"...")]) == []


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(None, "tie text one two"), (3, None), (4, "")], "item_id long, text string")
    got = result(decontaminate(odd_docs, items))
    assert got[8] == got[9] and got[8][0][1:3] == (4, 1)
    assert got[1] == [(0, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert decontaminate(no_docs, items).collect() == []
    assert not any(v[4] for x in result(decontaminate(odd_docs, items.limit(0))).values() for v in x)
