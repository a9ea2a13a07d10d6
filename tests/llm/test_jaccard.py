import itertools
import random

import pytest

from panelspark.llm import jaccard
from panelspark.llm.components import components
from panelspark.llm.jaccard import link_components, prefix, shingle_sets


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_force(docs):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_sets_by_definition(small):
    texts = [r.text for r in small.collect()] + ["", " ", "a", "a b c d", "a b c d e", "A  B\tc\x0bD\x0ce f", "é É é É é É"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def near_copies(seed, groups=6, copies=14):
    """Groups whose members lie around the limit of similarity, chains included, with shared passages in all."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common = [word() for _ in range(12)]
    docs = []
    for _ in range(groups):
        text = [word() for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(copies):
            docs.append(" ".join(text + (common if rng.random() < 0.5 else [])))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[: rng.randint(max(1, len(text) * 3 // 4), len(text))]
    docs += [" ".join(common)] * 3 + ["", None, "x"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs = near_copies(seed)
    assert result(link_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute_force(docs)


def test_rounds_and_orders_change_nothing(spark, monkeypatch):
    docs = near_copies(7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_force(docs)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 0)  # expand at once
    assert result(link_components(df)) == want
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 2)
    monkeypatch.setattr(jaccard, "EXPAND", -1e9)  # hubs as long as rounds last
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 10**9)
    monkeypatch.setattr(jaccard, "FIRST_HUBS", 1)
    monkeypatch.setattr(jaccard, "LATER_HUBS", 1)
    monkeypatch.setattr(jaccard, "LOOK_BACK", 1)
    assert result(link_components(df)) == want


def test_small_table(small):
    assert result(link_components(small)) == brute_force([(r.doc_id, r.text) for r in small.collect()])


def test_prefix_filter_is_safe():
    for n in range(1, 300):
        for m in range(-(-n * 80 // 100), n + 1):
            need = -(-80 * (n + m) // 180)
            assert prefix(n) >= n - need + 1 and prefix(m) >= m - need + 1


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_odd_rows(odd_docs, no_docs):
    assert result(link_components(odd_docs)) == brute_force([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert link_components(no_docs).collect() == []
