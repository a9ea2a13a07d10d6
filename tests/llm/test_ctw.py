import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import ctw
from panelspark.llm.ctw import END, score, tokens, weigh
from panelspark.llm.words import Lookup


def counts(words, depth):
    out = [Counter() for _ in range(depth + 1)]
    for w, n in words.items():
        s = b" " + w + (b"" if w == END else b" ")
        for i in range(1, len(s)):
            for d in range(min(i, depth) + 1):
                out[d][s[i - d : i], s[i]] += n
    return out


def rows(words, depth):
    out = []
    for level in counts(words, depth):
        keys = sorted((int.from_bytes(c, "big"), b) for c, b in level)
        by = {(int.from_bytes(c, "big"), b): n for (c, b), n in level.items()}
        out.append((np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.int64), np.array([by[k] for k in keys])))
    return out


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute_force(words, depth):
    """Probability of a byte after a context whose every byte is in the tree, node by node."""
    levels = counts(words, depth)

    def pair(level, context, prefix, k):
        both = [0, 0]
        for (c, b), n in level.items():
            if c == context and b >> (8 - k) == prefix:
                both[b >> (7 - k) & 1] += n
        return both

    def children(context):
        return {c for c, _ in levels[len(context) + 1] if c[1:] == context} if len(context) < depth else set()

    def node(context, prefix, k):
        """(log weighted probability, share of the own estimate, own, leaf)"""
        a, b = pair(levels[len(context)], context, prefix, k)
        ra, rb, split = a, b, 0.0
        for child in children(context):
            ca, cb = pair(levels[len(child)], child, prefix, k)
            if ca + cb:
                ra, rb = ra - ca, rb - cb
                split += node(child, prefix, k)[0]
        split += log_kt(ra, rb)
        own = log_kt(a, b)
        return np.logaddexp(own, split) - math.log(2), 1 / (1 + math.exp(split - own)), (b + 0.5) / (a + b + 1), (rb + 0.5) / (ra + rb + 1), a + b

    def probability(context, byte):
        p = 1.0
        for k in range(8):
            prefix, bit = byte >> (8 - k), byte >> (7 - k) & 1
            total, rest = 0.0, 1.0
            for d in range(len(context) + 1):
                _, w, own, leaf, n = node(context[len(context) - d :], prefix, k)
                assert n
                total, rest = total + rest * w * own, rest * (1 - w)
            one = total + rest * leaf
            p *= one if bit else 1 - one
        return p

    return probability


def test_weighting_by_definition():
    words = Counter({b"the": 5, b"then": 2, b"hat": 3, b"he": 1, END: 2})
    tree, probability = weigh(rows(words, 2)), brute_force(words, 2)
    for w in words:
        s = b" " + w + (b"" if w == END else b" ")
        want = sum(math.log10(probability(s[max(0, i - 2) : i], s[i])) for i in range(1, len(s)))
        assert tree.scores([w])[0] == pytest.approx(want, abs=1e-6), w


def test_probabilities_sum_to_one():
    words = Counter({b"the": 5, b"then": 2, b"hat": 3, END: 2})
    tree = weigh(rows(words, 3))
    # all bytes that may follow a context: a one-byte token scores the byte and its terminator
    levels = tree.levels
    for d, context in ((0, 0), (1, ord(" ")), (2, ord(" ") << 8 | ord("t"))):
        total = 0.0
        for byte in range(256):
            value, here, c = 0.0, d, context
            while True:
                contexts, escape, keys, probability = levels[here]
                key = c << 8 | byte
                at = int(np.searchsorted(keys, np.uint64(key)))
                if at < len(keys) and int(keys[at]) == key:
                    value += probability[at]
                    break
                value += escape[int(np.searchsorted(contexts, np.uint64(c)))]
                if here == 0:
                    break
                here -= 1
                c &= (1 << 8 * here) - 1
            total += 10**value
        assert total == pytest.approx(1, abs=1e-6)


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    table = Lookup(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (Lookup(keys[:0]).find(keys[:3]) == -1).all()


def base(docs, folds=10):
    train = Counter()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0 for i, _ in docs}
    for i, t in docs:
        if not held[i]:
            train.update(tokens((t or "").encode()))
    n, v = sum(train.values()), len(train)
    below = math.log10(n + 0.1 * (v + 1))
    out = []
    for i, t in docs:
        own = tokens((t or "").encode())
        out.append((str(i), held[i], len(own), sum(train[w] > 0 for w in own), n, sum(math.log10(train[w] + 0.1) - below for w in own)))
    return sorted(out)


def check(df, docs):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect())
    for a, b in zip(got, base(docs), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_base_score_by_brute_force(small):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    check(score(small), docs)
    check(score(small, hot=20), docs)  # nearly all words by the join


def test_scores_do_not_depend_on_what_is_broadcast(small):
    a = {r.doc_id: r.score for r in score(small).collect()}
    b = {r.doc_id: r.score for r in score(small.repartition(3), hot=20).collect()}
    assert all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)


def test_beats_the_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(score(odd_docs), docs)
    check(score(odd_docs.drop("lang"), label_col=None), docs)
    assert score(no_docs).collect() == []
    (r,) = score(odd_docs.where("doc_id = 8"), folds=1).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0) and r.score < 0


def test_every_context_stays_in_the_sharded_trees(spark, monkeypatch):
    monkeypatch.setattr(ctw, "SHARD_ROWS", 200, raising=False)
    monkeypatch.setattr(ctw, "CHUNK_WORDS", 50, raising=False)
    # a byte's rare context among 400,000 others: far less than 1/65,536 of all bytes
    texts = ["the cat sat on a mat " * 20_000, "rarewordhere rarewordhere otherthing"] + [f"w{i * 7919} and thing{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, "rarewordhere"), (1001, "rarewordzzzz"), (1002, "")], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = {r.doc_id: r.score for r in score(docs, label_col=None).collect()}
    words = Counter(w for i, t in enumerate(texts) if not held(i) for w in tokens(t.encode()))
    for i in (1000, 1001, 1002):
        if not held(i):
            words.update(tokens({1000: b"rarewordhere", 1001: b"rarewordzzzz", 1002: b""}[i]))
    tree = weigh(rows(words, 7))
    for i, t in [(1, texts[1]), (1000, "rarewordhere"), (1001, "rarewordzzzz"), (1002, "")] + list(enumerate(texts))[2:40]:
        assert got[i] == pytest.approx(sum(tree.scores(tokens(t.encode()))), rel=1e-5), i
