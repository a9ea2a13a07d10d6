import hashlib
from collections import Counter

import numpy as np

from panelspark.llm.fingerprint import LEVELS, _slots, boundaries, cuts_of, edited_fingerprints, fingerprint, likeness, names, parts_of, signatures, sketches


def test_phrases_are_short_and_cover(small):
    for r in small.limit(20).collect():
        symbols = np.frombuffer(r.text.encode(), np.uint8)
        for _ in range(4):
            begin = np.flatnonzero(boundaries(symbols, np.array([0])))
            sizes = np.diff(np.append(begin, len(symbols)))
            assert begin[0] == 0 and sizes.max() <= 16
            symbols = names(symbols, begin)
    run = np.full(1000, 65, np.uint8)
    assert np.diff(np.flatnonzero(boundaries(run, np.array([0])))).max() <= 9


def test_equal_substrings_share_phrases_at_any_offset(small):
    text = max((r.text for r in small.collect()), key=len).encode()[:6000]
    whole = signatures([text])[0]
    for shift in (b"x", b"some other beginning, ", b"\x00\x01" * 40):
        moved = signatures([shift + text + b" tail"])[0]
        assert len(np.intersect1d(whole, moved)) / len(whole) > 0.93


def test_batches_do_not_matter(small):
    texts = [r.text.encode() for r in small.collect()]
    together = sketches(texts)
    assert together == [sketches([t])[0] for t in texts]


def test_sketch_estimates_similarity(small):
    texts = [r.text.encode() for r in small.collect() if len(r.text) > 800]
    sig, sk = signatures(texts), sketches(texts)
    gaps = []
    for i in range(len(texts) - 1):
        changed = texts[i][: len(texts[i]) * 3 // 4] + texts[i + 1][: len(texts[i]) // 4]
        other = signatures([changed])[0]
        exact = len(np.intersect1d(sig[i], other)) / len(np.union1d(sig[i], other))
        gaps.append(abs(exact - likeness(sk[i], sketches([changed])[0])))
    assert np.mean(gaps) < 0.08


def expected(docs):
    """Edited texts by definition."""
    order = sorted(docs, key=lambda d: -(2**63) if d[0] is None else d[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        out[doc] = (text, text[: len(text) - k] + after[:k] if k else text, after)
    return out


def test_edits_against_brute_force(small):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    want = expected(docs)
    for range_rows in (8000, 30, 7):
        got = edited_fingerprints(small.repartition(5), range_rows=range_rows).collect()
        assert len(got) == len(docs)
        for r in got:
            text, edited, after = want[r.doc_id]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = sketches([text.encode(), edited.encode(), after.encode()])
            assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (a.hex(), b.hex(), likeness(a, b), likeness(a, c))
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def parsed(text):
    """Names of all phrases at all levels, as nested tuples of bytes, by the definition: one symbol and one neighbour at a time."""

    def key(symbol):
        return symbol if isinstance(symbol, int) else int(names_of[symbol])

    def coin(left, right):
        bit = next(i for i in range(64) if (left ^ right) >> i & 1)
        return 2 * bit + (right >> bit & 1)

    names_of, symbols, out = {}, list(text), [tuple(text)]
    for _ in range(LEVELS):
        labels = [key(x) for x in symbols]
        same = [i > 0 and symbols[i] == symbols[i - 1] for i in range(len(symbols))]
        for _ in range(3):
            labels = [coin(a, b) if a != b else b & 1 for a, b in zip([0, *labels[:-1]], labels, strict=True)]
        tags = [-1 if s else x for x, s in zip(labels, same, strict=True)]
        begin = [0]
        step = 0
        for i in range(1, len(symbols)):
            step = step + 1 if same[i] else 0
            peak = i < len(symbols) - 1 and tags[i] > tags[i - 1] and tags[i] >= tags[i + 1]
            if peak or same[i] and step % 8 == 0:
                begin.append(i)
        phrases = [tuple(symbols[a:b]) for a, b in zip(begin, [*begin[1:], len(symbols)], strict=True)]
        flat = np.array([key(x) for x in symbols], np.uint64)
        for phrase, name in zip(phrases, names(flat, np.array(begin)), strict=True):
            names_of[phrase] = name
        symbols = phrases
        out += [(level_of(p), p) for p in phrases]
    return Counter(out)


def level_of(phrase):
    return 0 if isinstance(phrase, int) else 1 + level_of(phrase[0])


def test_likeness_by_an_independent_parse(small):
    """Overlaps of phrases as nested tuples, without hashing or sketches, against those of the signatures."""
    texts = [r.text.encode()[:n] for r, n in zip(small.limit(40).collect(), [7, 40, 158, 162, 300] * 8, strict=True) if r.text]
    for a, b in zip(texts, texts[1:]):
        for other in (a[: len(a) * 3 // 4] + b[: len(a) // 4], b):
            x, y = parsed(a), parsed(other)
            exact = sum((x & y).values()) / sum((x | y).values())
            s, t = signatures([a, other])
            assert len(np.intersect1d(s, t)) / len(np.union1d(s, t)) == exact


def test_likeness_has_no_jump_at_any_size(small):
    texts = [t for t in (r.text for r in small.collect()) if t.isascii() and len(t) > 400][:40]
    means = []
    for n in (140, 153, 157, 159, 163, 175):
        means.append(np.mean([likeness(*sketches([t[9 : 9 + n].encode(), t[9 : 13 + n].encode()])) for t in texts]))
    assert max(means) - min(means) < 0.1


def test_ranges_are_dealt_one_to_a_partition(spark):
    for n in (1, 7, 60):
        numbers = _slots(spark, n)
        to = spark.createDataFrame([(x,) for x in numbers], "x int").selectExpr(f"pmod(hash(x), {n}) as p").collect()
        assert [r.p for r in to] == list(range(n))


def test_repeated_ids_are_cut_by_hash(spark):
    assert cuts_of([3, 5, 5, 9]) == [(3, -(2**63)), (5, -(2**63)), (5, 0), (9, -(2**63))]
    place, hashes = np.array([2, 3, 5, 5, 5, 6, 9, 10]), np.array([0, 7, -9, 0, 4, 4, -1, 0])
    assert parts_of(place, hashes, cuts_of([3, 5, 5, 9])).tolist() == [0, 1, 2, 3, 3, 3, 4, 4]
    docs = [(None, f"text number {i} " * (i % 9)) for i in range(120)] + [(5, f"other {i} " * 9) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    whole = sorted((r.edited_sha256, r.fingerprint) for r in edited_fingerprints(df).collect())
    assert whole == sorted((r.edited_sha256, r.fingerprint) for r in edited_fingerprints(df, range_rows=9).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    got = edited_fingerprints(odd_docs, range_rows=3).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[8][0].fingerprint == by[9][0].fingerprint and len({x.fingerprint for x in by[5]}) == 1
    assert by[1][0].n_chars == 0 and by[1][0].fingerprint == by[2][0].fingerprint == ""
    assert edited_fingerprints(no_docs).collect() == []
    (one,) = edited_fingerprints(odd_docs.where("doc_id = 8")).collect()
    assert one.near_next == 1.0
    plain = fingerprint(odd_docs).collect()
    assert sorted(x.fingerprint for x in plain) == sorted(x.fingerprint for x in got)
