import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from panelspark.llm import packing
from panelspark.llm.packing import Encoder, SegmentTree, best_fit_decreasing, pack, vocabulary

PATH = vocabulary()
PLAIN = Tokenizer.from_file(PATH)


def reference(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(odd_docs, small):
    encoder = Encoder(PATH)
    odd = ["", " ", "  a", "a  ", "a  b", "a \n b", "\u00a0x \u00a0 y", "x\x85y \x1c z", "it's we'll I'D", "<|endoftext|> a<|endoftext|>", "ein ßüber 12½ ³", "\u3000全角 空白", "a\u2003b  \u2003", "tab\t\ttab \t", "\U0001f600 \U0001f600\U0001f600", "é" * 200, "œuvre d'été"]
    texts = odd + [r.text or "" for r in odd_docs.collect()] + [r.text for r in small.limit(60).collect()]
    for _ in range(2):  # cold and cached
        for text, ids in zip(texts, encoder.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference(text), text[:50]
    assert np.frombuffer(encoder.ids(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    monkeypatch.setattr(packing, "CHUNK_CHARS", 30)
    encoder = Encoder(PATH)
    texts = [f"word{i % 7} and word{i % 3} " + "x" * (i % 60) for i in range(80)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts)] == [reference(t) for t in texts]
    assert len(encoder.known) + len(encoder.old) < 40


def brute_force(lengths, window):
    free, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[i])
        else:
            free.append(window - lengths[i])
        out[i] = True
    return len(free), sorted(free)


def test_best_fit_decreasing_by_brute_force():
    rng = random.Random(0)
    for _ in range(40):
        window = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(1, 80))]
        placed = best_fit_decreasing(lengths, window)
        used = defaultdict(list)
        for (at, offset), n in zip(placed, lengths, strict=True):
            used[at].append((offset, n))
        for pieces in used.values():
            end = 0
            for offset, n in sorted(pieces):
                assert offset == end
                end += n
            assert end <= window
        n, free = brute_force(lengths, window)
        assert len(used) == n
        assert sorted(window - sum(n for _, n in x) for x in used.values()) == free


def test_segment_tree():
    tree = SegmentTree(10)
    for c in (3, 7, 7):
        tree.add(c, 1)
    assert [tree.least(c) for c in (0, 3, 4, 7, 8)] == [3, 3, 7, 7, -1]
    tree.add(7, -1)
    assert tree.least(5) == 7
    tree.add(7, -1)
    assert tree.least(5) == -1


def check(rows, docs, window):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= window
    want = defaultdict(list)
    for doc, text in docs:
        ids = [*reference(text or ""), 1]
        for s in range(0, len(ids), window):
            piece = ids[s : s + window]
            want[doc].append((s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)))
    assert {k: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}


def test_round_trip(spark, small):
    rows = pack(small, PATH, window=256, group_docs=64).collect()
    check(rows, [(r.doc_id, r.text) for r in small.collect()], 256)
    kept = pack(small, PATH, window=256, keep_ids=True).collect()
    whole = defaultdict(dict)
    for r in kept:
        whole[r.doc_id][r.start] = bytes(r.ids)
    some = small.first()
    assert np.frombuffer(b"".join(v for _, v in sorted(whole[some.doc_id].items())), "<u4").tolist() == [*reference(some.text), 1]


def test_little_padding(small):
    rows = pack(small, PATH, window=2048).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) * 1.02 + 1


def test_odd_rows(odd_docs, no_docs):
    check(pack(odd_docs, PATH, window=64, group_docs=3).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 64)
    assert pack(no_docs, PATH).collect() == []


def test_new_units_go_to_the_tokenizer_together():
    class Counting:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode(self, text, **k):
            self.texts += 1
            return self.inner.encode(text, **k)

        def encode_batch_fast(self, texts, **k):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **k)

    encoder = Encoder(PATH)
    encoder.tokenizer = Counting(encoder.tokenizer)
    words = [f"w{i}ord" for i in range(1500)]
    assert np.frombuffer(encoder.ids([" ".join(words)])[0], "<u4").tolist() == reference(" ".join(words))
    assert encoder.tokenizer.texts < 10
    rng = random.Random(3)
    marks = [" ", "\n", "\t", "\xa0", "a", "B", "1", "'s", ".", "é", "中", "　", "\x1c", "\r", "  ", "\n\n", "word", "᠎", "​", "﻿", "\x85"]
    odd = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(odd)] == [reference(t) for t in odd]
