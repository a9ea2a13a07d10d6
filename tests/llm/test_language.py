import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm.language import Labeller, Model, identify, label, letter_words, remainder, script, train


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 7, 4)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = rng.normal(0, 2, (starts[-1], 3)).astype(np.float32)
        penalty = float(rng.choice([0.5, 2.0, 5.0]))
        value = lambda s, path: sum(s[t, x] for t, x in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))  # noqa: E731, B023
        for i, got in enumerate(label(flat, starts, penalty)):
            s = flat[starts[i] : starts[i + 1]]
            best = max(value(s, path) for path in itertools.product(range(3), repeat=len(s)))
            assert abs(value(s, got) - best) < 1e-4


def test_words_and_scripts():
    assert letter_words("Hello, WORLD 12 ça—va") == [b"hello", b"world", "ça—va".encode()]
    assert script("привет".encode()) == 2 and script(b"abc") == 0 and script("—".encode()) == -2


def test_script_narrows_candidates():
    counts, scripts = np.ones((2, 1 << 16)), np.zeros((2, 14))
    scripts[0, 0] = scripts[1, 2] = 100
    scores, _ = Model(["en", "ru"], counts, scripts).scores(["привет".encode(), b"hello"])
    assert scores[0].argmax() == 1 and scores[1].argmax() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs.where(remainder("doc_id", 5) != 0))
    got = identify(docs, model, [F.col("doc_id"), F.col("lang"), remainder("doc_id", 5) == 0], "doc_id long, lang string, held boolean").collect()
    held = [r for r in got if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_spans_of_mixed_text(spark, small):
    model = train(small)
    by = {r.lang: r.text for r in small.orderBy(F.desc("n_chars")).collect()}
    mixed = by["en"][:800] + " " + by["de"][:1500]
    lang, share, spans = Labeller(Model(*model), 18.0)([mixed])[0]
    assert lang == "de" and 0.5 < share < 0.85
    assert spans[0]["lang"] == "en" and spans[-1]["lang"] == "de" and spans[0]["start"] == 0
    assert all(a["end"] == b["start"] for a, b in itertools.pairwise(spans))


def test_odd_rows(spark, odd_docs, no_docs):
    keep, schema = [F.col("doc_id"), F.col("text")], "doc_id long, text string"
    model = train(odd_docs)
    got = identify(odd_docs, model, keep, schema).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0.0 and r.spans == []))
    assert identify(no_docs, model, keep, schema).collect() == []
    assert train(odd_docs, most_langs=1)[0] in (["en"], ["fr"])
    empty = train(no_docs)
    assert empty[0] == [] and {r.lang_pred for r in identify(odd_docs, empty, keep, schema).collect()} == {"und"}
