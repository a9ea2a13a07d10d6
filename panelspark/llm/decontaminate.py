"""Operator 10: benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item (or the whole of a
shorter item) is a pattern.  For each pattern length, a shift table over blocks of
two words tells how far the search may jump, the blocks that end a pattern lead to
buckets of candidates, and a direct comparison confirms them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, load, scratch, text_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Benchmark text in one automaton; a larger benchmark is searched for in as many passes as it needs.
BLOCK_BYTES = 4_000_000


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then runs of 0-9, a-z and whatever is not ASCII (as UTF-8)."""
    return WORD.findall(text.lower())


class WuManber:
    """Patterns of one length m: tuples of words, each with the items it stands for."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m, self.block = m, min(2, m)
        self.jump = m - self.block + 1
        self.vocabulary = {w for p in patterns for w in p}
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), m - end)
            self.bucket.setdefault(p[m - self.block :], {})[p] = items

    def search(self, text: list[bytes]) -> list[tuple[int, set[str]]]:
        """(start, items) of every occurrence."""
        m, block, jump, vocabulary, shift, found = self.m, self.block, self.jump, self.vocabulary, self.shift, []
        end, n = m, len(text)
        while end <= n:
            if text[end - 1] not in vocabulary:  # no pattern reaches over this word
                end += m
                continue
            key = tuple(text[end - block : end])
            by = shift.get(key, jump)
            if by:
                end += by
                continue
            if items := self.bucket[key].get(tuple(text[end - m : end])):
                found.append((end - m, items))
            end += 1
        return found


def automata(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def spans(occurrences: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint [start, end) that cover the same words."""
    out: list[list[int]] = []
    for start, end in sorted(occurrences):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(shared, window: int, only_hits: bool):
    """Batches of (..., key, doc_id, text) to (..., key, doc_id, n_words, spans, items); with ``only_hits``, of texts with occurrences alone."""

    def run(batches):
        machines = automata(shared.value, window)
        for batch in batches:
            out, at = [], []
            *carried, keys, ids, texts = batch.columns
            for i, (key, doc, text) in enumerate(zip(keys.to_pylist(), ids.to_pylist(), as_bytes(texts), strict=True)):
                w = words(text)
                hits, items = [], set()
                for machine in machines:
                    for start, found in machine.search(w):
                        hits.append((start, start + machine.m))
                        items |= found
                if hits or not only_hits:
                    at.append(i)
                    out.append((key, doc, len(w), [{"start": a, "end": b} for a, b in spans(hits)], sorted(items)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.list_(pa.string())]
            rest = [c.take(pa.array(at, pa.int64())) for c in carried]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*batch.schema.names[:-3], "key", "doc_id", "n_words", "spans", "items"])

    return run


def _merge(column):
    return column.map(lambda x: [{"start": a, "end": b} for a, b in spans([(s["start"], s["end"]) for s in x])])


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, whole: bool = False) -> DataFrame:
    """Return (doc_id, n_words, spans, items): the word ranges inside occurrences and the items they stand for, one row per row of ``docs``.

    With ``whole``, a column ``row`` holds all columns of ``docs``.  Texts without words (null, empty) have no hits; items without words match
    nothing; a null item id is named ``null``.  An empty benchmark leaves every
    document clean, equal rows get equal results.  A benchmark over
    ``block_bytes`` is dealt by hash into blocks that are searched for in turn, so
    no broadcast grows with it.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    own_bytes = items.agg(F.sum(F.octet_length("text")))
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    kept = f"row {docs.schema.simpleString()}, " if whole else ""
    blocks = int((own_bytes.first()[0] or 0) // block_bytes) + 1
    if blocks > 1:  # rows are told apart by their place, so all passes have to read the same files
        docs = scratch(docs, "decontaminate-docs")
    docs = text_batches(docs).select(*row, F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = kept + "key long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.item, bytes(r.text)) for r in own.collect()])
        parts.append(docs.mapInArrow(lean(_search(shared, window, k > 0)), schema))
    if blocks == 1:
        return parts[0].drop("key")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("key").agg(*(F.first(c).alias(c) for c in ["row"] * whole), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select(*["row"] * whole, "doc_id", "n_words", F.pandas_udf(_merge, "array<struct<start:long,end:long>>")("spans").alias("spans"), "items")


def hits(found: DataFrame) -> DataFrame:
    """The digest columns of ``decontaminate``'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op10_decontaminate(spark, sf_dir):
    return hits(decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


#: The same by joins of all windows or shingles, for small tables.
SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d JOIN (SELECT DISTINCT m FROM iw) ON len(w) >= m)),
hit AS (SELECT r, dw.m, k, item FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM hit) GROUP BY r),
s AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)"""

QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES = {"op10_decontaminate": SQL}
