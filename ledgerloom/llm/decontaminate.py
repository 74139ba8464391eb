"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts, run once over each document.

Normalising lower-cases A-Z and makes every ASCII byte other than a letter or digit a space; it keeps the length, so an
offset in the normalised text is the offset in the original.

Defined results: a null text has no words; an item without words has no window; an item of fewer words than the window is one
window; repeated items and repeated documents count each by itself (a repeated item_id counts once); the windows of an item without
an id are hit like others, though nothing names the item; an empty benchmark hits nothing. Other columns of either table are ignored unless named in `keep`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append_columns, free_name, map_batches, materialize, table, utf8, worker_state

WINDOW = 10
#: Windows in one automaton, which each Python worker holds. A larger benchmark is scanned by several, one after the other.
AUTOMATON_WINDOWS = 200_000

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_RANGES = T.ArrayType(T.LongType())


def normalise(text: bytes) -> list[bytes]:
    """The words of a text."""
    return text.translate(_NORMAL).split()


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct (window, item) pairs of the benchmark; each window is its words between single spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (" " + b" ".join(words[i : i + window]).decode("latin-1") + " ", item)
                for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)
                for words in [normalise(text or b"")]
                for i in range(max(1, len(words) - window + 1) if words else 0)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["window", "item"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return map_batches(items, cut, "window string, item string").distinct()


def _automaton(windows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for text, items in windows:
        made.add_word(text, (len(text), items))
    if len(made):
        made.make_automaton()
    return made


def _scan(made: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[int], set[str]]:
    """The hit word ranges (first, end, first, end, ...) and the items."""
    ranges: list[int] = []
    items: set[str] = set()
    if not len(made) or not words:
        return ranges, items
    text = " " + b" ".join(words).decode("latin-1") + " "
    starts = None
    for end, (length, of) in made.iter(text):
        if starts is None:
            starts = np.cumsum([0] + [len(w) + 1 for w in words])
        first = int(np.searchsorted(starts, end - length + 1))
        last = int(np.searchsorted(starts, end))
        if ranges and ranges[-2] <= first <= ranges[-1]:
            ranges[-1] = max(ranges[-1], last)
        else:
            ranges += [first, last]
        items.update(x for x in of if x is not None)
    return ranges, items


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    window: int = WINDOW,
    item_col: str = "item_id",
    item_text_col: str = "text",
    most: int = AUTOMATON_WINDOWS,
    prefix: str = "",
) -> DataFrame:
    """Columns `keep` of docs with the hits of benchmark windows: counts, the items, and where they stand in the text (code points). prefix begins the names of these.

    One pass over the texts as long as the benchmark has at most `most` (window, item) pairs; else one for each such share of
    them, in which only the hits found so far are carried along. Nothing is shuffled but the benchmark's windows.
    """
    spark = docs.sparkSession
    pairs = materialize(windows(benchmark, window, item_col, item_text_col), "windows")
    shards = -(-max(1, pairs.count()) // most)
    sharded = pairs.withColumn("shard", F.pmod(F.xxhash64("window", "item"), F.lit(shards)))
    carried = list(dict.fromkeys(keep))
    found_names = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in _FOUND])
    of_text, of_hits, of_items = (free_name(n, carried, found_names.names) for n in ("_text", "_hits", "_items"))
    out = docs.select(*[F.col(f"`{k}`") for k in carried], F.col(f"`{text_col}`").alias(of_text), F.lit(None).cast(_RANGES).alias(of_hits), F.lit(None).cast("array<string>").alias(of_items))
    for shard in range(shards):
        held: dict[str, list[str]] = {}
        for row in sharded.where(F.col("shard") == shard).select("window", "item").toLocalIterator():
            held.setdefault(row[0], []).append(row[1])
        shared = spark.sparkContext.broadcast(list(held.items()))
        last = shard == shards - 1

        def found(batch: pa.RecordBatch, shared=shared, last=last) -> list[pa.Array]:
            made = worker_state("decontaminate", shared.value, lambda: _automaton(shared.value))
            column = lambda k: batch.column(batch.schema.get_field_index(k))
            hits, items, rows = [], [], []
            for text, before, known in zip(utf8(column(of_text)), column(of_hits).to_pylist(), column(of_items).to_pylist(), strict=True):
                words = normalise(text or b"")
                ranges, of = _scan(made, words)
                ranges, of = (before or []) + ranges, set(known or ()) | of
                if last:
                    rows.append(_row(text or b"", words, ranges, of))
                else:
                    hits.append(ranges)
                    items.append(sorted(of))
            if last:
                return [pa.array([r[i] for r in rows], _ARROW[i]) for i in range(len(_FOUND))]
            return [pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]

        if last:
            return append_columns(out, carried, found_names, found)
        out = append_columns(out, [*carried, of_text], T.StructType([T.StructField(of_hits, _RANGES), T.StructField(of_items, T.ArrayType(T.StringType()))]), found)
    return out


_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _row(text: bytes, words: list[bytes], ranges: list[int], items: set[str]) -> tuple:
    of = sorted(items)
    digest = hashlib.sha256(",".join(of).encode()).hexdigest()
    if not ranges:
        return len(words), 0, len(of), digest, False, of, []
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.asarray(ranges[::2]), 1)
    np.add.at(step, np.asarray(ranges[1::2]), -1)
    hit = np.cumsum(step[:-1]) > 0
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], np.frombuffer(text.translate(_NORMAL), np.uint8) != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # word i is bytes edge[2i] to edge[2i+1]
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    spans = [{"start": int(point[edge[2 * a]]), "end": int(point[edge[2 * b - 1]])} for a, b in zip(change[::2], change[1::2], strict=True)]
    return len(words), int(hit.sum()), len(of), digest, bool(hit.any()), of, spans


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every window of the benchmark."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, row_number() OVER () AS r, CASE WHEN text IS NULL THEN [] ELSE {_WORDS.format("coalesce(text, '')")} END AS w FROM documents),
place AS (SELECT r, w, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS i FROM doc WHERE len(w) > 0),
hit AS (
  SELECT r, i, size.n, item
  FROM place, (SELECT DISTINCT n FROM win) AS size, win
  WHERE i + size.n - 1 <= n_words AND win.n = size.n AND win.win = array_to_string(w[i:i + size.n - 1], ' ')
),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS of FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(of, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN items USING (r)
"""
