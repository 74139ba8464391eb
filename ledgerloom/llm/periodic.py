"""Periodic runs of words, by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q, at least 2 q and LEAST words long, that no neighbouring word extends. They are found from squares whose next word breaks
the period: two suffixes q words apart that share exactly q words lie in different children of the LCP interval of depth q. For each interval, the suffixes of all children but the
largest look whether their neighbours at distance q are in the interval too, by the inverse suffix array. Such a square ends where its run ends; it is rotated to the left as long as the
words agree, and squares of one stretch (of q and its multiples) merge into a run. Intervals are (left, right, depth) triples made from the LCP array; there are no tree nodes.

Before that, words that no repeated sequence of LEAST / 2 words of their text covers are set aside, which loses nothing: all words of a run are covered, as the words of its first period
stand again one period later. So the suffix array holds repeated passages only. Sequences are compared by hashes there, which can only let more words through; afterwards words are
compared themselves.

Defined results: null and empty texts have no words and no runs; a null id is never planted; repeated rows are each worked out; further columns do not matter. A text is held whole by
its task, with about 150 bytes for each repeated word of it.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.llm.common import append_columns, free_name, slices, table, utf8
from ledgerloom.llm.hashing import word_hashes

#: A run's least length in words.
LEAST = 12
#: Smaller children's suffixes that are looked up at once.
_AT_ONCE = 1 << 20
#: Bytes of texts that are worked on together.
_TEXTS = 1 << 21


@dataclass
class SuffixArray:
    """Suffixes in order, the inverse, and for each power of two the rank of the words that start at each position (equal ranks, equal words)."""

    order: np.ndarray
    inverse: np.ndarray
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray) -> SuffixArray:
        """By prefix doubling; each step sorts those that are not yet told apart. Every stretch ends with an id of its own, so none runs on into the next."""
        n = len(ids)
        order = np.argsort(ids, kind="stable").astype(np.int32)
        slots, key, rank, ranks, step = np.arange(n, dtype=np.int32), ids[order], np.empty(n, np.int32), [], 1
        while True:
            new = np.empty(len(key), bool)
            new[:1] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(key)))
            rank[order[slots]] = np.repeat(slots[first], size)
            ranks.append(rank.copy())
            slots = slots[np.repeat(size > 1, size)]
            if not len(slots):
                return cls(order, ranks[-1], ranks)
            at = order[slots]
            key = rank[at].astype(np.int64) << 32 | rank[np.minimum(at + step, n - 1)]
            by = np.argsort(key, kind="stable")
            order[slots], key = at[by], key[by]
            step *= 2

    def extension(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from the different positions a and b on, or before them."""
        so_far = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = (a + so_far, b + so_far) if forward else (a - so_far - (1 << k), b - so_far - (1 << k))
            inside = (x >= 0) & (y >= 0)
            so_far += (inside & (self.ranks[k][np.maximum(x, 0)] == self.ranks[k][np.maximum(y, 0)])).astype(np.int64) << k
        return so_far

    def lcp(self) -> np.ndarray:
        """Words that each suffix shares with the one before it in order; 0 for the first."""
        order = self.order.astype(np.int64)
        return np.concatenate([[0], self.extension(order[:-1], order[1:], True)]) if len(order) else np.zeros(0, np.int64)


def _bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place with a positive LCP the left and right end of the interval it splits: up to the nearest smaller values."""
    values, many = lcp.tolist(), len(lcp)
    left, right = [0] * many, [many - 1] * many
    open_: list[int] = []
    for at, value in enumerate(values):
        while open_ and values[open_[-1]] > value:
            right[open_.pop()] = at - 1
        if open_:
            before = open_[-1]
            left[at] = left[before] if values[before] == value else before
        open_.append(at)
    # Of equal values, those before a smaller one all end there; they were closed together. The left end is the place of the smaller value.
    return np.asarray(left), np.asarray(right)


def _children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, end, left, right, depth) of every child but the largest of each LCP interval."""
    left, right = _bounds(lcp)
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    by = np.lexsort((at, lcp[at], left[at]))
    at = at[by]
    lb, rb, depth = left[at], right[at], lcp[at]
    new = np.concatenate([[True], (lb[1:] != lb[:-1]) | (depth[1:] != depth[:-1])])
    head = np.flatnonzero(new)
    splits = np.diff(np.append(head, len(at)))
    # Children: from the interval's left end to its first split, between splits, and from the last split to its right end.
    owner = np.repeat(np.arange(len(head)), splits + 1)
    place = np.concatenate([[0], np.cumsum(splits + 1)[:-1]])
    first, end = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    is_first = np.zeros(len(owner), bool)
    is_first[place] = True
    is_last = np.roll(is_first, -1)
    first[is_first], first[~is_first] = lb[head], at
    end[is_last], end[~is_last] = rb[head] + 1, at
    size = end - first
    largest = np.repeat(np.maximum.reduceat(size, place), splits + 1)
    candidates = np.flatnonzero(size == largest)
    skip = candidates[np.unique(owner[candidates], return_index=True)[1]]  # one of the largest
    small = np.ones(len(owner), bool)
    small[skip] = False
    return first[small], end[small], lb[head][owner[small]], rb[head][owner[small]], depth[head][owner[small]]


def runs_of(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs in a sequence of ids whose stretches each end with an id that stands nowhere else."""
    index = SuffixArray.of(ids)
    first, end, left, right, depth = _children(index.lcp())
    starts, periods = [], []
    size = end - first
    cut = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), _AT_ONCE), side="right")
    for low, high in zip(cut, np.append(cut[1:], len(size)), strict=True):
        many = size[low:high]
        owner = np.repeat(np.arange(low, high), many)
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        here, q = index.order[first[owner] + inside].astype(np.int64), depth[owner]
        for other, begin in ((here + q, here), (here - q, here - q)):
            fits = (other >= 0) & (other < len(ids))
            rank = index.inverse[np.clip(other, 0, len(ids) - 1)]
            fits &= (rank >= left[owner]) & (rank <= right[owner]) & ((rank < first[owner]) | (rank >= end[owner]))
            starts.append(begin[fits])
            periods.append(q[fits])
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    start, period = np.concatenate(starts), np.concatenate(periods)
    stop = start + 2 * period
    start = start - index.extension(start, start + period, False)
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])])[: len(start)] & (stop - start >= least)
    return start[keep], stop[keep], period[keep]


def _covered(hashes: np.ndarray, bound: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a sequence of `length` words that stands in their text more than once (or that hashes take for one)."""
    n = len(hashes)
    covered = np.zeros(n + 1, np.int64)
    if n < length:
        return covered[:n].astype(bool)
    text = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    gram = np.zeros(n - length + 1, np.uint64)
    for k in range(length):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - length + 1 + k]
    starts = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    # A text's number goes in, so that sequences are only compared within a text. A table of counts leaves few to be sorted.
    gram = (gram[starts] ^ (text[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
    bits = max(10, int(n).bit_length() + 2)
    bucket = (gram >> np.uint64(64 - bits)).astype(np.int64)
    often = np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] > 1)
    by = often[np.argsort(gram[often], kind="stable")]
    same = gram[by][1:] == gram[by][:-1]
    twice = np.zeros(len(by), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = starts[by[twice]]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + length, -1)
    return np.cumsum(covered[:n]) > 0


def find_runs(texts: list[bytes], order: list[np.ndarray | None] | None = None, least: int = LEAST) -> list[tuple[list[bytes], np.ndarray]]:
    """The words of each text, and its runs as rows (start, length, period) by start, then period. order: which word of the text each word is instead (None: as they stand)."""
    data, first, end, hashes, bound = word_hashes(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bound))
    source = np.arange(len(first))
    for i, other in enumerate(order or []):
        if other is not None:
            source[bound[i] : bound[i + 1]] = bound[i] + other
    kept = np.flatnonzero(_covered(hashes[source], bound, least // 2))
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    words = [text.split() for text in texts]
    words = [w if order is None or order[i] is None else [w[j] for j in order[i].tolist()] for i, w in enumerate(words)]
    if len(kept):
        # Equal words of one text have equal ids; a gap is an id that stands nowhere else.
        known: dict = {}
        ids = np.asarray([known.setdefault((t, words[t][w]), len(known)) for t, w in zip(text_of[kept].tolist(), (kept - bound[text_of[kept]]).tolist(), strict=True)], np.int64)
        stretch = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(text_of[kept]) > 0)])
        number = np.cumsum(stretch) - 1
        place = np.arange(len(kept)) + number
        sequence = np.empty(len(kept) + int(number[-1]) + 1, np.int64)
        back = np.full(len(sequence), -1, np.int64)
        sequence[place], back[place] = ids, kept
        gaps = np.flatnonzero(back < 0)
        sequence[gaps] = len(known) + np.arange(len(gaps))
        start, stop, period = runs_of(sequence, least)
        length, start = stop - start, back[start]
        owner = text_of[start]
        by = np.lexsort((period, start))
        rows = np.stack([start - bound[owner], length, period], axis=1)[by]
        for i, part in enumerate(np.split(rows, np.searchsorted(owner[by], np.arange(1, len(texts))))):
            out[i] = part
    return list(zip(words, out, strict=True))


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that are in no run, or in the first period of all runs that hold them."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document that repetition is planted in; None for the others."""
    if doc_id is None or n == 0 or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_FOUND = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
)


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text", planted: str | None = None, least: int = LEAST) -> DataFrame:
    """Columns `keep` of docs with the number of runs, the longest one, a digest of all and one of the text without repetitions. planted: the id column that repetition is planted by."""
    text, seed = free_name("_text", keep, _FOUND.names), free_name("_seed", keep, _FOUND.names)
    extra = [docs[planted].alias(seed)] if planted else []

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        columns: list[list] = [[] for _ in _FOUND]
        for part in slices(batch, _TEXTS):
            texts = [t or b"" for t in utf8(part.column(part.schema.get_field_index(text)))]
            order = None
            if planted:
                order = [planted_order(i, len(t.split())) if i is not None and zlib.crc32(str(i).encode()) % 10 == 0 else None for i, t in zip(part.column(part.schema.get_field_index(seed)).to_pylist(), texts, strict=True)]
            for words, runs in find_runs(texts, order, least):
                listed = runs.tolist()
                best = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else None
                digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest()
                rest = hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()
                row = (len(listed), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest, rest)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        return [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(columns)]

    return append_columns(docs.select(*keep, *extra, docs[text_col].alias(text)), keep, _FOUND, run)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of which has repetition planted in it."""
    return periodic_runs(table(spark, sf_dir, "documents"), ["doc_id"], planted="doc_id")
