"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A text's segments are its lines, cut after each sentence and after SEGMENT words; a segment's digest comes from its words, and from how many equal segments stand
before it, so a text is a set of digests. Each digest is added to three cells of a sketch: to their counts, sums of digests and sums of checks. Subtracting
two sketches leaves the digests that only one version has; peeling cells that hold a single one recovers them. Where that fails, both texts are
sketched again in twice as many cells.

A fingerprint is the sketch of CELLS cells (and the number of segments) as text; two versions' likeness is 1 - differing / all digests.

The next document in order of id comes by ranges of ids: texts are shuffled once, each range is read in order as a stream, and the first document of
a range goes to the range before it too, so no task holds more than a few documents. The bounds, one id for each range, are all the driver sees.

Defined results: a null text is empty; texts without words have no segments and are alike; white space that changes no words changes no fingerprint; null ids come
last; rows of one id follow each other in order of their text; a single document is its own next; no documents make no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, table, utf8
from ledgerloom.llm.hashing import mix, word_hashes

SEGMENT = 16
CELLS, HASHES = 24, 3
#: Documents in a range of ids, and ranges at most; the bounds of all ranges are on the driver.
RANGE_DOCS, MOST_RANGES = 2_000, 4_096
#: Bytes of text that are worked on at once.
BATCH_BYTES = 1 << 20

_PLACE = mix(np.arange(1, SEGMENT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LAST = np.int64(2**63 - 1)


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of all segments of the texts, text by text."""
    data, start, end, words, bound = word_hashes(texts)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bound))
    final = data[end - 1]
    line_ends = np.cumsum(np.concatenate([[0], data == 10]))
    stop = (final == 46) | (final == 33) | (final == 63)  # . ! ?
    stop[:-1] |= (line_ends[start[1:]] != line_ends[end[:-1]]) | (owner[1:] != owner[:-1])
    begin = np.concatenate([[True], stop[:-1]])
    first = np.flatnonzero(begin)
    index = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    place = index % SEGMENT
    at = np.flatnonzero(place == 0)
    sums = mix(np.add.reduceat(words * _PLACE[place], at))
    of = owner[at]
    order = np.lexsort((sums, of))
    same = np.concatenate([[False], (sums[order][1:] == sums[order][:-1]) & (of[order][1:] == of[order][:-1])])
    run = np.flatnonzero(~same)
    nth = np.empty(len(at), np.int64)
    nth[order] = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return of, mix(sums + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _cells(digest: np.ndarray, many: int) -> np.ndarray:
    """The three cells of each digest, one in each third of a sketch."""
    third = np.uint64(many // HASHES)
    return np.stack([(mix(digest + np.uint64((i + 1) * 0xA0761D6478BD642F % (1 << 64))) % third).astype(np.int64) + i * int(third) for i in range(HASHES)])


def sketch(of: np.ndarray, digest: np.ndarray, docs: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums of digests and sums of checks of each document's cells (documents in rows)."""
    at = (_cells(digest, many) + of * many).ravel()
    count = np.bincount(at, minlength=docs * many).astype(np.int64)
    keys, checks = np.zeros(docs * many, np.uint64), np.zeros(docs * many, np.uint64)
    np.add.at(keys, at, np.tile(digest, HASHES))
    np.add.at(checks, at, np.tile(mix(digest ^ np.uint64(0x5851F42D4C957F2D)), HASHES))
    return count.reshape(docs, many), keys.reshape(docs, many), checks.reshape(docs, many)


def peel(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, bits: np.uint64 = np.uint64(2**64 - 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recover what differences of sketches hold: (document, digest, sign) of each element, and whether each document came out whole. bits: those that the checks have."""
    docs, many = count.shape
    count, keys, checks = count.ravel().copy(), keys.ravel().copy(), checks.ravel().copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.arange(docs * many)
    while len(look):
        one = look[np.abs(count[look]) == 1]
        sign = count[one]
        key = np.where(sign > 0, keys[one], np.uint64(0) - keys[one])
        check = np.where(sign > 0, checks[one], np.uint64(0) - checks[one])
        good = (check & bits) == (mix(key ^ np.uint64(0x5851F42D4C957F2D)) & bits)
        one, sign, key = one[good], sign[good], key[good]
        if not len(one):
            break
        doc = one // many
        _, first = np.unique(np.stack([doc.astype(np.uint64), key]), axis=1, return_index=True)
        doc, sign, key = doc[first], sign[first], key[first]
        found.append((doc, key, sign))
        at = (_cells(key, many) + doc * many).ravel()
        up, plus = np.tile(sign, HASHES), np.tile(key, HASHES)
        np.subtract.at(count, at, up)
        np.subtract.at(keys, at, np.where(up > 0, plus, np.uint64(0) - plus))
        mark = mix(plus ^ np.uint64(0x5851F42D4C957F2D))
        np.subtract.at(checks, at, np.where(up > 0, mark, np.uint64(0) - mark))
        look = np.unique(at)
    whole = ~((count != 0) | (keys != 0)).reshape(docs, many).any(axis=1)
    parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)]
    return *parts, whole


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], docs: int, cells: int = CELLS) -> np.ndarray:
    """How many digests differ between version a and version b of each document, retrying in twice the cells where peeling fails."""
    out = np.zeros(docs, np.int64)
    pending = np.arange(docs)
    (of_a, key_a), (of_b, key_b) = a, b
    while len(pending):
        rank = np.full(docs, -1)
        rank[pending] = np.arange(len(pending))
        keep_a, keep_b = rank[of_a] >= 0, rank[of_b] >= 0
        of_a, key_a, of_b, key_b = of_a[keep_a], key_a[keep_a], of_b[keep_b], key_b[keep_b]
        x, y = sketch(rank[of_a], key_a, len(pending), cells), sketch(rank[of_b], key_b, len(pending), cells)
        doc, _, _, whole = peel(*(p - q for p, q in zip(x, y, strict=True)))
        out[pending[whole]] = np.bincount(doc, minlength=len(pending))[whole]
        pending = pending[~whole]
        cells *= 2
    return out


def _texts(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, segments: np.ndarray) -> list[str]:
    """Sketches as text: the number of segments, then counts, digests and checks (32 bits) in base64."""
    rows = np.concatenate([count.astype("<i4").view(np.uint8), keys.astype("<u8").view(np.uint8), (checks & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8)], axis=1)
    return [f"{n}:{base64.b64encode(row.tobytes()).decode()}" for n, row in zip(segments.tolist(), rows, strict=True)]


def likeness(differ: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - differing / all digests; 1 where neither text has any."""
    return 1 - differ / np.maximum(a + b, 1)


def difference(a: str, b: str) -> tuple[list[int], list[int], bool]:
    """What two returned fingerprints say of their texts: (digests that only a has, those that only b has, whether that is all). Texts that differ in more digests than the cells can
    peel give those that come out, and False; their likeness in the result rows comes from sketches of more cells."""

    def read(fingerprint: str) -> tuple[np.ndarray, ...]:
        raw = base64.b64decode(fingerprint.split(":")[1])
        many = len(raw) // 16
        return np.frombuffer(raw, "<i4", many).astype(np.int64), np.frombuffer(raw, "<u8", many, 4 * many), np.frombuffer(raw, "<u4", many, 12 * many)

    count, keys, checks = (x - y for x, y in zip(read(a), read(b), strict=True))
    _, found, sign, whole = peel(count[None], keys[None], checks.astype(np.uint64)[None], np.uint64(0xFFFFFFFF))
    return sorted(found[sign > 0].tolist()), sorted(found[sign < 0].tolist()), bool(whole[0])


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def compare(ids: list[int | None], texts: list[bytes], cells: int = CELLS) -> pa.RecordBatch:
    """The result rows of all texts but the last, each of which is followed by its next document."""
    n = len(ids)
    plain = [t.decode() for t in texts]
    edited = [(a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode() for a, b in zip(plain, plain[1:], strict=False)]
    own, other = digests(texts), digests(edited)
    size = np.bincount(own[0], minlength=n + 1)
    size_edited = np.bincount(other[0], minlength=n)
    later = own[0] > 0
    now = own[0] < n
    here, after = (own[0][now], own[1][now]), (own[0][later] - 1, own[1][later])
    rows = [
        ids,
        [len(t) for t in plain[:n]],
        [hashlib.sha256(t).hexdigest() for t in edited],
        _texts(*sketch(*here, n, cells), size[:n]),
        _texts(*sketch(*other, n, cells), size_edited),
        likeness(differing(here, other, n, cells), size[:n], size_edited),
        likeness(differing(here, after, n, cells), size[:n], size[1 : n + 1]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(r, kind) for r, (_, kind) in zip(rows, _FIELDS, strict=True)], names=[k for k, _ in _FIELDS])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edit, whose second half is the beginning of the next document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(int(_LAST)))
    ranges = max(1, min(MOST_RANGES, -(-rows.count() // RANGE_DOCS)))
    firsts = rows.select(key.alias("k")).repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).collect()
    bounds = np.array(sorted({r["k"] for r in firsts}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(int(_LAST)).to_numpy()
            at = np.searchsorted(bounds, ids, "right") - 1
            yield _dealt(batch, at, ids, False)
            lead = np.flatnonzero(bounds[at] == ids)
            if len(lead):
                yield _dealt(batch.take(pa.array(lead)), (at[lead] - 1) % len(bounds), ids[lead], True)

    def _dealt(batch: pa.RecordBatch, at: np.ndarray, ids: np.ndarray, ahead: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), ahead)), pa.array(ids), batch.column(0), batch.column(1)], names=["range", "ahead", "k", "doc_id", "text"])

    dealt = map_batches(rows, deal, "range long, ahead boolean, k long, doc_id long, text string")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, current = [], [], 0, None
        done = False  # the first document of the next range is there
        for batch in batches:
            for of, ahead, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
                if of != current:
                    ids, texts, size, current, done = [], [], 0, of, False
                if done:
                    continue
                texts.append(text)
                size += len(text)
                if ahead:
                    done = True
                else:
                    ids.append(doc_id)
                if len(texts) > 1 and (done or size >= BATCH_BYTES):
                    if not done:
                        yield compare(ids[:-1], texts)
                        ids, texts, size = ids[-1:], texts[-1:], len(text)
                    else:
                        yield compare(ids, texts)

    spread = dealt.repartition("range").sortWithinPartitions("range", "ahead", "k", "text")
    return map_batches(spread.select("range", "ahead", "doc_id", "text"), stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edits, and their likeness to the edit and to the next document."""
    return fingerprints(table(spark, sf_dir, "documents"))
