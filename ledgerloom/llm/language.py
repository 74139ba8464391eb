"""Language identification by a byte convolutional network, trained here in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes (the last one of a longer text ends with the text; a shorter text is padded with zero bytes).
Bytes are embedded, filters of several widths run over them, each filter keeps its maximum in the window, and a softmax over
languages follows. A text's probabilities are the mean of its windows'.

Training takes a bounded sample: about SAMPLE_DOCS documents of each language, chosen by a hash of the id, and at most SAMPLE_WINDOWS windows of each.

Defined results: null text, or text without a letter, is `und` with score 0; rows without language or id teach nothing; repeated rows are each scored; without
any labelled row every text is `und`. The network sees nothing but the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append_columns, free_name, map_batches, slices, table, utf8, worker_state

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
SAMPLE_DOCS, SAMPLE_WINDOWS = 600, 4
BATCH_WINDOWS = 32
UNDETERMINED = "und"

_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class ByteNet:
    """The network's weights."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        filters = [normal(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS]
        width = len(WIDTHS) * FILTERS
        return cls(languages, normal(256, EMBED, scale=1.0), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(width, len(languages), scale=width**-0.5), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.dense, self.dense_bias]

    def pooled(self, windows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Each filter's maximum (before bias) in each window, where it is, and the embedded bytes."""
        x = self.embed[windows]
        best, at = [], []
        for w, kernel in zip(WIDTHS, self.filters, strict=True):
            long = windows.shape[1] - w + 1
            columns = np.concatenate([x[:, j : j + long] for j in range(w)], axis=2)
            z = (columns.reshape(-1, w * EMBED) @ kernel).reshape(len(windows), long, FILTERS)
            at.append(z.argmax(axis=1))
            best.append(np.take_along_axis(z, at[-1][:, None], 1)[:, 0])
        return best, at, x

    def tables(self) -> tuple[np.ndarray, ...]:
        """What each pair of bytes adds to each filter of width 2, 3 and 4 (first and second half), and each third byte of width 3.

        A filter over embedded bytes is a sum of one term for each byte, so these tables are the convolution itself, worked out once.
        """
        term = [np.stack([self.embed @ k[j * EMBED : (j + 1) * EMBED] for j in range(w)]) for w, k in zip(WIDTHS, self.filters, strict=True)]
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(1 << 16, FILTERS))
        two, three, four = term
        return pair(two[0], two[1]), pair(three[0], three[1]), np.ascontiguousarray(three[2]), pair(four[0], four[1]), pair(four[2], four[3])

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """The languages' probabilities in each window."""
        byte = np.ascontiguousarray(windows.T).astype(np.intp)  # position by position, so that maxima run over whole rows
        pair, many = byte[:-1] * 256 + byte[1:], len(windows)
        look = lambda table, index: np.take(table, index.ravel(), axis=0, mode="clip").reshape(len(index), many * FILTERS)
        two, three, third, four, fourth = tables
        z3 = look(three, pair[:-1])
        z3 += look(third, byte[2:])
        z4 = look(four, pair[:-2])
        z4 += look(fourth, pair[2:])
        best = [z.max(axis=0).reshape(many, FILTERS) for z in (look(two, pair), z3, z4)]
        hidden = np.concatenate([np.maximum(z + b, 0) for z, b in zip(best, self.bias, strict=True)], axis=1)
        return _softmax(hidden @ self.dense + self.dense_bias)

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy, in the order of weights()."""
        best, at, x = self.pooled(windows)
        hidden = np.concatenate([np.maximum(z + b, 0) for z, b in zip(best, self.bias, strict=True)], axis=1)
        error = _softmax(hidden @ self.dense + self.dense_bias)
        error[np.arange(len(label)), label] -= 1
        error /= len(label)
        back = (error @ self.dense.T) * (hidden > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        rows = np.arange(len(windows))[:, None, None]
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            place = at[i][:, :, None] + np.arange(w)  # window, filter, byte of the filter
            patch = x[rows, place].reshape(len(windows), FILTERS, w * EMBED)
            d_filters.append(np.einsum("bfk,bf->kf", patch, g))
            d_bias.append(g.sum(axis=0))
            spread = (g[:, :, None] * self.filters[i].T[None]).reshape(len(windows), FILTERS, w, EMBED)
            np.add.at(d_embed, windows[rows, place], spread)
        return [d_embed, *d_filters, *d_bias, hidden.T @ error, error.sum(axis=0)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, and the text of each."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        many = max(1, -(-len(text) // WINDOW))
        owner += [i] * many
        parts.append(text.ljust(WINDOW, b"\0") if many == 1 else text[: (many - 1) * WINDOW] + text[-WINDOW:])
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW), np.asarray(owner)


def fit(samples: list[tuple[str, bytes]], steps: int = 900, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> ByteNet:
    """Train on (language, bytes) samples by Adam. Each step takes every language alike, and cuts a third of its windows short."""
    languages = sorted({lang for lang, _ in samples})
    net = ByteNet.fresh(languages, seed)
    rng = np.random.default_rng(seed)
    by = [[text for lang, text in samples if lang == x] for x in languages]
    mean, square = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(languages), batch)
        texts = []
        for k in label:
            text = by[k][rng.integers(len(by[k]))]
            if rng.random() < 0.35:
                size = int(rng.integers(4, 64))
                first = int(rng.integers(0, max(1, len(text) - size)))
                text = text[first : first + size]
            texts.append(text[:WINDOW].ljust(WINDOW, b"\0"))
        windows = np.frombuffer(b"".join(texts), np.uint8).reshape(batch, WINDOW)
        pace = rate * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), net.gradients(windows, label), mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> ByteNet | None:
    """Train on a bounded sample of the labelled rows that `usable` marks."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_docs / n))])
    chosen = labelled.where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000) & F.col("text").isNotNull())

    def windows(batches):
        for batch in batches:
            for part in slices(batch):
                langs, texts = [], []
                for lang, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    if not any(c.isalpha() for c in text.decode()):
                        continue
                    pieces = cut([text])[0]
                    step = max(1, len(pieces) // SAMPLE_WINDOWS)
                    for piece in pieces[::step][:SAMPLE_WINDOWS]:
                        langs.append(lang)
                        texts.append(piece.tobytes().rstrip(b"\0"))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.binary())], names=["lang", "piece"])

    most = 2 * sample_docs * SAMPLE_WINDOWS * len(counts)
    rows = map_batches(chosen.select("lang", "text"), windows, "lang string, piece binary").limit(most).collect()
    samples = sorted((r[0], bytes(r[1])) for r in rows)
    return fit(samples) if samples else None


_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, net: ByteNet | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of docs with lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    name = free_name("_text", keep, _PREDICTED.names)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        net = shared.value
        tables = worker_state("language", net, net.tables) if net else ()
        langs, scores = [], []
        for part in slices(batch, 1 << 20):
            texts = [t or b"" for t in utf8(part.column(part.schema.get_field_index(name)))]
            some = [bool(net) and bool(_LETTER.search(t) or any(c.isalpha() for c in t.decode())) for t in texts]
            kept = [t for t, s in zip(texts, some, strict=True) if s]
            total = np.zeros((len(kept), len(net.languages) if net else 1))
            if kept:
                windows, owner = cut(kept)
                p = np.concatenate([net.probabilities(windows[i : i + BATCH_WINDOWS], tables) for i in range(0, len(windows), BATCH_WINDOWS)])
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                total = np.add.reduceat(p.astype(np.float64), first, axis=0) / np.bincount(owner)[:, None]
            at = iter(total)
            for s in some:
                row = next(at) if s else None
                langs.append(net.languages[int(row.argmax())] if s else UNDETERMINED)
                scores.append(float(min(1.0, row.max())) if s else 0.0)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(docs.select(*[F.col(k) for k in keep], F.col(text_col).alias(name)), keep, _PREDICTED, run)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; those whose crc32(doc_id) mod 4 is 2 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = train(docs, ~held)
    return predict(docs, net, ["doc_id"]).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
