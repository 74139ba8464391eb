"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds choose.

Base spans (e-mail addresses, IP addresses, card and phone numbers) are found by fixed patterns from left to right and always stay. The patterns take as much as they can and are not tried
again, so that a phone number followed by a card number is neither. The generators propose more: every stretch of digit groups that may be a number, parts of longer chains, addresses
with other letters or written with "at" and "dot". Proposals overlap. For each kind, gradient-boosted trees, trained here in numpy, judge a proposal by its format (digits, groups,
separators, check digit, labels) and its context (what stands beside it, words before it). Their margins are calibrated on documents that the trees have not seen, and the threshold is the
least one that keeps PRECISION there. Of the proposals beyond it that touch no base span, those of greatest total score that do not overlap are chosen.

There are no labels for this, so labels come from rules, in a bounded sample of SAMPLE_DOCS documents chosen by a hash of the id (at most PER_DOC proposals each): a base span that no letter
or digit touches is one; a proposal that fails its kind's check, or is part of a base span, is none; others are not learnt from. Each positive example is also written in other ways (other
separators, another number behind or before it), and spoilt (a digit changed, cut or lost), which makes negatives.

Defined results: null and empty texts have no spans; the sample leaves out rows of a null id; without any example only base spans are given; repeated rows are each worked out; further
columns do not matter. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append_columns, free_name, map_batches, slices, table, utf8

#: In the order of the spans' text.
KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, PER_DOC = 20_000, 20
#: Characters of context that an example keeps on either side.
CONTEXT = 40
PRECISION = 0.995

Span = tuple[int, int]

# The base patterns, written so that long runs of digits are read once. Their matches are the same.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_GROUP = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_DIALLED = re.compile(r"(?:\+|\b00)[0-9][\x20().0-9-]*")
_NATIONAL = re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_AT = re.compile(r"@|＠|\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?")
_ANY_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?)[\w-]+)+")
_ANYTHING = re.compile(rb"[0-9@]|\xef\xbc\xa0|[\[({<]\s?(?:at|AT)\s?[\])}>]")
_HINTS = tuple(re.compile(p, re.I) for p in (r"mail|contact|write|@", r"\bip\b|host|server|addr", r"card|visa|carte|karte|tarjeta|pay", r"tel|phone|call|fax|mobil|téléphone"))


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = "0246813579"
    return sum(ord(doubled[ord(c) - 48]) - 48 if i & 1 else ord(c) - 48 for i, c in enumerate(reversed(digits))) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_GROUP.findall(text))


def valid(kind: str, text: str) -> bool:
    """A kind's check of a text that its pattern has matched."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in text.split("."))
    digits = _only_digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _emails(text: str) -> Iterator[Span]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            low = domain.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Each kind's base spans, from left to right."""
    found = {"email": list(_emails(text))}
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found[kind] = [m.span() for m in pattern.finditer(text) if valid(kind, m.group())]
    return found


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of everything that may be personal data. Few for each start, however long a chain is."""
    low = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > low and start > at.start() - 64 and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
            start -= 1
        low = at.end()
        if start < at.start() and (domain := _ANY_DOMAIN.match(text, at.end(), at.end() + 256)):
            yield "email", start, domain.end()
    for chain in _CHAIN.finditer(text):
        parts = [m.span() for m in _GROUP.finditer(text, *chain.span())]
        for first, last in zip(parts, parts[3:]):  # noqa: B905  shorter by three
            yield "ip", first[0], last[1]
    for chain in _CARD.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *chain.span())]
        for i, (start, _) in enumerate(groups):
            many = 0
            for a, b in groups[i : i + 6]:
                many += b - a
                if many > 19 or (b - a < 3 and many < 13):
                    break
                if many >= 14:
                    yield "card", start, b
    for chain in _DIALLED.finditer(text):
        many = 0
        for m in _GROUP.finditer(text, *chain.span()):
            many += m.end() - m.start()
            if many > 15:
                break
            if many >= 8:
                yield "phone", chain.start(), m.end()
    for m in _NATIONAL.finditer(text):
        yield "phone", *m.span()


def _sort_of(c: str) -> int:
    """0: nothing or white space, 1: sign, 2: letter, 3: digit."""
    return 0 if not c or c.isspace() else 3 if c in "0123456789" else 2 if c.isalpha() else 1


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """A proposal's format and context as numbers."""
    s = text[start:end]
    groups = _GROUP.findall(s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + 3]
    local, _, domain = s.partition("@")
    labels = domain.split(".") if domain else [""]
    return [
        len(s), len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), float(len(digits) > 1 and luhn(digits)), int(digits[0]) if digits else -1, len(set(digits)),
        s.count(" "), s.count("-"), s.count("."), s.count("("), float(s[:1] == "+"), float(s[:2] == "00"),
        max((int(g[-3:]) if len(g.lstrip("0")) <= 3 else 999 for g in groups), default=-1), float(any(len(g) > 1 and g[0] == "0" for g in groups)),
        _sort_of(left[-1:]), _sort_of(right[:1]), float(left[-2:-1] in tuple("0123456789") and left[-1:] in tuple(" -.(")), float(right[1:2] in tuple("0123456789") and right[:1] in tuple(" -.")),
        float("@" in s), len(labels), len(labels[-1]), float(labels[-1].isalpha()), len(local), float(s.isascii()), float(bool(_HINTS[KINDS.index(kind)].search(left))),
    ]


@dataclass
class Trees:
    """Gradient-boosted trees of equal depth on the logistic loss, and a calibration of their sum."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
        """Each tree splits where the sum of squared gradients over curvature gains most, by histograms of each feature's quantiles."""
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1], method="lower")) for f in range(width)]
        place = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        flat = place + np.arange(width) * bins
        nodes, total = (1 << depth) - 1, np.zeros(n)
        feature, limit, leaf = np.zeros((rounds, nodes), np.int64), np.full((rounds, nodes), np.inf), np.zeros((rounds, nodes + 1))
        for t in range(rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for k in range(nodes):
                rows = np.flatnonzero(node == k)
                if len(rows) > 1:
                    cells = flat[rows].ravel()
                    left_g, left_h = (np.bincount(cells, np.repeat(v[rows], width), width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h))
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        feature[t, k], limit[t, k] = f, edges[f][b]
                node[rows] = 2 * k + 1 + (x[rows, feature[t, k]] > limit[t, k])
            last = node - nodes
            leaf[t] = rate * np.bincount(last, g, nodes + 1) / (np.bincount(last, h, nodes + 1) + ridge)
            total += leaf[t][last]
        return cls(feature, limit, leaf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows, nodes = np.zeros(len(x)), np.arange(len(x)), self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while nodes and node[:1].size and node[0] < nodes:  # all rows are at one depth
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - nodes]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> None:
        """A logistic curve over the margins of unseen examples, and the least threshold of at least a half with so many right among what it lets through."""
        if not 0 < y.sum() < len(y):
            return
        z = np.stack([self.margin(x), np.ones(len(x))], axis=1)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        prior = np.array([1.0, 0.0])
        loss = lambda w: float((np.logaddexp(0, z @ w) - target * (z @ w)).sum() + ((w - prior) ** 2).sum() / 2)
        weights = prior
        for _ in range(50):  # Newton's steps, each halved until it helps
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -40, 40)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.eye(2), z.T @ (target - p) - (weights - prior))
            size = 1.0
            while size > 1e-4 and loss(weights + size * step) > loss(weights):
                size /= 2
            if size <= 1e-4 or np.abs(step).max() < 1e-9:
                break
            weights = weights + size * step
        self.slope, self.shift = float(weights[0]), float(weights[1])
        p = self.probability(x)
        by = np.argsort(-p, kind="stable")
        right = np.cumsum(y[by]) / np.arange(1, len(y) + 1)
        last_of_equals = np.append(p[by][1:] != p[by][:-1], True)
        good = np.flatnonzero((right >= precision) & last_of_equals)
        self.threshold = max(0.5, float(p[by][good[-1]])) if len(good) else 1.0


def label(kind: str, text: str, start: int, end: int, base: dict[str, list[Span]]) -> int | None:
    """1: a base span that stands free; 0: no such thing, or part of a base span; None: not known."""
    if (start, end) in base[kind]:
        free = not (text[start - 1 : start].isalnum() if start else False) and not text[end : end + 1].isalnum()
        return 1 if free else None
    if kind != "email" and not valid(kind, text[start:end]):
        return 0
    return 0 if any(a < end and start < b for spans in base.values() for a, b in spans) else None


def _variants(kind: str, text: str, start: int, end: int, seed: int) -> Iterator[tuple[int, str, int, int]]:
    """(label, text, start, end): a positive example written in other ways, and spoilt."""
    left, s, right = text[:start], text[start:end], text[end:]
    made = lambda y, new, before=left, after=right: (y, before + new + after, len(before), len(before) + len(new))
    digits = _only_digits(s)
    other = "38.253.197.126", "4880761348116108", "+1 (853) 555-7168"
    if kind == "email":
        yield made(1, s.replace("@", " [at] ").replace(".", " [dot] "))
        yield made(1, s.replace("@", "＠"))
        yield made(0, s.split("@")[0] + "@" + s.split("@")[1].split(".")[0])
        yield made(0, "look(at)this.now")
        return
    at = seed % len(s)
    while s[at] not in "0123456789":
        at = (at + 1) % len(s)
    if kind == "ip":
        parts = s.split(".")
        yield made(0, ".".join([*parts[:3], str(256 + seed % 700)]))
        yield made(0, ".".join(parts[:2] + [str(300 + seed % 600)] + parts[3:]))
        yield made(1, s, left, f" {other[1]}{right}")
        yield made(1, s, f"{left}{other[2]} ")
        yield made(0, s, left, "." + str(seed % 255) + right)
        return
    if kind == "card":
        yield made(0, s[:at] + str((int(s[at]) + 1 + seed % 9) % 10) + s[at + 1 :])
        yield made(0, s[:-1])
        yield made(0, s[1:])
        grouped = (" ", "-")[seed % 2].join(digits[i : i + 4] for i in range(0, len(digits), 4))
        yield made(1, grouped)
        yield made(1, s, f"{left}{other[2]} ")
        yield made(1, s, f"{left}{other[0]} ")
        yield made(1, s, left, f" {other[0]}{right}")
        y = made(0, s + " 38", left, ".253.197.126" + right)
        yield y
        yield made(0, "7168 " + s, f"{left}+1 (853) 555-")
        return
    yield made(0, s[: max(3, len(s) - 6)])
    yield made(1, re.sub(r"[() -]+", ".", s).strip("."))
    yield made(1, re.sub(r"[() -]+", " ", s).strip())
    for more in other[:2]:
        yield made(1, s, left, f" {more}{right}")
        # The number that swallows the beginning of the next one.
        piece = _GROUP.match(more).group()
        yield made(0, f"{s} {piece}", left, f"{more[len(piece) :]}{right}")
    groups = [m.end() for m in _GROUP.finditer(s)]
    if len(groups) > 1:
        yield made(0, s[: groups[-2]], left, s[groups[-2] :] + right)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> dict[str, Trees]:
    """Trees of each kind, from a bounded sample; kinds without examples have none."""
    many = docs.count()
    if not many:
        return {}
    share = F.lit(min(1.0, sample_docs / many) * 1_000_000)
    some = docs.where((F.pmod(F.xxhash64(id_col, F.lit(13)), F.lit(1_000_000)) < share) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for raw in utf8(batch.column(0)):
                if not _ANYTHING.search(raw):
                    continue
                text = raw.decode()
                base, own = base_spans(text), []
                for kind, start, end in proposals(text):
                    y = label(kind, text, start, end, base)
                    if y is not None:
                        low = max(0, start - CONTEXT)
                        piece = text[low : end + CONTEXT]
                        own.append((zlib.crc32(piece.encode()), kind, y, piece, start - low, end - low))
                rows += sorted(own)[:PER_DOC]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "kind", "y", "piece", "start", "stop"])

    found = map_batches(some.select(F.col(text_col).alias("text")), examples, "seed long, kind string, y int, piece string, start int, stop int").collect()
    return fit(sorted({tuple(r) for r in found}))


def fit(found: list[tuple[int, str, int, str, int, int]]) -> dict[str, Trees]:
    """Trees from examples (seed, kind, label, text, start, end). Three of ten calibrate, by their seed."""
    out = {}
    for kind in KINDS:
        parts: tuple[list, list] = ([], [])
        for seed, of, y, text, start, end in found:
            if of == kind:
                rows = [(y, text, start, end)] + ([v for v in _variants(kind, text, start, end, seed)] if y else [])
                parts[seed % 10 < 3].extend(rows)
        if not any(r[0] for r in parts[0]):
            continue
        x, y = ([np.asarray([features(kind, *r[1:]) for r in rows], float).reshape(len(rows), -1) for rows in parts], [np.asarray([r[0] for r in rows], float) for rows in parts])
        trees = Trees.fit(x[0], y[0])
        trees.calibrate(*((x[1], y[1]) if len(y[1]) else (x[0], y[0])))
        out[kind] = trees
    return out


def choose(found: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans (score, kind, start, end) of greatest total score that do not overlap; the earlier end wins ties."""
    found = sorted(found, key=lambda f: (f[3], f[2], f[1]))
    ends, best, take = [f[3] for f in found], [0.0], []
    for i, (score, _, start, _) in enumerate(found):
        before = bisect_right(ends, start, 0, i)
        take.append((best[before] + score > best[i], before))
        best.append(max(best[i], best[before] + score))
    out, i = [], len(found)
    while i:
        taken, before = take[i - 1]
        if taken:
            out.append(found[i - 1][1:])
        i = before if taken else i - 1
    return out[::-1]


def find(texts: list[str], models: dict[str, Trees]) -> list[tuple[dict[str, list[Span]], list[tuple[str, int, int]]]]:
    """Each text's base spans, and those that the trees add."""
    base = [base_spans(t) for t in texts]
    asked: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}
    for i, text in enumerate(texts):
        taken = sorted(s for spans in base[i].values() for s in spans)
        starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        for kind, start, end in dict.fromkeys(proposals(text)):
            before = bisect_right(starts, end - 1)
            if kind in models and not (before and reach[before - 1] > start):
                asked[kind].append((i, start, end))
    passed: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    for kind, rows in asked.items():
        for low in range(0, len(rows), 4096):
            some = rows[low : low + 4096]
            p = models[kind].probability(np.asarray([features(kind, texts[i], a, b) for i, a, b in some], float))
            for (i, a, b), score in zip(some, p.tolist(), strict=True):
                if score >= models[kind].threshold:
                    passed[i].append((score, kind, a, b))
    return [(b, choose(p)) for b, p in zip(base, passed, strict=True)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])
_NOTHING = ({k: [] for k in KINDS}, [])


def find_pii(docs: DataFrame, models: dict[str, Trees], keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of docs with the numbers of base spans, their digest, all spans and how many the trees have added."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a few thousand numbers
    name = free_name("_text", keep, _FOUND.names)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        columns: list[list] = [[] for _ in _FOUND]
        for part in slices(batch):
            texts = [t or b"" for t in utf8(part.column(part.schema.get_field_index(name)))]
            some = [i for i, t in enumerate(texts) if _ANYTHING.search(t)]
            found = dict(zip(some, find([texts[i].decode() for i in some], shared.value), strict=True))
            for i in range(len(texts)):
                base, added = found.get(i, _NOTHING)
                plain = [(k, *s) for k in KINDS for s in base[k]]
                row = [*(len(base[k]) for k in KINDS), hashlib.sha256(listed(plain).encode()).hexdigest(), listed(plain + added), len(added)]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        return [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(columns, _FOUND, strict=True)]

    return append_columns(docs.select(*[F.col(k) for k in keep], F.col(text_col).alias(name)), keep, _FOUND, run)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, train(docs), ["doc_id"])
