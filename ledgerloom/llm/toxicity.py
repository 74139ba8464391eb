"""Toxicity by a lexicon that is matched with misspellings and read in context.

The lexicon is learnt: words that many toxic and few other labelled documents hold. Its trie is intersected with Levenshtein automata into one
deterministic automaton, built as its states are met, which a word walks through byte by byte and mostly leaves after two or three. Each hit is
read in a window of words: between quotation marks, or beside a verb of reporting, it counts as quoted, else as abuse. A logistic model over the counts
gives the score.

Training takes a bounded sample: at most SAMPLE documents of each label, those of least hash. So the lexicon is bounded, as each of its words is in a share of the sample's toxic
documents, and so are the ordinary words near it: misspellings that the sample's other documents hold.

Defined results: null and empty texts score as a text without a hit; without labelled rows of both kinds every score is 0; a document that is labelled
twice counts as toxic if any label says so; null labels and ids teach nothing; repeated rows are each scored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append_columns, free_name, map_batches, materialize, table, utf8, worker_state
from ledgerloom.llm.minhash import signatures

SAMPLE = {1: 4000, 0: 12_000}
THRESHOLD = 0.7
#: A lexicon word is in at least this share (and number) of the toxic documents, near copies counted once, and so many times likelier there than elsewhere.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO = 0.008, 5, 20.0
#: Where a feature is too rare to be learnt, its weight stays near this.
PRIOR = (3.0, 2.0, 1.0, 0.5, 0.0)
#: Words of at least so many characters may be misspelled by one edit, by two from the second length on.
ONE_EDIT, TWO_EDITS = 5, 11
#: Words on either side of a hit that tell a quotation from abuse.
CONTEXT = 8
#: Distinct words whose result a Python worker remembers.
REMEMBERED = 200_000

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_REPORTING = frozenset(b"said says wrote writes quote quoted quotes quoting called calls asked replied reported according alleged".split())
_MARKS = re.compile(r'["“”„«»]')


class Lexicon:
    """A trie of words and the automaton of all strings within each word's edit distance."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.limit = [2 if len(w) >= TWO_EDITS else 1 if len(w) >= ONE_EDIT else 0 for w in words]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some word below a node allows
        for k, word in enumerate(words):
            node = 0
            for c in word:
                self.most[node] = max(self.most[node], self.limit[k])
                if c not in self.children[node]:
                    self.children[node][c] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
            self.ends[node] = k
            self.most[node] = max(self.most[node], self.limit[k])
        self.letters = frozenset("".join(words))
        self.reach = range(min(map(len, words), default=0) - 2, max(map(len, words), default=-1) + 3)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, reached: set[tuple[int, int]]) -> int:
        """The number of a set of (trie node, edits so far), with the words' letters that may be left out."""
        best: dict[int, int] = {}
        todo = list(reached)
        while todo:
            node, edits = todo.pop()
            if edits > self.most[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and e <= self.limit[self.ends[n]]]
            self.accepts.append(min(ends)[::-1] if ends else None)
        return self.states[key]

    def find(self, word: str) -> tuple[int, int] | None:
        """(index of the nearest lexicon word, edits) if one is near enough."""
        if len(word) not in self.reach:
            return None
        state = self.start
        for c in word:
            c = c if c in self.letters else ""
            to = self.next[state].get(c)
            if to is None:
                reached = set()
                for node, edits in self.sets[state]:
                    reached.add((node, edits + 1))  # a letter too many
                    for letter, child in self.children[node].items():
                        reached.add((child, edits + (letter != c)))
                to = self.next[state][c] = self._state(reached)
            state = to
            if not self.sets[state]:
                return None
        return self.accepts[state]


@dataclass
class _Known:
    """The automaton, the words it was asked about, and those that are hits."""

    lexicon: Lexicon
    seen: set[bytes] = field(default_factory=set)
    hits: dict[bytes, tuple[int, int]] = field(default_factory=dict)


@dataclass
class ToxicModel:
    """What is learnt: the lexicon's words and the weights of the features."""

    words: list[str]
    weights: list[float]
    ordinary: frozenset[str] = frozenset()
    threshold: float = THRESHOLD
    def features(self, text: bytes) -> list[float]:
        """log(1 + n) of abusive and quoted hits, spelled right and wrong; hits in a hundred words."""
        known = worker_state("toxicity", self, lambda: _Known(Lexicon(self.words)))
        words = text.translate(_WORDS).split()
        distinct = set(words)
        for word in distinct - known.seen:
            known.seen.add(word)
            spelled = word.decode("utf-8", "replace")
            if (found := known.lexicon.find(spelled)) and not (found[1] and spelled in self.ordinary):
                known.hits[word] = found
        counts = [0, 0, 0, 0]
        if distinct & known.hits.keys():
            quoted = _quotation(text, words)
            for i, word in enumerate(words):
                if word in known.hits:
                    counts[2 * quoted(i) + (known.hits[word][1] > 0)] += 1
        if len(known.seen) > REMEMBERED:
            known.seen, known.hits = set(), {}
        return [*(math.log1p(n) for n in counts), min(1.0, 10 * (counts[0] + counts[1]) / max(len(words), 20))]

    def score(self, text: bytes) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, self.features(text), strict=False))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _quotation(text: bytes, words: list[bytes]):
    """Whether the word of a number stands in a quotation: inside a pair of marks in its window, or beside a verb of reporting."""
    inside = np.frombuffer(text.translate(_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))

    def quoted(i: int) -> bool:
        first, last = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
        if not _REPORTING.isdisjoint(words[first:last]):
            return True
        before = text[edge[2 * first] : edge[2 * i]].decode("utf-8", "ignore")
        after = text[edge[2 * i + 1] : edge[2 * last - 1]].decode("utf-8", "ignore")
        left, right = _MARKS.findall(before), _MARKS.findall(after)
        if not left or not right:
            return False
        if left[-1] == '"':
            return left.count('"') % 2 == 1 and '"' in right
        return left[-1] in "“„«" and right[0] in "”“»"

    return quoted


def _fit(features: np.ndarray, label: np.ndarray, ridge: float = 0.001, rounds: int = 60) -> list[float]:
    """Weights (the constant last) of a logistic regression in which both labels weigh alike, by Newton's method; a ridge draws them to PRIOR, and none but the constant is negative."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    prior, penalty = np.array([*PRIOR, 0.0]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (share * (p - label)) + penalty * (w - prior)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _copies(rows: list[tuple[int, list[int] | None]]) -> list[tuple[int, int]]:
    """(id, group): documents of a sample that share a band of their MinHash signatures are in one group."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    first: dict[int, int] = {}
    for key, bands in rows:
        find(key)
        for band in bands or ():
            root[find(key)] = find(first.setdefault(band, key))
    return [(key, find(key)) for key, _ in rows]


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", spelledcol: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> ToxicModel:
    """Learn from a bounded sample of the labelled documents that `usable` (over the labels' rows) marks."""
    marked = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    marked = materialize(marked, "labels")
    chosen = None
    for kind, most in (sample or SAMPLE).items():
        part = marked.where(F.col("label") == kind).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "label-sample")
    rows = docs.select(F.col(id_col).alias("id"), F.col(spelledcol).alias("text")).join(F.broadcast(chosen), "id")  # a sample of fixed size
    rows = materialize(rows.select("id", "label", "text"), "toxic-sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return ToxicModel([], [])

    spark = docs.sparkSession
    signed = signatures(rows.where("label = 1").withColumnRenamed("id", "doc_id")).select("doc_id", "bands").collect()  # of the sample
    groups = spark.createDataFrame(_copies([(r[0], r[1]) for r in signed]), "id long, of long")

    def distinct(batches):
        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = [w.decode("utf-8", "replace") for w in set((text or b"").translate(_WORDS).split())]
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(words), pa.int64()), pa.array(words, pa.string())], names=["of", "word"])

    toxic = map_batches(rows.where("label = 1").join(F.broadcast(groups), "id").select("of", "text"), distinct, "of long, word string").distinct().groupBy("word").agg(F.count("*").alias("toxic"))
    other = map_batches(rows.where("label = 0").select(F.lit(0).cast("long"), "text"), distinct, "of long, word string").groupBy("word").agg(F.count("*").alias("other"))
    kinds = len({r[0] for r in groups.select("of").distinct().collect()})
    ratio = ((F.col("toxic") + 0.5) / (kinds + 1)) / ((F.coalesce("other", F.lit(0)) + 0.5) / (sizes[0] + 1))
    frequent = toxic.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * kinds)) & (F.length("word") >= 3))
    kept = frequent.join(other, "word", "left").where(ratio >= LEAST_RATIO)
    lexicon = sorted(r[0] for r in kept.select("word").collect())
    near = spark.sparkContext.broadcast(ToxicModel(lexicon, []))

    def misspelled(batches):
        find = Lexicon(near.value.words).find
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [w for w in words if (hit := find(w)) and hit[1]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    ordinary = map_batches(other.select("word"), misspelled, "word string").collect()  # of the sample's words
    model = ToxicModel(lexicon, [], frozenset(r[0] for r in ordinary))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([shared.value.features(t or b"") for t in utf8(batch.column(1))], pa.list_(pa.float64()))]

    made = append_columns(rows.select("label", "text"), ["label"], T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))]), measure).collect()  # of the sample
    return ToxicModel(lexicon, _fit(np.array([r[1] for r in made], float), np.array([r[0] for r in made])), model.ordinary)


_SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: ToxicModel, keep: list[str], spelledcol: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns `keep` of docs with the score of every whole text, and 1 where it reaches the model's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred words
    of_text = free_name("_text", keep, list(names))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = [shared.value.score(t or b"") for t in utf8(batch.column(batch.schema.get_field_index(of_text)))]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= model.threshold) for s in scores], pa.int32())]

    new = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, _SCORED, strict=True)])
    return append_columns(docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{spelledcol}`").alias(of_text)), keep, new, run)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 3; they teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
