"""Best-fit packing of token sequences by a configuration linear program over the histogram of lengths.

Texts are tokenised in Spark and cut into pieces. Only the histogram of piece lengths (as many rows as a sequence has tokens, whatever the
corpus) comes to the driver, where the packing is planned:

* The covering program (least number of configurations that cover every length's demand) is solved by multiplicative
  weights; a pricing is one unbounded knapsack dynamic program, from which the best configurations of several sizes are read. Lengths count in classes of GRID tokens.
* Rounding: configurations are placed in order of their amounts, fractions carried on, and filled with real lengths whose errors against their classes make good each other. The
  program is solved again for what is left until it places no more. The rest, and the shortest pieces, go longest first to the fullest sequence that still holds them. Equal
  sequences are one run with a count, so the work depends on the number of lengths, not of documents.

Pieces get their places by rank among the pieces of their length. The rank is counted in salted parts, so a length that a third of all pieces have
is no single task.

Defined results: a null or empty text is the end token alone; repeated documents are packed each by itself, as are those with a null id, which stays null; other columns are
ignored; no documents make no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append_columns, materialize, table, utf8, worker_state

CAPACITY = 4096
END_ID = 1
#: Lengths count in classes of GRID tokens, in coarser ones up to COARSEST for what the finer cannot place; FILLERS of all pieces, the shortest, are kept to fill gaps.
GRID, COARSEST, FILLERS = 8, 32, 0.05
#: Distinct words whose ids a Python worker keeps; twice as many while it replaces them.
CACHED_WORDS = 200_000
#: Ranks are counted in parts of about so many pieces, in SALTS parts of a length at most.
PART_ROWS, SALTS = 2_000, 1_024

_PIECES = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("piece", "start", "length", "ids_crc32")]))
_ARROW_PIECES = pa.list_(pa.struct([(k, pa.int64()) for k in ("piece", "start", "length", "ids_crc32")]))


def _byte_symbols() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_SYMBOLS = _byte_symbols()
#: A word of letters and then punctuation, which the tokenizer splits there.
_PLAIN = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")


class WordIds:
    """Ids of texts by a byte-level tokenizer, each distinct word between ASCII white space looked up once.

    The tokenizer never joins characters across white space. A word of Latin letters with punctuation after it goes
    straight to the tokenizer's model, without its normaliser and splitter; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def whole(self, word: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        found = _PLAIN.fullmatch(word.lower())
        if not found:
            return self.whole(word)
        letters, tail = found.groups()
        if not letters.isascii():
            text = letters.decode().lower()
            if not text.isalpha() or max(text) >= "\u0250":
                return self.whole(word)
            letters = text.encode()
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {b"": b""}
            self.tails[tail] = self.whole(tail)
        return array("I", [t.id for t in self.model.tokenize(letters.decode("latin-1").translate(_SYMBOLS))]).tobytes() + self.tails[tail]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [text.split() for text in texts]
        for word in set().union(*split) - self.words.keys():
            self.words[word] = self.older.get(word) or self.word(word)
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        if len(self.words) > self.most:
            self.words, self.older = {}, self.words
        return out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: a document's ids and then end_id, cut every `capacity` ids."""
    last = np.asarray([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for ids in worker_state("packing", tokenizer_path, lambda: WordIds(tokenizer_path))([t or b"" for t in utf8(batch.column(1))]):
            ids += last
            step = 4 * capacity
            rows.append([{"piece": i, "start": i * capacity, "length": len(part := ids[i * step : (i + 1) * step]) // 4, "ids_crc32": zlib.crc32(part)} for i in range(-(-len(ids) // step))])
        return [pa.array(rows, _ARROW_PIECES)]

    made = append_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], T.StructType([T.StructField("pieces", _PIECES)]), cut)
    return made.select("doc_id", F.inline("pieces"))


#: Shares of the sequences, loosest first, that are taken apart in search of a better end.
REPAIRS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)


class _Runs:
    """Runs of equal sequences: [number, gap, [(length, copies), ...]], found by gap."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_gap, self.gaps = capacity, {}, []

    def add(self, number: int, gap: int, held: list) -> None:
        if number:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((number, held))

    def take(self, least: int):
        at = bisect_left(self.gaps, least)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        number, held = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[at]
        return number, gap, held

    def fit(self, length: int, count: int) -> None:
        """Best fit of `count` pieces of one length."""
        while count:
            number, gap, held = self.take(length) or (count, self.capacity, [])
            copies = gap // length
            full = min(number, count // copies)
            self.add(full, gap - copies * length, [*held, (length, copies)])
            count -= full * copies
            number -= full
            if number and count and count < copies:
                self.add(1, gap - count * length, [*held, (length, count)])
                number, count = number - 1, 0
            if gap < self.capacity or held:
                self.add(number, gap, held)

    def all(self) -> list[tuple[int, list]]:
        return [run for gap in self.gaps for run in self.by_gap[gap]]


def _filled(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest value of every filled capacity, and the size taken last for it: an unbounded knapsack by dynamic programming. sizes ascend."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    count = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(int(sizes[0]), capacity + 1):
        n = count[room]
        total = best[room - sizes[:n]]
        total += value[:n]
        k = int(total.argmax())
        if total[k] > best[room - 1]:
            best[room], last[room] = total[k], k
        else:
            best[room] = best[room - 1]
    return best, last


def _configuration(first: int, last: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """The size `first` and the best filling of what it leaves."""
    chosen, room = {first: 1}, capacity - int(sizes[first])
    while room > 0:
        if (k := int(last[room])) < 0:
            room -= 1
            continue
        chosen[k] = chosen.get(k, 0) + 1
        room -= int(sizes[k])
    return chosen


def configuration_lp(sizes: list[int], demand: list[float], capacity: int, step: float = 0.34, columns: int = 32) -> list[tuple[dict[int, int], float]]:
    """A near-optimal fractional cover by multiplicative weights: (copies by index of size, number of such sequences).

    A size's weight falls exponentially with the share of its demand that is covered. Each pricing adds, for the `columns` sizes covered least, the configuration of highest weight
    that holds the size, by as much as covers `step` of the demand of one of its sizes; one whose sizes have been covered by others since the pricing waits for the next. sizes ascend.
    """
    size, need = np.asarray(sizes), np.asarray(demand, float)
    covered = np.zeros(len(size))
    used: dict[tuple, float] = {}
    while (low := covered.min()) < 1 - 1e-9:
        weight = np.exp(-(covered - low) / step) / need
        weight[covered >= 1 - 1e-9] *= 1e-6
        _, last = _filled(weight, size, capacity)
        priced = covered.copy()
        order = np.argsort(covered, kind="stable")[:columns]
        for nth, k in enumerate(order[covered[order] < 1 - 1e-9].tolist()):
            chosen = _configuration(k, last, size, capacity)
            if nth and any(covered[j] - priced[j] > step / 2 for j in chosen):
                continue
            amount = step * min(need[j] / n for j, n in chosen.items())
            for j, n in chosen.items():
                covered[j] += amount * n / need[j]
            key = tuple(sorted(chosen.items()))
            used[key] = used.get(key, 0) + amount
    return [(dict(k), x) for k, x in used.items()]


def _real(config: dict[int, int], sizes: list[int], classes: dict[int, list[int]], left: dict[int, int], capacity: int, grid: int) -> dict[int, int]:
    """Real lengths for a configuration of classes, none if they are too long. Classes are rounded to the nearest; so that errors do not add up, each piece is the longest of its
    class that makes good the error so far, else the shortest."""
    held: dict[int, int] = {}
    meant = real = 0
    for k in sorted(config, reverse=True):
        for _ in range(config[k]):
            free = [x for x in classes[sizes[k]] if left[x] > held.get(x, 0)]
            if not free:
                return {}
            meant += sizes[k] * grid
            length = next((x for x in reversed(free) if real + x <= min(meant, capacity)), free[0])
            held[length] = held.get(length, 0) + 1
            real += length
    return held if real <= capacity else {}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """Runs (number of equal sequences, [(length, copies), ...]) that hold every piece of the histogram {length: count}, and how many pieces the program placed.

    The fractional program is rounded in its order of amounts, fractions carried from one configuration to the next; a configuration that the stock no longer holds waits, and the
    program is solved again for the pieces that are left, in coarser classes once the finer place no more. The shortest pieces, a share FILLERS of all, stay out of it.
    """
    made = _Runs(capacity)
    left = {x: n for x, n in histogram.items() if n}
    spare, reserve = int(FILLERS * sum(left.values())), {}
    for length in sorted(left):
        reserve[length] = min(spare, left[length])
        spare -= reserve[length]
        left[length] -= reserve[length]
    placed = 0
    while total := sum(left.values()):
        classes: dict[int, list[int]] = {}
        for length in sorted(x for x, n in left.items() if n):
            classes.setdefault(max(1, (length + grid // 2) // grid), []).append(length)
        sizes = sorted(classes)
        stock = [sum(left[x] for x in classes[c]) for c in sizes]
        carry, before = 0.0, placed
        for config, amount in sorted(configuration_lp(sizes, stock, capacity // grid), key=lambda x: -x[1]):
            carry += amount
            copies = min(int(carry), *(stock[k] // n for k, n in config.items()))
            carry = min(carry - copies, 1.0)
            for k, n in config.items():
                stock[k] -= copies * n
            while copies > 0 and (held := _real(config, sizes, classes, left, capacity, grid)):  # equal sequences as long as no real length runs out
                run = min(copies, *(left[x] // n for x, n in held.items()))
                for x, n in held.items():
                    left[x] -= run * n
                    placed += run * n
                made.add(run, capacity - sum(x * n for x, n in held.items()), list(held.items()))
                copies -= run
        if placed == before:
            if grid >= COARSEST:
                break
            grid *= 2
    for length in sorted(histogram, reverse=True):
        made.fit(length, left.get(length, 0) + reserve.get(length, 0))
    return _repaired(made.all(), histogram, capacity), placed


def _repaired(runs: list[tuple[int, list[tuple[int, int]]]], histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs whose loosest sequences are taken apart and filled anew by best fit, if that saves sequences: the least share of REPAIRS that reaches the lower bound, else the best of them.

    The program's rounding leaves its slack in the last sequences; what is tight stays as it is.
    """
    many = sum(n for n, _ in runs)
    bound = -(-sum(x * n for x, n in histogram.items()) // capacity)
    gap = lambda held: capacity - sum(x * n for x, n in held)
    loosest, best = sorted(runs, key=lambda r: -gap(r[1])), runs
    for share in REPAIRS:
        if sum(n for n, _ in best) <= bound:
            break
        made, apart, open_ = _Runs(capacity), {}, max(2, int(share * many))
        for number, held in loosest:
            out = min(number, open_)
            open_ -= out
            for x, n in held:
                apart[x] = apart.get(x, 0) + out * n
            made.add(number - out, gap(held), held)
        for length in sorted(apart, reverse=True):
            made.fit(length, apart[length])
        if sum(n for n, _ in made.all()) < sum(n for n, _ in best):
            best = made.all()
    return best


def _slots(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, in order of rank: from rank `first` on, `copies` to a sequence, from `sequence` on at `offset`."""
    rows, taken, sequence = [], {}, 0
    for number, held in runs:
        offset = 0
        for length, copies in held:
            first = taken.get(length, 0)
            rows.append((length, first, copies, sequence, offset))
            taken[length] = first + number * copies
            offset += length * copies
        sequence += number
    rows.sort()
    return {k: np.asarray([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "first", "copies", "sequence", "offset"))}


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `rank`, from 0 within each key, counted in salted parts."""
    n = rows.count()
    salts = max(1, min(SALTS, -(-n // PART_ROWS)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy(key, "_salt").count().withColumn("_before", F.sum("count").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    return salted.withColumn("_within", within).join(before.drop("count"), [key, "_salt"]).withColumn("rank", F.coalesce("_before", F.lit(0)) + F.col("_within") - 1).drop("_salt", "_within", "_before")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. `found` is read three times: materialise it first."""
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = found.sparkSession.sparkContext.broadcast(_slots(plan(histogram, capacity)[0]))

    def place(batch: pa.RecordBatch) -> list[pa.Array]:
        slots = shared.value
        length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
        at = _find(slots, length, rank)
        nth = rank - slots["first"][at]
        copies = slots["copies"][at]
        return [pa.array(slots["sequence"][at] + nth // copies), pa.array(slots["offset"][at] + nth % copies * length)]

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    new = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return append_columns(ranked(found, "length", ["doc_id", "piece", "ids_crc32"]), columns, new, place)


def _find(slots: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The last slot of each length that begins at or before the rank."""
    shift = np.int64(1) << 48  # more pieces of one length than that are not met
    return np.searchsorted(slots["length"] * shift + slots["first"], length * shift + rank, "right") - 1


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack."""
    return pack(materialize(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id), "pieces"), capacity)


def tokenizer() -> str:
    """The public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer())
