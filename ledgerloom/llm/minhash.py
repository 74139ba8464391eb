"""Near-duplicate documents by circulant MinHash.

Two permutations make all signature coordinates: the first scatters a document's shingles over a ring, the second numbers the ring's places;
coordinate k is the least number met when the ring is turned by k. A shingle's numbers for all turns stand side by side, so a signature is one
minimum over slices of a table. Coordinates are banded; documents that share a band are candidates, and a link is confirmed on the full shingle sets.

No group is expanded into all its pairs. Equal shingle sets are one class. In each bucket, classes are first compared to its first class (in whole
buckets and in those that also share the next band), which links a group of copies by as many pairs as it has members; then only classes outside
the largest component of a bucket are compared to classes of other components: those near the same first class by way of their overlap with it, all others by an index of their
rarest shingles, of which alike sets share one (both are exact filters), and only where their packed signatures do not rule them out. So a bucket of many documents on one template
that are not alike costs as much as it has members. What is left out lies in one component already, so components are those of all links.

Defined results: null or empty texts and texts without words have no shingles and are linked with nothing; a text of fewer words than a shingle has one.
Repeated rows are documents of one class; rows with a null id are linked with nothing and have component_id null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append_columns, map_batches, materialize, slices, table, utf8
from ledgerloom.llm.hashing import mix, word_hashes

SHINGLE = 5
COORDINATES = 192
RING = 1 << 20
#: Bands are as long as they can be while a pair at the threshold shares none with at most this probability.
MISSED = 1e-6
#: Packed signatures exclude a pair that differs in more coordinates than a pair at the threshold does, by so many standard deviations.
DEVIATIONS = 5.5
#: Ids of candidate documents up to this number are broadcast, beyond it joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Cells that shingles are counted in, to tell rare from frequent ones (2 to this power), and rows of a shingle that meet others in one task.
COUNT_BITS, SALT_ROWS = 18, 500
#: Bytes of text that are hashed at once.
BATCH_BYTES = 1 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@cache
def _ring() -> np.ndarray:
    """The second permutation, lengthened so that a slice of all turns can begin anywhere."""
    order = np.random.default_rng(20_021).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:COORDINATES]]), COORDINATES)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles. Texts are hashed together, and each by itself if it is long."""
    _, _, _, words, bound = word_hashes([(t or b"").lower() for t in texts])
    out = [np.empty(0, np.uint64)] * len(texts)
    many = len(words) - SHINGLE + 1
    shingles = mix(reduce(np.add, (words[j : j + many] * _ODD[j] for j in range(SHINGLE)))) if many > 0 else words[:0]
    for i, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
        if b - a >= SHINGLE:
            out[i] = np.unique(shingles[a : b - SHINGLE + 1])
        elif b > a:
            out[i] = mix(np.array([(words[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, coordinates in a band) for a threshold."""
    likely = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (COORDINATES // r) <= MISSED]
    rows = max(likely, default=1)
    return COORDINATES // rows, rows


def most_mismatches(percent: int) -> int:
    """Of the 4-bit coordinates, so many may differ in a candidate pair."""
    differ = (1 - percent / 100) * 15 / 16
    return math.ceil(COORDINATES * differ + DEVIATIONS * math.sqrt(COORDINATES * differ * (1 - differ)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates: the least number among the shingles' places for each turn of the ring."""
    place = (shingles >> np.uint64(44)).astype(np.int64)  # the first permutation: the top 20 bits of a mixed hash
    parts = [_ring()[place[i : i + 2048]].min(axis=0) for i in range(0, len(place), 2048)]
    return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)


_SIGNED = T.StructType(
    [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))]
)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, a digest of the set, band hashes and the signature packed to 4 bits a coordinate."""

    many, rows = banding(percent)

    def sign(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [s for part in slices(batch, BATCH_BYTES) for s in shingle_sets(utf8(part.column(1)))]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        some = [i for i, s in enumerate(sets) if len(s)]
        coordinates = np.array([signature(sets[i]) for i in some], np.uint64).reshape(len(some), COORDINATES)
        marked = mix(coordinates + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))
        bands = mix(marked[:, : many * rows].reshape(len(some), many, rows).sum(axis=2, dtype=np.uint64)).view(np.int64)
        nibbles = (coordinates.reshape(len(some), COORDINATES // 16, 16) & np.uint64(15)) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
        packed = nibbles.sum(axis=2, dtype=np.uint64).view(np.int64)
        at = {i: k for k, i in enumerate(some)}
        column = lambda x: pa.array([x[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64()))
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), column(bands), column(packed)]

    return append_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], _SIGNED, sign)


def _mismatches(a: str, b: str) -> Column:
    """How many 4-bit coordinates of two packed signatures differ."""
    total = F.lit(0)
    for i in range(COORDINATES // 16):
        x = F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): the least node of its connected component, by alternating large and small stars.

    Only edges are moved: each step sends a node's neighbours to the least of them. A hub is a skewed join key, whose minimum is
    reduced before the shuffle. Every step is written, so lineage stays short.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def _compared(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b: structs of id and digest) with what their full sets say: `linked` (100 * intersection >= percent * union), the shingles in
    `common`, b's number of shingles n, and those of b that are not in a, `outside`."""

    def check(batches):
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                a, b = part.column("a_digest").to_pylist(), part.column("b_digest").to_pylist()
                new = {}
                for digest, text in (*zip(a, utf8(part.column("a_text")), strict=True), *zip(b, utf8(part.column("b_text")), strict=True)):
                    if digest not in held:
                        new[digest] = text
                held |= dict(zip(new, shingle_sets(list(new.values())), strict=True))
                rows = []
                for x, y in zip(a, b, strict=True):
                    p, q = held[x], held[y]
                    outside = np.setdiff1d(q, p, assume_unique=True)
                    common = len(q) - len(outside)
                    rows.append((100 * common >= percent * (len(p) + len(q) - common), common, len(q), outside.view(np.int64)))
                held = {a[-1]: held[a[-1]]}
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                names = ["a_id", "a_digest", "b_id", "b_digest"]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in names] + made, names=[*names, "linked", "common", "n", "outside"])

    flat = pairs.select(F.col("a.id").alias("a_id"), F.col("a.digest").alias("a_digest"), F.col("b.id").alias("b_id"), F.col("b.digest").alias("b_digest"))
    text = lambda k: texts.select(F.col("node.id").alias(f"{k}_id"), F.col("node.digest").alias(f"{k}_digest"), F.col("text").alias(f"{k}_text"))
    joined = flat.join(text("b"), ["b_id", "b_digest"]).join(text("a"), ["a_id", "a_digest"])
    extra = [T.StructField("linked", T.BooleanType()), T.StructField("common", T.LongType()), T.StructField("n", T.LongType()), T.StructField("outside", T.ArrayType(T.LongType()))]
    schema = T.StructType([*joined.select("a_id", "a_digest", "b_id", "b_digest").schema.fields, *extra])
    done = map_batches(joined.select("a_id", "a_digest", "a_text", "b_id", "b_digest", "b_text"), check, schema)
    node = lambda k: F.struct(F.col(f"{k}_id").alias("id"), F.col(f"{k}_digest").alias("digest")).alias(k)
    return done.select(node("a"), node("b"), "linked", "common", "n", "outside")


def _centred(checked: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each class that was compared to another: b, the least of those others as its centre a, the components of both, and how b relates to a."""
    centre = checked.groupBy("b").agg(F.min("a").alias("a"))
    root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    placed = checked.drop("linked").join(centre, ["a", "b"]).join(root("b"), "b", "left").join(root("a"), "a", "left")
    return placed.select("a", "b", F.coalesce("root_b", "b").alias("root"), F.coalesce("root_a", "a").alias("main"), "common", "n", "outside").withColumn("own", F.col("root") == F.col("main"))


def _through_centres(centred: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components among classes of one centre.

    Two sets share what both have in common with the centre, at most the lesser of the two numbers, and what both have outside of it. So a link needs either
    enough shingles in common with the centre, or shingles outside it that both hold. Of the latter, each class looks up only so many, its rarest, that it cannot miss
    a link by leaving the others out (a prefix filter); those that no other class of the centre holds meet nothing.
    """
    open_ = centred.groupBy("a").agg(F.max((~F.col("own")).cast("int")).alias("some"), F.count("*").alias("many")).where("some = 1 AND many > 1").select("a")
    placed = materialize(centred.join(open_, "a", "left_semi"), "centred")
    need = percent * (F.col("x.n") + F.col("y.n"))  # against (100 + percent) * intersection
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("y.own") | (F.col("x.b") < F.col("y.b")))
    least = F.least("x.common", "y.common")

    inner = placed.where(F.col("common") * 100 >= F.col("n") * percent).drop("outside")
    by_common = inner.where("NOT own").alias("x").join(inner.alias("y"), (F.col("x.a") == F.col("y.a")) & apart & (least * (100 + percent) >= need))

    # A partner has at least percent / 100 of the shingles, so at least as many are shared, of which at most `common` lie in the centre.
    must = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100 - 1e-9) - F.col("common"))
    listed = placed.withColumn("look", F.size("outside") - must + 1).where("look > 0").withColumn("shingle", F.explode("outside")).drop("outside")
    often = listed.groupBy("a", "shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "shingle"))
    index = listed.join(often, ["a", "shingle"]).withColumn("rank", rank).where("rank <= look AND often > 1").drop("rank", "look", "often")
    bound = (least + F.least(F.col("x.n") - F.col("x.common"), F.col("y.n") - F.col("y.common"))) * (100 + percent) >= need
    by_outside = index.where("NOT own").alias("x").join(index.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.shingle") == F.col("y.shingle")) & apart & bound)
    both = by_common.select(F.col("x.b").alias("p"), F.col("y.b").alias("q")).unionByName(by_outside.select(F.col("x.b").alias("p"), F.col("y.b").alias("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _rarest(texts: DataFrame, percent: int) -> DataFrame:
    """(node, shingle): of each set so many of its rarest shingles that two sets which are alike have one in common (a prefix filter). How rare a shingle is comes from counts in
    2^COUNT_BITS cells, which all sets share; any order would do for the result, and the table's size depends on no data."""

    def places(batches):
        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                place, n = np.unique(np.concatenate(shingle_sets(utf8(part.column(0)))) >> np.uint64(64 - COUNT_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(n)], names=["place", "n"])

    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for place, n in map_batches(texts.select("text"), places, "place long, n long").groupBy("place").agg(F.sum("n")).collect():  # at most 2^COUNT_BITS rows
        counts[place] = n
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def look(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for part in slices(batch, BATCH_BYTES):
            for s in shingle_sets(utf8(part.column(part.schema.get_field_index("text")))):
                order = np.lexsort((s, shared.value[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                rows.append(s[order[: len(s) + percent * len(s) // -100 + 1]].view(np.int64))
        return [pa.array(rows, pa.list_(pa.int64()))]

    made = append_columns(texts.select("node", "text"), ["node"], T.StructType([T.StructField("look", T.ArrayType(T.LongType()))]), look)
    return made.select("node", F.explode("look").alias("shingle"))


def _by_rarest(nodes: DataFrame, texts: DataFrame, near: Column, percent: int) -> DataFrame:
    """Candidate pairs (a, b) among nodes (node, root, minor, centre, n, sketch) of different components and centres, of which one is outside the largest component of a bucket."""
    index = materialize(_rarest(texts.join(nodes.select("node"), "node", "left_semi"), percent), "rarest")
    found = index.join(nodes.select("node", "minor"), "node").groupBy("shingle").agg(F.count("*").alias("n"), F.max("minor").alias("some")).where("n > 1 AND some")
    kept = index.join(found.select("shingle", F.col("n").alias("often")), "shingle")
    placed = materialize(kept.join(nodes, "node").withColumn("salts", F.ceil(F.col("often") / SALT_ROWS).cast("int")), "rarest-placed")
    x = placed.where("minor").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    y = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("y")
    other_centre = ~F.coalesce(F.col("x.centre") == F.col("y.centre"), F.lit(False))
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.root") != F.col("y.root")) & (~F.col("y.minor") | (F.col("x.node") < F.col("y.node")))
    return x.join(y, meet & other_centre & near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _node_texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes; nodes of one id are told apart by the digest of their sets."""
    wanted = nodes.select(F.col("node.id").alias("_id"), "node").distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(wanted, "_id").select("node", "text")

    def same(batch: pa.RecordBatch) -> list[pa.Array]:
        want = batch.column("node").field("digest").to_pylist()
        sets = shingle_sets(utf8(batch.column("text")))
        return [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() == w for s, w in zip(sets, want, strict=True)])]

    held = append_columns(found, ["node", "text"], T.StructType([T.StructField("same", T.BooleanType())]), same)
    return held.where("same").dropDuplicates(["node"]).drop("same")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    signed = materialize(signatures(docs, id_col, text_col, percent), "signatures")
    last = banding(percent)[0] - 1
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    node = F.struct("id", "digest").alias("node")

    spread = classes.select(node, F.inline(F.arrays_zip(F.col("bands").alias("bucket"), F.concat(F.slice("bands", 2, last), F.slice("bands", 1, 1)).alias("next"))))
    shared = classes.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(spread.join(shared, "bucket"), "members")

    def stars(keys: list[str]) -> DataFrame:
        centre = members.groupBy(*keys).agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        return members.join(centre, keys).select("a", F.col("node").alias("b")).where("a <> b")

    info = classes.select(node, "n", "sketch")
    near = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent) & (_mismatches("x", "y") <= most_mismatches(percent))
    pairs = stars(["bucket"]).unionByName(stars(["bucket", "next"])).distinct()
    side = lambda k, v: info.select(F.col("node").alias(k), F.struct("n", "sketch").alias(v))
    pairs = materialize(pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").where(near).select("a", "b"), "stars")
    texts = materialize(_node_texts(docs, members.select("node"), id_col, text_col), "texts")
    checked = materialize(_compared(pairs, texts, percent), "checked")
    roots = materialize(components(checked.where("linked").select("a", "b")), "roots")

    # Buckets that still hold classes of several components. Members outside the largest component of their bucket meet those of other components:
    # by way of the centre if both have the same, else by their rarest shingles.
    open_ = members.where("size > 2").select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    by_root = open_.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min("node").alias("low"))
    most = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.min("low").alias("first")).where("roots > 1")
    centred = materialize(_centred(checked, roots), "centred")
    outside = open_.join(most, "bucket").where("node <> first").groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("most.root")).alias("minor"))
    nodes = materialize(outside.join(info, "node").join(centred.select(F.col("b").alias("node"), F.col("a").alias("centre")), "node", "left"), "open-nodes")
    by_rarest = _by_rarest(nodes, texts, near, percent)
    by_centre = _through_centres(centred, percent).join(side("b", "y"), "b").join(side("a", "x"), "a").where(near).select("a", "b")
    more = by_rarest.unionByName(by_centre).distinct()
    more = materialize(_compared(more, texts, percent).where("linked").select("a", "b"), "links")
    roots = materialize(components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")

    of_class = materialize(classes.select(node, "digest").join(roots, "node", "left").select("digest", F.coalesce("root.id", "node.id").alias("component_id")), "class-components")
    own = F.col("n_shingles") > 0
    return signed.join(of_class, (signed.digest == of_class.digest) & own, "left").select(
        signed.doc_id, "n_shingles", F.when(signed.doc_id.isNotNull(), F.coalesce("component_id", signed.doc_id)).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its component; rows with a null id stay. Texts are not moved while the ids that go are few enough to be broadcast."""
    gone = materialize(near_duplicates(docs, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_col, "left_anti").select(*docs.columns)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: hash(array_to_string(w[i:i + {SHINGLE - 1}], ' ')))) AS s FROM doc WHERE len(w) > 0
),
place AS (SELECT doc_id, unnest(s) AS h, len(s) AS n FROM sets),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM place a JOIN place b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
pair AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM doc LEFT JOIN sets USING (doc_id) LEFT JOIN least ON least.a = doc_id
"""
