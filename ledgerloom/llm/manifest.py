"""A Merkle manifest of a table: a hash tree over the rows of each group, and one over the groups' roots, with a proof for each row.

Rows of a group stand in order; every `fanout` consecutive nodes of a level become one node of the next. Levels are made by lag and lead columns of fixed offsets: at level l a node sits
on the row of its first leaf, so that its siblings are fanout^l rows apart, masked by the node's slot among them and by the length of its run (the last may be short). First children
hash the parent. Windows run over blocks of fanout^LEVELS rows, which no run of siblings crosses; a block's top nodes are the rows of the next tier, so a group of any size never comes
to one task, and a tier is a small part of the one below. Steps of a proof go down from tier to tier by joins on (group, block).

Defined results: null values hash as `-`; null groups come first; rows of a null id come first in their group, and equal ids follow their leaves' hashes (equal rows are alike, and each has
a place of its own); an empty table has no rows; a row whose proof has no sibling at all hashes the empty text. Further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, materialize, table
from ledgerloom.operators.ranking import counted_before

#: Levels that are made within one block of rows: 2^LEVELS rows at a fanout of 2.
LEVELS = 10


def digest(*parts: Column | str) -> Column:
    """Lower-case hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value as its byte count, a colon and its text; `-` for null. So no two rows of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row of values."""
    return digest(*[encoded(v) for v in values])


@dataclass
class Tier:
    """Nodes with their steps to the top of their block."""

    nodes: DataFrame
    top: DataFrame


def _tier(nodes: DataFrame, fanout: int, label: str) -> Tier:
    """nodes: (grp, pos, n, h) and further columns; pos counts from 0 to n - 1 in each group.

    Tier.nodes has `steps` too: for each level of the block that hashes, what stands to the left and to the right of the node that the row is under. Tier.top has the blocks' top nodes as (grp, pos, n, h).
    """
    size = fanout**LEVELS
    rows = nodes.withColumn("_block", F.floor(F.col("pos") / size))
    along = Window.partitionBy("grp", "_block").orderBy("pos")
    steps = []
    for level in range(LEVELS):
        span = fanout**level
        # Rows that are no node of this level have no hash there.
        here, many = F.floor(F.col("pos") / span), F.ceil(F.col("n") / span)
        slot, mine = F.pmod(here, F.lit(fanout)), F.pmod(F.col("pos"), F.lit(span)) == 0
        of_run = F.least(F.lit(fanout), many - (here - slot))
        rows = rows.select("*", *[F.lag("h", k * span).over(along).alias(f"_b{k}") for k in range(1, fanout)], *[F.lead("h", k * span).over(along).alias(f"_a{k}") for k in range(1, fanout)])
        before = [F.when(slot >= k, F.col(f"_b{k}")).otherwise("") for k in range(fanout - 1, 0, -1)]
        after = [F.when(slot + k < of_run, F.col(f"_a{k}")).otherwise("") for k in range(1, fanout)]
        step = F.when(many > 1, F.struct(F.concat(*before).alias("l"), F.concat(*after).alias("r")))
        # Below the top of a group that is already one node, the hash is handed on.
        parent = F.when(mine & (slot == 0), F.when(many > 1, digest("h", *after)).otherwise(F.col("h")))
        rows = rows.select(*[c for c in rows.columns if c[:2] not in ("_a", "_b") or c == "_block"], F.when(mine, F.struct(step.alias("s"))).alias(f"_s{level}"), parent.alias("_h"), *([F.col("h").alias("_leaf")] if not level else []))
        rows = rows.drop("h").withColumnRenamed("_h", "h")
        steps.append(f"_s{level}")
    # Each row takes the step of the node it is under, which sits on the nearest row before it that is one.
    under = [F.last(s, True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(s) for s in steps]
    rows = rows.select(*[c for c in rows.columns if c not in steps], *under)
    rows = rows.withColumn("steps", F.array_compact(F.array(*[F.col(f"{s}.s") for s in steps]))).drop(*steps)
    made = materialize(rows, label)
    top = made.where(F.col("h").isNotNull()).select("grp", F.col("_block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), "h")
    return Tier(made.drop("h").withColumnRenamed("_leaf", "h"), top)


def _up(nodes: DataFrame, most: int, fanout: int, label: str) -> tuple[list[Tier], DataFrame]:
    """Tiers of all groups (the largest has `most` nodes) up to one node each, and those as (grp, root)."""
    tiers = []
    while True:
        tiers.append(_tier(nodes, fanout, f"{label}-{len(tiers)}"))
        nodes, most = tiers[-1].top, -(-most // fanout**LEVELS)
        if most <= 1:
            return tiers, nodes.select("grp", F.col("h").alias("root"))


def _down(tiers: list[Tier], above: DataFrame, fanout: int) -> DataFrame:
    """The lowest tier's nodes with their steps up to the very top. above: (grp, steps and further columns) of each group's root."""
    extra = [c for c in above.columns if c not in ("grp", "steps")]
    found = above.select("grp", F.lit(0).cast("long").alias("_of"), F.col("steps").alias("_above"), *extra)
    for i, tier in enumerate(reversed(tiers)):
        met = tier.nodes.withColumnRenamed("_block", "_of").join(found, ["grp", "_of"])
        full = met.withColumn("steps", F.concat("steps", "_above")).drop("_of", "_above")
        if i == len(tiers) - 1:
            return full
        found = full.select("grp", F.col("pos").alias("_of"), F.col("steps").alias("_above"), *extra)
    raise ValueError("no tiers")


def _placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows (grp, ...) with pos, their place in their group, and n, the group's size. Rows are dealt by ranges, so no group is counted by one task."""
    ranked = materialize(counted_before(rows, ["grp"], order, "true", f"{label}-dealt").withColumnRenamed("before", "pos"), f"{label}-placed")
    # A group's size, from its last row: few bytes for each group, joined by broadcast where that is small and else split by skew handling.
    sizes = ranked.groupBy("grp").agg((F.max("pos") + 1).alias("n"))
    return ranked.join(sizes, "grp")


def tree(rows: DataFrame, fanout: int = 2) -> DataFrame:
    """rows (grp: a text that is not null, h: the leaf hash, and columns `order_*` which say the order in a group, then the leaves') with subroot, root, and steps.

    steps: for each level from the leaf's to the top one, what stands left (`l`) and right (`r`) of the node on the leaf's way, concatenated hashes.
    """
    order = [c for c in rows.columns if c.startswith("order_")]
    spark = rows.sparkSession
    placed = materialize(_placed(rows, [*order, "h"], "manifest"), "manifest-leaves")
    most = placed.agg(F.max("n")).first()[0]
    if most is None:
        empty = "subroot string, root string, steps array<struct<l: string, r: string>>"
        return spark.createDataFrame([], empty).join(rows.limit(0)).select(*rows.columns, "subroot", "root", "steps")
    tiers, roots = _up(placed, most, fanout, "manifest-tier")
    groups = materialize(roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("root").alias("h")), "manifest-subroots")
    many = groups.count()
    upper, top = _up(_placed(groups, ["of"], "manifest-groups"), many, fanout, "manifest-top")
    above = _down(upper, top.select("grp", F.array().cast("array<struct<l: string, r: string>>").alias("steps"), "root"), fanout)
    return _down(tiers, above.select(F.col("of").alias("grp"), "steps", F.col("h").alias("subroot"), "root"), fanout).select(*rows.columns, "subroot", "root", "steps")


def proof(steps: Column) -> Column:
    """One hash of all siblings, level by level."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's hash and its siblings lead to."""
    return F.aggregate(steps, start, lambda h, s: digest(s["l"], h, s["r"]))


def manifest(docs: DataFrame, group_col: str, id_col: str, columns: list[str], tampered: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    columns are hashed in this order. tampered: what columns hold when rows are verified against the manifest (default: the same); the manifest itself is of docs as they are.
    """
    now = leaf(*[(tampered or {}).get(c, docs[c]) for c in columns])
    order = free_name("order_id", docs.columns)
    if id_col.lower() in ("grp", "h", "now"):
        raise ValueError(f"rename the column {id_col}")
    group = F.coalesce(F.concat(F.lit("1"), docs[group_col].cast("string")), F.lit("0"))
    leaves = docs.select(docs[id_col], group.alias("grp"), leaf(*[docs[c] for c in columns]).alias("h"), docs[id_col].alias("order_id"), now.alias("now"))
    made = tree(materialize(leaves.select(*[c for c in leaves.columns if c != id_col], F.col(id_col).alias("_id")), "manifest-hashed"), fanout)
    end = made.withColumn("folded_root", folded(F.col("now"), F.col("steps")))
    return end.select(F.col("_id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by language, and each row's verification after a seventh of the rows has been tampered with."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": changed})


ORACLE = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_concat([CAST(-1 - ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT)], [CAST(x AS BIGINT) for x in range(8)])))),
      lambda c, b: CASE WHEN b < 0 THEN xor(c, -1 - b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) % 7 = 0 AS hit
  FROM documents
), leaves AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + CASE WHEN hit THEN 1 ELSE 0 END AS VARCHAR)) || ':' || (n_chars + CASE WHEN hit THEN 1 ELSE 0 END), '-') || tail) AS changed
  FROM given
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), nodes AS (
  SELECT grp, 0 AS level, CAST(pos AS BIGINT) AS pos, leaf AS h, CAST(n AS BIGINT) AS n FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY grp, level, pos // 2, n
), subroots AS (
  SELECT grp, h AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS many FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, CAST(place AS BIGINT) AS pos, subroot AS h, CAST(many AS BIGINT) AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT p.grp, p.pos, s.level, s.n, CASE WHEN s.pos % 2 = 1 THEN o.h ELSE '' END AS l, CASE WHEN s.pos % 2 = 0 THEN coalesce(o.h, '') ELSE '' END AS r
  FROM placed p JOIN nodes s ON s.grp = p.grp AND s.n > 1 AND s.pos = p.pos >> s.level LEFT JOIN nodes o ON o.grp = s.grp AND o.level = s.level AND o.pos = xor(s.pos, 1)
  UNION ALL
  SELECT p.grp, p.pos, g.height + s.level, s.n, CASE WHEN s.pos % 2 = 1 THEN o.h ELSE '' END, CASE WHEN s.pos % 2 = 0 THEN coalesce(o.h, '') ELSE '' END
  FROM placed p JOIN subroots g USING (grp) JOIN upper s ON s.n > 1 AND s.pos = g.place >> s.level LEFT JOIN upper o ON o.level = s.level AND o.pos = xor(s.pos, 1)
), folds AS (
  SELECT grp, pos, 0 AS level, changed AS h FROM placed
  UNION ALL
  SELECT f.grp, f.pos, f.level + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON s.grp = f.grp AND s.pos = f.pos AND s.level = f.level
), ends AS (SELECT grp, pos, arg_max(h, level) AS folded_root FROM folds GROUP BY grp, pos),
proofs AS (SELECT grp, pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY grp, pos),
top AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT p.doc_id, p.leaf, g.subroot, top.root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
FROM placed p JOIN subroots g USING (grp) CROSS JOIN top JOIN ends e ON e.grp = p.grp AND e.pos = p.pos LEFT JOIN proofs f ON f.grp = p.grp AND f.pos = p.pos
"""
