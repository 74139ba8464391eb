"""Line dedup by site-relative frequency: lines that more than a given share of a host's pages hold are its boilerplate, and go.

Each page counts a line once. A host's boilerplate lines are at most (lines a page) / ratio, whatever its number of pages, so they fit in an
array, which is joined to the host's pages; pages are not exploded, and texts move only where the table of hosts is too large to be broadcast.

Headers and footers that many hosts share are below any share of one host's pages. With `edges`, the lines that stand at the edges of many different pages of the
whole table, and seldom within pages, go too, from the edges alone; a text within a page stays, and so does the first line of a page that was copied.

Defined results: a null host is a host of its own; a null text stays null; lines are compared as they are, and empty lines are never boilerplate; a page
of boilerplate alone keeps its text (it is a copy of a page, which is not this operator's matter); repeated rows are pages each; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, table

#: A line in more than this share of its host's pages is boilerplate, if at least MIN_PAGES hold it.
RATIO, MIN_PAGES = 0.1, 5
#: A page's edges are its first and last EDGE lines that are not blank. A line is planted if more than EDGE_RATIO of all pages, and EDGE_PAGES at least, have it there, if without it
#: at least EDGE_DIFFERENT of these pages differ (copies do not), and if at least EDGE_SHARE of all pages that hold it have it there. Measured: see README.
EDGE, EDGE_RATIO, EDGE_PAGES, EDGE_DIFFERENT, EDGE_SHARE = 2, 0.0005, 5, 0.5, 0.8
#: Hosts' boilerplate lines up to this number are broadcast, beyond it joined by shuffle.
BROADCAST_LINES = 500_000


def _code(line: Column) -> Column:
    """A 128-bit name of a line."""
    return F.concat(F.hex(F.xxhash64(line)), F.lit("-"), F.hex(F.xxhash64(F.lit("line"), line)))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, codes): the boilerplate lines of each host that has any. Counts of all pages, reduced before they are shuffled."""
    held = pages.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), host.isNull().alias("no_host"), text.alias("text"))
    totals = held.groupBy("host", "no_host").agg(F.count("*").alias("pages"))
    lines = held.where("text IS NOT NULL").select("host", "no_host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    counts = lines.groupBy("host", "no_host", _code(F.col("line")).alias("code")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    frequent = materialize(counts, "line-counts").join(totals, ["host", "no_host"]).where(F.col("n") > ratio * F.col("pages"))
    return materialize(frequent.groupBy("host", "no_host").agg(F.sort_array(F.collect_list("code")).alias("codes")), "boilerplate")


def planted(pages: DataFrame, text: Column) -> DataFrame:
    """One row, planted: the codes of the lines planted at the edges of the table's pages. They are at most 2 * EDGE / EDGE_RATIO, whatever the number of pages."""
    held = pages.select(F.split(text, "\n").alias("lines"))
    total = held.agg(F.count("*").alias("pages"))
    written = held.where("lines IS NOT NULL").withColumn("full", F.filter("lines", lambda x: F.trim(x) != ""))
    at_edges = written.select("lines", F.explode(F.array_distinct(F.concat(F.slice("full", 1, EDGE), F.slice("full", F.greatest(F.lit(1), F.size("full") - EDGE + 1), EDGE)))).alias("line"))
    rests = at_edges.groupBy(_code(F.col("line")).alias("code"), F.xxhash64(F.array_remove("lines", F.col("line"))).alias("rest")).agg(F.count("*").alias("n"))
    counted = rests.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("rests")).where((F.col("n") >= EDGE_PAGES) & (F.col("rests") >= EDGE_DIFFERENT * F.col("n")))
    often = materialize(counted.crossJoin(F.broadcast(total)).where(F.col("n") > EDGE_RATIO * F.col("pages")).select("code", "n"), "edge-lines")
    anywhere = written.select(F.explode(F.array_distinct("full")).alias("line")).select(_code(F.col("line")).alias("code")).join(F.broadcast(often), "code").groupBy("code", "n").agg(F.count("*").alias("all"))
    return materialize(anywhere.where(F.col("n") >= EDGE_SHARE * F.col("all")).agg(F.sort_array(F.collect_list("code")).alias("planted")), "planted")


def drop_boilerplate(
    pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, host: Column | None = None, edges: bool = False, dropped: str = "_dropped"
) -> DataFrame:
    """pages with their hosts' boilerplate lines, and with `edges` the lines planted at pages' edges, taken out of the text; all columns stay, in order, and `dropped` counts the lines taken out."""
    own = F.col(f"`{host_col}`") if host is None else host
    # Columns go by number within, so that no name of theirs meets one used here.
    numbered = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(pages.columns)], F.coalesce(own.cast("string"), F.lit("")).alias("host"), own.isNull().alias("no_host"))
    text = f"c{pages.columns.index(text_col)}"
    found = boilerplate(pages, own, F.col(f"`{text_col}`"), ratio, min_pages)
    few = found.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0] <= BROADCAST_LINES
    joined = numbered.join(F.broadcast(found) if few else found, ["host", "no_host"], "left")
    lines = F.split(text, "\n")
    of_host = lambda x: F.coalesce(F.array_contains(F.col("codes"), _code(x)), F.lit(False))
    if edges:
        joined = joined.crossJoin(F.broadcast(planted(pages, F.col(f"`{text_col}`"))))
        # Places of the lines that are not blank; lines up to `first` and from `last` on are at the edges.
        full = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
        joined = joined.withColumn("full", full).withColumn("first", F.coalesce(F.get("full", F.lit(EDGE - 1)), F.array_max("full"))).withColumn("last", F.coalesce(F.get("full", F.size("full") - EDGE), F.lit(0)))
        kept = F.filter(lines, lambda x, i: (x == "") | ~(of_host(x) | ((i <= F.col("first")) | (i >= F.col("last"))) & F.array_contains("planted", _code(x))))
        some = F.col("codes").isNotNull() | (F.size("planted") > 0)
    else:
        kept, some = F.filter(lines, lambda x: ~of_host(x) | (x == "")), F.col("codes").isNotNull()
    changed = joined.withColumn("kept", F.when(some & F.col(text).isNotNull(), kept))
    none_left = F.size(F.filter("kept", lambda x: F.trim(x) != "")) == 0
    new = F.when(F.col("kept").isNull() | none_left, F.col(text)).otherwise(F.array_join("kept", "\n"))
    gone = F.when(F.col("kept").isNull() | none_left, F.lit(0)).otherwise(F.size(lines) - F.size("kept"))
    return changed.select(*[(new if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(pages.columns)], gone.alias(dropped))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    found = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.col("_dropped").cast("long").alias("n_dropped"))


def op5_planted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines and without the headers and footers planted at the edges of documents."""
    found = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), edges=True)
    return found.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.col("_dropped").cast("long").alias("n_dropped"))


ORACLE_CTES = f"""
dedup_page AS (SELECT *, row_number() OVER () AS _r, coalesce(source, '') AS _host, source IS NULL AS _no_host FROM {{0}}),
dedup_total AS (SELECT _host, _no_host, count(*) AS pages FROM dedup_page GROUP BY ALL),
dedup_count AS (
  SELECT _host, _no_host, line, count(*) AS n
  FROM (SELECT _host, _no_host, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM dedup_page) WHERE line <> '' GROUP BY ALL
),
dedup_boiler AS (
  SELECT _host, _no_host, list(line) AS gone FROM dedup_count JOIN dedup_total USING (_host, _no_host) WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY ALL
),
dedup_kept AS (
  SELECT p.*, list_filter(string_split(text, chr(10)), lambda x: x = '' OR NOT coalesce(list_contains(gone, x), false)) AS _kept, len(string_split(text, chr(10))) AS _lines
  FROM dedup_page p LEFT JOIN dedup_boiler USING (_host, _no_host)
),
dedup AS (
  SELECT * REPLACE (CASE WHEN text IS NULL OR len(list_filter(_kept, lambda x: trim(x) <> '')) = 0 THEN text ELSE array_to_string(_kept, chr(10)) END AS text),
    CASE WHEN text IS NULL OR len(list_filter(_kept, lambda x: trim(x) <> '')) = 0 THEN 0 ELSE _lines - len(_kept) END AS _dropped
  FROM dedup_kept
)"""
ORACLE = f"""
WITH {ORACLE_CTES.format("documents")}
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, sha256(text) AS text_sha256, CAST(_dropped AS BIGINT) AS n_dropped FROM dedup
"""
