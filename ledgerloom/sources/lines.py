"""Ledgers from tables of text lines (of scanned or printed pages; decoding images is not done here).

A line has page_number, line_index, text, confidence, bbox and words with boxes. `doc` names the document; all documents are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import detect_number_format, format_votes, parse_amount
from ledgerloom.functions.dates import detect_date_formats, parse_date
from ledgerloom.scratch import materialize

#: Words of table headers.
HEADER_TERMS = ["date", "description", "narration", "particulars", "debit", "credit", "balance", "amount", "withdrawal", "deposit", "reference", "ref no"]
#: Patterns of lines that are no entries.
FOOTER = [r"^page\s+\d+", r"continued\s+(on|from)", r"this\s+is\s+(a\s+)?computer", r"generated\s+(on|at)", r"end\s+of\s+statement", r"^\*{3,}", r"^-{10,}$", r"^={10,}$"]
SUBTOTAL = [
    r"\b(sub\s?total|total|balance\s+(c/f|b/f|carried|brought))\b", r"\b(opening\s+balance|closing\s+balance)\b", r"\b(total\s+(debit|credit|withdrawal|deposit)s?)\b", r"\btotal\s+for\s+",
]
SKIPPED = [
    r"^\s*$", r"^page\s+\d+\s+(of|/)\s+\d+", r"continued\s+(on|from)", r"\b(sub\s?total|total|balance\s+(c/f|b/f|carried|brought))\b", r"^-{3,}$", r"^={3,}$", r"^\*{3,}$", r"opening\s+balance", r"closing\s+balance",
    r"statement\s+(period|date|ending)", r"account\s+(number|no|holder|name)", r"branch\s*(name|code)?", r"ifsc|swift|sort\s*code|routing",
]
PAGE_FOOTER = [
    r"^page\s+\d+\s*(of|/)\s*\d+", r"^page\s+\d+$", r"this\s+is\s+(a\s+)?computer\s+generated", r"generated\s+(on|at)\s+", r"end\s+of\s+statement", r"statement\s+continu", r"^\*{5,}$", r"^-{15,}$", r"^={15,}$", r"^_{15,}$",
]
PAGE_SUBTOTAL = [
    r"\b(sub\s?total|grand\s?total)\b", r"\b(total\s+(debit|credit|withdrawal|deposit)s?)\b", r"\b(balance\s+(c/f|b/f|carried\s+forward|brought\s+forward))\b", r"\b(opening\s+balance|closing\s+balance)\b",
    r"\btotal\s+for\s+(the\s+)?period\b", r"\btotal\s+for\s+\w+\s+\d{4}\b",
]
#: Fixed value: what looks like a date in a line.
DATE_IN_LINE = r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b|[A-Za-z]{3}\s+\d{1,2},?\s+\d{4}"
CONTINUED = [r"^continued\s*(on|from|\.{3})", r"continued\s+on\s+next\s+page", r"brought\s+forward\s+from", r"carried\s+(forward|over)\s+to", r"\.{3,}\s*$"]


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def _terms(c: Column, terms: list[str]) -> Column:
    """How many of the terms stand in the text."""
    return sum((F.contains(F.lower(c), F.lit(t)).cast("int") for t in terms), F.lit(0))


def _header_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z\s]", ""), r"\s+"), lambda w: F.length(w) > 2)


def judge_pages(lines: DataFrame) -> DataFrame:
    """lines with `reason`: why merging pages takes a line away, null if it stays. One shuffle and one sort: all that a line is compared with stands before it in its document."""
    text, along = F.trim("text"), Window.partitionBy("doc").orderBy("page_number", "line_index")
    marked = lines.withColumn("_first", F.col("page_number") == F.min("page_number").over(along))
    is_head = F.col("_first") & (F.col("line_index") < 10) & F.col("doc").isNotNull() & (_terms(F.col("text"), HEADER_TERMS[:-1]) >= 2)
    headed = marked.withColumn("_head", F.first(F.when(is_head, _header_words(F.col("text"))), ignorenulls=True).over(along))
    shared = F.size(F.filter("_head", lambda w: F.array_contains(_header_words(F.col("text")), w)))
    repeated = ~F.col("_first") & (F.size("_head") > 0) & (F.size(_header_words(F.col("text"))) > 0) & (shared / F.greatest(F.size("_head"), F.lit(1)) >= 0.6)
    reason = (
        F.when(F.length(text) < 2, "empty").when(F.coalesce(repeated, F.lit(False)), "repeated_header").when(_any(text, PAGE_FOOTER), "page_footer")
        .when(_any(text, PAGE_SUBTOTAL), "subtotal").when(_any(text, CONTINUED), "continuation_marker")
    )
    flat = F.when(F.col("reason").isNull(), F.struct(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("t")))
    judged = headed.withColumn("reason", reason).withColumn("_flat", flat)
    before = F.last("_flat", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))  # of the line kept before
    twice = F.coalesce((F.col("_flat.t") == before["t"]) & (F.length("_flat.t") > 5), F.lit(False))
    return judged.withColumn("_twice", twice).withColumn("reason", F.when(F.col("_twice"), "duplicate_boundary").otherwise(F.col("reason"))).select(*lines.columns, "reason")


def merge_pages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) lines of each document: empty lines, headers repeated on later pages, footers, subtotals and continuation marks go, and lines that
    repeat the one kept before them. removed has the `reason`."""
    judged = judge_pages(lines)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def merge_stats(lines: DataFrame) -> DataFrame:
    """How many lines each document has, and loses for which reason."""
    reasons = ["empty", "repeated_header", "page_footer", "subtotal", "continuation_marker", "duplicate_boundary"]
    return judge_pages(lines).groupBy("doc").agg(F.count("*").alias("lines_in"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons])


def classify(lines: DataFrame) -> DataFrame:
    """lines with `kind` (empty, header, footer, subtotal, continuation, data) and how sure that is."""
    text = F.trim("text")
    first = F.row_number().over(Window.partitionBy("doc").orderBy("page_number", "line_index")) == 1
    indented = F.coalesce(F.get("words", F.lit(0))["bbox"]["x0"] > 50, F.lit(False))
    wrapped = ~first & ~text.rlike(r"^\d{1,2}[/\-.]") & ~text.rlike(r"\d+[.,]\d{2}") & indented
    kinds = [
        (F.length(text) < 2, "empty", 1.0), (_terms(text, HEADER_TERMS) >= 2, "header", 0.9), (_any(text, FOOTER), "footer", 0.85), (_any(text, SUBTOTAL), "subtotal", 0.9), (_any(text, SKIPPED), "footer", 0.85),
        (wrapped, "continuation", 0.7), (F.lit(True), "data", 0.8),
    ]
    kind, sure = F, F
    for condition, name, value in kinds:
        kind, sure = kind.when(condition, name), sure.when(condition, value)
    return lines.withColumn("kind", kind).withColumn("kind_confidence", sure)


def assign_words(words: Column, columns: list[tuple[str, float, float]]) -> dict[str, Column]:
    """The text of each column (role, first x, last x): words whose middle lies in it. The last of two columns of a role counts."""
    middle = lambda w: (w["bbox"]["x0"] + w["bbox"]["x1"]) / 2
    within = lambda a, b: lambda w: (middle(w) >= a) & (middle(w) <= b)
    return {role: F.nullif(F.array_join(F.transform(F.filter(words, within(a, b)), lambda w: w["text"]), " "), F.lit("")) for role, a, b in columns}


def _cells(words: Column, spans: Column, roles: list[str]) -> dict[str, Column]:
    """The text of each role where a map from roles to their columns' ends stands beside the words; of several columns of a role the last one that holds words counts."""
    middle = lambda w: (w["bbox"]["x0"] + w["bbox"]["x1"]) / 2
    held = lambda s: F.array_join(F.transform(F.filter(words, lambda w: middle(w).between(s["x_start"], s["x_end"])), lambda w: w["text"]), " ")
    return {r: F.try_element_at(F.filter(F.transform(F.try_element_at(spans, F.lit(r)), held), lambda t: t != ""), F.lit(-1)) for r in roles}


def parse_lines(classified: DataFrame, columns: list[tuple[str, float, float]] | DataFrame, party: str, number_format: str | Column | None = None, date_format: str | Column | None = None) -> DataFrame:
    """Entries of the data lines; a wrapped line is added to the description of the entry before it, and is read as data where there is none.

    columns are those of all documents, or a table of each document's (doc, role, x_start, x_end); formats may be columns of classified.
    Documents are windows; the entry that a wrapped line belongs to is a running count.
    """
    if isinstance(columns, DataFrame):
        each = columns.groupBy("doc", "role").agg(F.sort_array(F.collect_list(F.struct("x_start", "x_end"))).alias("s"))
        classified = classified.join(each.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("role", "s"))).alias("_spans")), "doc", "left")
        cell = _cells(F.col("words"), F.col("_spans"), ["date", "description", "debit", "credit", "amount", "balance", "reference"])
        has = lambda role: F.coalesce(F.map_contains_key("_spans", role), F.lit(False))
    else:
        cell = assign_words(F.col("words"), columns)
        has = lambda role: F.lit(role in {c[0] for c in columns})
    get = lambda role: F.coalesce(cell.get(role, F.lit(None).cast("string")), F.lit(""))
    amount = lambda role: parse_amount(get(role), number_format)["value"]
    along = Window.partitionBy("doc").orderBy("page_number", "line_index")
    read = classified.where(F.col("kind").isin("data", "continuation")).select(
        "doc", "page_number", "line_index", "kind", F.trim("text").alias("text"), F.col("text").alias("raw"), "confidence", "bbox", parse_date(get("date"), date_format)["date"].alias("date"),
        F.trim(F.coalesce(cell.get("description", F.lit(None)), F.col("text"))).alias("description"), amount("balance").alias("balance"), F.trim(cell.get("reference", F.lit(None).cast("string"))).alias("ref_number"),
        (has("debit") & has("credit")).alias("both"), F.abs(amount("debit")).alias("debit"), F.abs(amount("credit")).alias("credit"), amount("amount").alias("signed"),
    )
    read = read.withColumn("debit", F.when(F.col("both"), F.col("debit")).when(F.col("signed") < 0, -F.col("signed"))).withColumn("credit", F.when(F.col("both"), F.col("credit")).when(F.col("signed") >= 0, F.col("signed")))
    read = read.drop("both", "signed")
    valid = F.expr("date IS NOT NULL OR debit IS NOT NULL OR credit IS NOT NULL")
    sure = F.max(((F.col("kind") == "data") & valid).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    before = F.max((((F.col("kind") == "data") | (F.coalesce(F.col("_sure"), F.lit(0)) == 0)) & valid).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    placed = read.withColumn("_sure", sure).withColumn("_before", F.coalesce(before, F.lit(0)))
    starts = valid & ((F.col("kind") == "data") | (F.col("_before") == 0))
    numbered = placed.withColumn("_starts", starts).withColumn("row_index", F.sum(F.col("_starts").cast("long")).over(along) - 1).where((F.col("row_index") >= 0) & (F.col("_starts") | (F.col("kind") == "continuation")))
    first = lambda c: F.max_by(c, F.col("_starts").cast("int")).alias(c)
    more = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("_starts"), F.struct("page_number", "line_index", "text")))), lambda x: x["text"]), " ")
    raws = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "line_index", "raw"))), lambda x: x["raw"]), "\n").alias("raw_text")
    merged = numbered.groupBy("doc", "row_index").agg(F.min("page_number").alias("page_number"), *[first(c) for c in ("date", "description", "debit", "credit", "balance", "ref_number", "confidence", "bbox")], more.alias("_more"), raws)
    net = F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0))
    return merged.select(
        "doc", F.concat_ws(":", F.lit(party), F.col("row_index").cast("string")).alias("id"), F.lit(party).alias("party"), "row_index", "page_number", "date", F.trim(F.concat_ws(" ", "description", "_more")).alias("description"),
        "debit", "credit", "balance", "ref_number", net.alias("amount"), F.abs(net).alias("amount_abs"), F.floor(net * 100 + 0.5).cast("long").alias("amount_cents"), "raw_text", F.col("confidence").alias("ocr_confidence"), "bbox",
    )


def group_items(items: DataFrame) -> DataFrame:
    """Lines of positioned text items (doc, page_number, x, y, text): items of a rounded height are a line, top to bottom, left to right."""
    dealt = items.where(F.trim("text") != "").select("doc", "page_number", "x", "y", "text").repartition("doc", "page_number")  # the only shuffle: a page's lines are put together and numbered where they are
    line = dealt.withColumn("_y", F.floor(F.col("y") + 0.5)).groupBy("doc", "page_number", "_y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]), " ").alias("text"))
    return line.withColumn("line_index", F.row_number().over(Window.partitionBy("doc", "page_number").orderBy(F.desc("_y"))) - 1).drop("_y")


def is_digital(items: DataFrame) -> DataFrame:
    """Whether each document's first three pages have more than a hundred characters of text each on average."""
    sized = items.where("page_number <= 3").groupBy("doc").agg((F.sum(F.length("text")) / F.count_distinct("page_number")).alias("mean_chars"))
    return sized.withColumn("digital", F.col("mean_chars") > 100)


def dedupe_entries(entries: DataFrame) -> DataFrame:
    """Entries without those that repeat an entry of the same or the next page (date, cents and description), numbered anew."""
    key = ["doc", "date", "amount_cents", "description"]
    before = F.lag("page_number").over(Window.partitionBy(*key).orderBy("page_number", "row_index"))
    kept = entries.withColumn("_b", before).where("_b IS NULL OR page_number - _b > 1").drop("_b")
    return kept.withColumn("row_index", (F.row_number().over(Window.partitionBy("doc").orderBy("page_number", "row_index")) - 1).cast("long"))


def clean_ocr_text(text: Column) -> Column:
    """Single spaces, plain quotes and dashes, l and O between digits as 1 and 0, no stray strokes at the ends."""
    flat = F.trim(F.regexp_replace(F.translate(text, "‘’“”–—", "''\"\"--"), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"(?<=\d)l(?=\d)", "1"), r"(?<=\d)O(?=\d)", "0"), r"^[|lI]\s|\s[|lI]$", ""))


def _widths(lines: DataFrame) -> DataFrame:
    return lines.select("doc", F.explode("words").alias("w")).groupBy("doc").agg(F.max("w.bbox.x1").alias("width"))


def zones(lines: DataFrame, gap: float = 0.05) -> DataFrame:
    """(doc, zone, x_start, x_end, role, confidence): where words begin in lines 4 to 20 of each document, parted where a gap is wider than a share of the width.

    The role is what more than half of a zone's words are: dates, texts of more than three characters, or amounts; null if none is. Documents with fewer than three such lines have no zones.
    """
    order = F.row_number().over(Window.partitionBy("doc").orderBy("page_number", "line_index"))
    body = lines.withColumn("_at", order).where("_at <= 20 AND _at > 3")
    enough = body.groupBy("doc").agg(F.count("*").alias("n")).where("n >= 3")
    words = body.join(enough, "doc", "left_semi").select("doc", F.explode("words").alias("w")).select("doc", F.col("w.bbox.x0").alias("x"), F.col("w.text").alias("text"))
    along = Window.partitionBy("doc").orderBy("x", "text")
    apart = F.coalesce(F.col("x") - F.lag("x").over(along) > F.col("width") * gap, F.lit(False))
    placed = words.join(_widths(lines), "doc").withColumn("_new", apart.cast("int")).withColumn("zone", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    kind = F.when(parse_date(F.col("text"))["date"].isNotNull(), "date").when(parse_amount(F.col("text")).isNotNull(), "amount").when(F.length("text") > 3, "description")
    counted = placed.withColumn("_kind", kind).groupBy("doc", "zone").agg(
        F.min("x").alias("x_start"), F.max("x").alias("x_end"), *[(F.count_if(F.col("_kind") == k) / F.count("*")).alias(f"_{k}") for k in ("date", "description", "amount")]
    )
    role = F.when(F.col("_date") > 0.5, "date").when(F.col("_description") > 0.5, "description").when(F.col("_amount") > 0.5, "amount")
    return counted.select("doc", "zone", "x_start", "x_end", role.alias("role"), F.when(role.isNotNull(), F.greatest("_date", "_description", "_amount")).otherwise(0.5).alias("confidence"))


def content_columns(lines: DataFrame) -> DataFrame:
    """(doc, role, x_start, x_end, confidence) of documents in which three zones have a role. A column reaches to where the next zone begins, so that words longer than their zone lie in it."""
    along = Window.partitionBy("doc").orderBy("zone")
    named = zones(lines).withColumn("x_end", F.coalesce(F.lead("x_start").over(along) - 1e-6, F.lit(1e9))).where("role IS NOT NULL")
    several = named.groupBy("doc").agg(F.count("*").alias("n")).where("n >= 3")
    return named.join(several, "doc", "left_semi").select("doc", "role", "x_start", "x_end", "confidence")


def detect_columns(lines: DataFrame, first: int = 20) -> DataFrame:
    """(doc, role, x_start, x_end, confidence): the columns of each document's table.

    The header is the first of the first lines with words of two roles; each header word that names a role begins a column that reaches to the next one. A document
    without a header gets columns by content, if three zones of its words have a role, else a usual layout of its width: date, description, debit, credit and balance in
    15, 35, 15, 15 and 20 hundredths.
    """
    from ledgerloom.sources.csv_ledger import HEADER_WORDS

    role = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("w.text"), w)), role) for role, words in HEADER_WORDS.items()])
    named = lines.where(F.col("line_index") < first).select("doc", "page_number", "line_index", F.explode("words").alias("w")).withColumn("role", role)
    heads = named.where("role IS NOT NULL").groupBy("doc", "page_number", "line_index").agg(F.count_distinct("role").alias("roles")).where("roles >= 2")
    head = heads.groupBy("doc").agg(F.min(F.struct("page_number", "line_index")).alias("h")).select("doc", "h.page_number", "h.line_index")
    along = Window.partitionBy("doc").orderBy("x_start")
    found = named.where("role IS NOT NULL").join(head, ["doc", "page_number", "line_index"]).select("doc", "role", F.col("w.bbox.x0").alias("x_start"))
    once = found.groupBy("doc", "role").agg(F.min("x_start").alias("x_start"))
    by_header = once.withColumn("x_end", F.coalesce(F.lead("x_start").over(along) - 1e-6, F.lit(1e9))).withColumn("confidence", F.lit(0.9))
    rest = lines.join(head, "doc", "left_anti")
    by_content = content_columns(rest)
    width = _widths(rest).join(by_content, "doc", "left_anti")
    shares = [("date", 0.0, 0.15), ("description", 0.15, 0.5), ("debit", 0.5, 0.65), ("credit", 0.65, 0.8), ("balance", 0.8, 1.0)]
    usual = F.array(*[F.struct(F.lit(r).alias("role"), (F.col("width") * a).alias("x_start"), (F.col("width") * b).alias("x_end"), F.lit(0.3).alias("confidence")) for r, a, b in shares])
    return by_header.select("doc", "role", "x_start", "x_end", "confidence").unionByName(by_content).unionByName(width.select("doc", F.inline(usual)))


def samples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, sample) of words with a number in the first 30 lines of each document, and (doc, pos, sample) of dates in its first 20."""
    order = F.row_number().over(Window.partitionBy("doc").orderBy("page_number", "line_index"))
    first = lines.withColumn("pos", order).where("pos <= 30")
    numbers = first.select("doc", F.explode("words.text").alias("sample")).where(F.col("sample").rlike(r"\d+[.,]\d+"))
    found = F.regexp_extract("text", DATE_IN_LINE, 0)
    return numbers, first.where("pos <= 20").select("doc", "pos", found.alias("sample")).where("sample <> ''")


def read_lines(lines: DataFrame, party: str) -> DataFrame:
    """Ledger entries of line tables in one call: pages merged, columns and formats found for each document, lines classified and parsed.

    A document without samples is read as US numbers and with dates in the order of all formats.
    """
    kept = materialize(merge_pages(lines)[0], "kept-lines")  # read for samples, zones, headers and entries
    numbers, found = samples(kept)
    number = numbers.select("doc", format_votes(F.col("sample")).alias("v")).groupBy("doc").agg(detect_number_format(F.col("v"))["config"].alias("number_format"))
    known = classify(kept).join(number, "doc", "left").join(detect_date_formats(found, ["doc"]).select("doc", "date_format"), "doc", "left")
    return parse_lines(known, detect_columns(kept), party, F.coalesce("number_format", F.lit("US")), F.col("date_format"))


def low_confidence(entries: DataFrame, below: float = 70.0) -> DataFrame:
    """Entries to be looked over by hand."""
    return entries.where(F.col("ocr_confidence") < below)
