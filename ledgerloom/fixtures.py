"""Two ledgers derived from the orders table, in which every kind of match occurs; the same SQL for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = """
SELECT o_orderkey AS k, o_orderkey % 20 AS m, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('ORD-', CAST(o_orderkey AS {text})) END AS ref,
  concat('Order ', CAST(o_orderkey AS {text}), ' customer ', CAST(o_custkey AS {text}), ' ', o_orderpriority) AS descr,
  o_orderpriority AS pri, CAST(o_custkey AS {text}) AS cust
FROM orders
"""
_OUT = "SELECT CAST({book} AS BIGINT) AS book, concat('{side}:', CAST(row_index AS {text})) AS id, CAST(row_index AS BIGINT) AS row_index, date, description, amount_cents / {hundred} AS amount, abs(amount_cents) / {hundred} AS amount_abs, amount_cents, ref_number FROM ("
#: Classes of orders (k % 20), the number j of the row made of an order, its date, cents, description and reference.
_B_ROWS = [
    ("m <= 8", 0, "d", "c", "upper(descr)", "ref"),
    ("m BETWEEN 9 AND 11", 0, "{d2}", "c + 3", "'Payment received'", "NULL"),
    ("m = 12", 0, "{d10}", "c", "concat(descr, ' pmt')", "NULL"),
    ("m = 13", 0, "{d10}", "c", "concat(pri, ' customer ', cust, ' order ', CAST(k AS {text}))", "NULL"),
    ("m = 14", 0, "d", "{six}", "'part 1 of 2'", "NULL"),
    ("m = 14", 1, "d", "c - {six}", "'part 2 of 2'", "NULL"),
    ("m = 15", 0, "d", "{five}", "'part 1 of 3'", "NULL"),
    ("m = 15", 1, "d", "{three}", "'part 2 of 3'", "NULL"),
    ("m = 15", 2, "d", "c - {five} - {three}", "'part 3 of 3'", "NULL"),
    ("m = 16", 0, "d", "c + 100000000", "'Bank fee reversal'", "NULL"),
    ("m = 16", 1, "d", "c + 100000000", "'Bank fee reversal'", "NULL"),
    ("m = 18", 0, "{d1}", "c - 1", "descr", "NULL"),
    ("m = 18", 1, "{d1}", "c + 1", "descr", "NULL"),
    ("m = 19", 0, "d", "c", "descr", "ref"),
]


def ledger_sql(side: str, spark: bool, book: str = "0") -> str:
    """The SELECT of ledger A or B over `orders`, for Spark or for DuckDB. book: an expression over row_index."""
    part = (lambda n: f"CAST(floor(c * {n} / 10) AS BIGINT)") if spark else (lambda n: f"(c * {n} // 10)")
    words = {"text": "STRING" if spark else "VARCHAR", "hundred": "100.0D" if spark else "CAST(100 AS DOUBLE)", "book": book, "side": side}
    words |= {f"d{n}": f"date_add(d, {n})" if spark else f"d + {n}" for n in (1, 2, 10)} | {"six": part(6), "five": part(5), "three": part(3)}
    base = _BASE.format(**words)
    if side == "A":
        rows = f"SELECT k AS row_index, d AS date, descr AS description, -c AS amount_cents, ref AS ref_number FROM ({base}) AS o WHERE m NOT IN (16, 19)"
    elif spark:  # one scan: each order becomes the array of its rows
        one = "named_struct('row_index', 3 * k + {j}, 'date', {date}, 'description', {text}, 'amount_cents', {cents}, 'ref_number', CAST({ref} AS STRING))"
        made = {where: ", ".join(one.format(j=j, date=date, text=text, cents=cents, ref=ref) for w, j, date, cents, text, ref in _B_ROWS if w == where) for where in dict.fromkeys(row[0] for row in _B_ROWS)}
        rows = f"SELECT inline(CASE {' '.join(f'WHEN {where} THEN array({held})' for where, held in made.items())} END) FROM ({base}) AS o".format(**words)
    else:
        rows = " UNION ALL ".join(
            f"SELECT 3 * k + {j} AS row_index, {date} AS date, {text} AS description, {cents} AS amount_cents, CAST({ref} AS {{text}}) AS ref_number FROM ({base}) AS o WHERE {where}".format(**words)
            for where, j, date, cents, text, ref in _B_ROWS
        )
    return _OUT.format(**words) + rows + ") AS r"


def ledgers(spark: SparkSession, sf_dir: str, books: int = 1) -> tuple[DataFrame, DataFrame]:
    """Ledgers A and B from the orders of a data folder, dealt out to so many books by order."""
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    book = {"A": f"row_index % {books}", "B": f"floor(row_index / 3) % {books}"}
    return tuple(spark.sql(ledger_sql(side, True, book[side]).replace("FROM orders", "FROM {orders}"), orders=orders) for side in "AB")


def event_ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A denser pair: events by even and odd id, with many equal amounts on few dates."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    out = []
    for side, rest in (("A", 0), ("B", 1)):
        out.append(spark.sql(
            f"""SELECT CAST(0 AS BIGINT) AS book, concat('{side}:', CAST(event_id AS STRING)) AS id, event_id AS row_index, CAST(ts AS DATE) AS date,
            concat(event_type, ' user ', CAST(user_id AS STRING)) AS description, value AS amount, abs(value) AS amount_abs,
            CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount_cents, CAST(NULL AS STRING) AS ref_number FROM {{events}} WHERE event_id % 2 = {rest}""", events=events))  # fmt: skip
    return tuple(out)
