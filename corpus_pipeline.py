"""The corpus pipeline: documents go through five corpus operators, each of which works on all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents in all stages but the last.

Defined results: a null or empty text is not toxic, loses no lines, is like no other, holds no window, and is packed as its end token; rows with a null id are judged like others and
all stay in near dedup; equal rows go and stay together, but for near dedup, where documents of one id are one; n_chars follows where lines go; further columns pass through,
whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, line_dedup, minhash, packing, toxicity
from ledgerloom.llm.common import free_name, materialize, table

#: Near-duplicate documents share so many of a hundred five-word shingles.
SIMILARITY = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    names = free_name("_score", docs.columns), free_name("_predicted", docs.columns)
    return toxicity.score(docs, model, docs.columns, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sources' boilerplate lines and without the headers and footers planted at documents' edges."""
    dropped = free_name("_dropped", docs.columns)
    found = line_dedup.drop_boilerplate(docs, "source", edges=True, dropped=dropped)
    size = F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates, and all others."""
    return minhash.keep_first(docs, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    prefix = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), docs.columns, prefix=prefix)
    return found.where(~F.col(f"{prefix}contaminated")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces and their places in sequences."""
    return packing.pack_documents(docs, packing.tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: The first and last stages, a trained model and a tokenizer, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
