"""License scans by diagonal voting, in DataFrame operations alone.

Every run of GRAM words of a text is hashed and joined to the positions of equal runs in license templates (a fixed list, broadcast), the words compared. Matches
vote for their diagonal: position in the text minus position in the template. Neighbouring diagonals of a template are one region, which words put in
or left out have shifted; a region is a find if enough of the template's runs are in it, within a span not much longer than the template.
A phrase stands word for word where all its runs vote for one diagonal.

Each text is read and split once: a mark after its last word joins to a row of its own and carries the number of words. Only matches are shuffled.

Defined results: a null text is empty, without words; repeated rows (same id and text) are each returned; null ids are documents like others; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

GRAM = 3
#: Diagonals at most so far apart are one region.
NEIGHBOURS = 3
#: The share of a template's runs that makes a find, and how much longer than the template it may be.
LEAST_SHARE, LONGEST = 0.7, 1.5

#: Phrases that stand word for word, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Wordings of public license notices, and their labels.
NOTICES = [
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: F.Column) -> F.Column:
    """Words of a text with A-Z lower-cased. lower() also turns the Kelvin sign into a k, so that goes first; no other character becomes ASCII."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), _BREAK), "")


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """The runs of all templates, and a row (template -1) for the mark that ends a text."""
    listed = [(i, label, text, i < len(phrases)) for i, (label, text) in enumerate([*phrases, *notices])]
    literal = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(base).alias("base")) for i, label, text, base in listed])
    one = spark.range(1).select(F.inline(literal)).withColumn("t", F.split("text", " "))
    grams = one.select("template", "label", "base", (F.size("t") - GRAM + 1).alias("grams"), F.posexplode("t").alias("at", "w0"), "t").where("at < grams")
    runs = grams.select("template", "label", "base", "grams", "at", *[F.get("t", F.col("at") + j).alias(f"t{j}") for j in range(GRAM)])
    mark = spark.range(1).select(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("grams"), F.lit(-1).alias("at"), *[F.lit("").alias(f"t{j}") for j in range(GRAM)])
    return runs.unionByName(mark).withColumn("gram", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64(*[f"t{j}" for j in range(GRAM)])))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and `finds`: (label, first word, end word, share) of each region."""
    templates = F.broadcast(template_grams(docs.sparkSession, phrases, notices))
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("size"), _words(text).alias("words"))
    placed = split.select("doc_id", "h", "size", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "w0"))
    later = [F.coalesce(F.get("words", F.col("pos") + j), F.lit("")) for j in range(1, GRAM)]
    grams = placed.select(
        "doc_id", "h", "size", "pos", "w0", *[w.alias(f"w{j}") for j, w in enumerate(later, 1)],
        F.when(F.col("w0") == "", F.lit(0)).otherwise(F.xxhash64("w0", *later)).alias("gram"),
    )
    same = (grams.gram == templates.gram) & F.expr(" AND ".join(f"w{j} = t{j}" for j in range(GRAM)))
    votes = grams.join(templates, same).select("doc_id", "h", "size", "pos", "template", "label", "base", "grams", "at").repartition("doc_id", "h", "size")

    of_doc = ["doc_id", "h", "size"]
    diagonals = votes.groupBy(*of_doc, "template", "label", "base", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")
    )  # as many as the template has runs; equal rows vote alike
    along = Window.partitionBy(*of_doc, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS, F.lit(True)) | F.col("base")
    numbered = diagonals.withColumn("region", F.sum(apart.cast("int")).over(along))
    region = numbered.groupBy(*of_doc, "template", "label", "base", "grams", "region").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("hit"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("n")
    )
    share = F.col("hit") / F.col("grams")
    long = F.col("last") - F.col("first") + GRAM <= LONGEST * (F.col("grams") + GRAM - 1)
    found = F.when(F.col("base"), F.col("hit") == F.col("grams")).otherwise((share >= LEAST_SHARE) & long) & (F.col("template") >= 0)
    place = F.col("base") & found
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    out = region.groupBy(*of_doc).agg(
        F.max(F.when(F.col("template") < 0, F.col("last"))).cast("long").alias("n_words"),
        F.max(F.when(F.col("template") < 0, F.col("n"))).alias("rows"),
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("first"))).cast("long").alias("last_word"),
        labels(place).alias("base_labels"), labels(found).alias("labels"),
        F.coalesce(F.max(F.when((F.col("template") >= 0) & (F.col("base") | long), share)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(found, F.struct(F.col("first").alias("first_word"), (F.col("last") + GRAM).alias("end_word"), "label", share.alias("share"))))).alias("finds"),
    )
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "finds", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy")).drop("_copy")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return scan(table(spark, sf_dir, "documents")).drop("finds")
