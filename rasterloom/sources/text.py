"""Delimited text: sniffed name tables, class maps, and the samples-with-data layout."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a file's start that delimiters are counted in.
SNIFF = 200


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(encoding, delimiter) of delimited text: UTF-8 if all lines decode, else Windows-1251; of , ; tab and | the one that most of the first lines have equally often. Every line is looked at, in Spark's tasks."""
    lines = spark.read.text(path)
    encoding = "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "windows-1251"
    raw = b"\n".join(bytes(r[0]) for r in lines.select(F.col("value").cast("binary")).take(SNIFF))
    text = raw.decode("utf-8-sig") if encoding == "UTF-8" else raw.decode("cp1251", "replace")
    rows = [r for r in text.splitlines() if r.strip()]

    def steady(d: str) -> tuple[int, int]:
        n = [len(r) - 1 for r in csv.reader(rows, delimiter=d)]
        most = max(set(n), key=lambda k: (n.count(k), k)) if n else 0
        return (n.count(most) if most else 0, most)

    return encoding, max((",", ";", "\t", "|"), key=lambda d: (*steady(d), -",;\t|".index(d)))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header, all columns text, trimmed; blanks are null."""
    encoding, delimiter = sniff(spark, path)
    # Spark's reader knows no Windows-1251: such text is read byte by byte as Latin-1, and its upper half put right.
    if cyrillic := encoding == "windows-1251":
        encoding = "iso-8859-1"
    df = spark.read.csv(path, sep=delimiter, encoding=encoding, header=True, mode="PERMISSIVE")
    upper = bytes(range(128, 256))
    seen, meant = upper.decode("latin-1"), upper.decode("cp1251", "replace")
    right = (lambda c: F.translate(c, seen, meant)) if cyrillic else (lambda c: c)
    clean = [(c.translate(str.maketrans(seen, meant)) if cyrillic else c).replace("﻿", "").strip() for c in df.columns]
    return df.toDF(*clean).select(*[F.nullif(F.trim(right(F.col(f"`{c}`"))), F.lit("")).alias(c) for c in clean])


#: Column names, in lower case, that may hold a class's number and its name.
CODE_NAMES, LABEL_NAMES = ("code", "id", "class_id", "value", "gridcode", "cls"), ("name", "class", "class_name", "label")


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of a table of classes: whole codes, each once; of repeated codes the smallest name. Missing columns are an error."""
    df = read_names(spark, path)
    have = {c.lower(): c for c in df.columns}
    code, name = (next((have[n] for n in names if n in have), None) for names in (CODE_NAMES, LABEL_NAMES))
    if code is None or name is None:
        raise ValueError(f"no code or no name among {df.columns}")
    rows = df.select(F.col(f"`{code}`").try_cast("double").cast("int").alias("code"), F.col(f"`{name}`").alias("name"))
    return rows.where("code IS NOT NULL").groupBy("code").agg(F.min("name").alias("name"))


def samples_with_data(df: DataFrame, species: str, x: str, y: str, layers: list[str]) -> DataFrame:
    """The layout that MaxEnt programs read: species, x, y, then the layers. Rows with a missing layer value don't count; background is the species named so."""
    full = df.dropna(subset=[x, y, *layers])
    return full.select(F.coalesce(F.col(species), F.lit("background")).alias("species"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in layers])


def write_samples_with_data(df: DataFrame, path: str) -> None:
    """CSV parts, each with the header, so that every part can be read alone."""
    df.write.mode("errorifexists").csv(path, header=True)
