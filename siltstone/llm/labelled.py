"""Bounded samples of labelled documents, and models fitted on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Whether the key belongs to the fifth of all keys that no model learns from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled keys outside the held-out fifth, chosen by hash; one text a key.

    Of a key with several texts the one with the least hash is learned from, so rows are as bounded as
    keys are. Rows with a null label or key, and labels without a document, are left out. Only the
    key and the text of ``docs`` are read, whatever else it has.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    chosen = chosen.groupBy(key).agg(F.max(label).alias("__label")).orderBy(F.xxhash64(key), key).limit(most).select(F.col(key).alias("__key"), "__label")
    found = docs.select(F.col(key).alias("__of"), F.col(text).alias("text")).join(chosen, F.col("__of") == F.col("__key"))
    return found.groupBy("__key", "__label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", F.col("__label").cast("int").alias("label"))


def fitted(features: DataFrame, fit) -> bytes:
    """The model that ``fit`` makes of all feature rows, in one task; its bytes come to the driver.

    ``features`` must be bounded, as those of ``training_rows`` are. They are made where the
    documents are read, and only they move to the one task.
    """
    row = features.repartition(1).mapInArrow(fit, "model binary").first()
    return bytes(row["model"])
