"""Quality classifier on supervised subword embeddings (embed.py)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, map_batches
from .embed import Model, Params, fit, score


def fold(df: DataFrame, n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.crc32(df[column].cast("string").cast("binary")) % n


def train_quality(docs: DataFrame, labels: DataFrame, held: int = 1, p: Params = Params()) -> Model | None:
    """Learn labels.quality from the rows outside the held-out fold (None keeps no fold out). Null labels and ids teach nothing; a repeated id has its larger label."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label")).dropna()
    if held is not None:
        rows = rows.where(fold(rows, 3) != held)
    return fit(rows.groupBy("doc_id").agg(F.max("label").alias("label")), docs, p)


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted of every row.

    Null and empty texts have the score of the class shares alone; without a model every score is 0.5. Repeated rows stay;
    columns other than doc_id and text play no part.
    """
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    held = F.coalesce(fold(d, 3) == 1, F.lit(False)).alias("held_out")
    if model is None:
        return d.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    def answer(m: Model, texts: list, prob: np.ndarray) -> dict:
        s = prob[:, m.classes.index(1)] if 1 in m.classes else np.zeros(len(texts))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32))}

    return score(d.select("doc_id", held, "text"), model, answer, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, that the model does not reject (score 0.5 and more); without a model, all."""
    if model is None:
        return docs
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast((model.classes, model.table, model.bias, model.p, model.reject))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*sent.value)
        prob = m.probabilities([t or "" for t in b.column("text").to_pylist()])
        return b.filter(pa.array(prob[:, m.classes.index(1)] >= 0.5 if 1 in m.classes else np.zeros(len(prob), bool)))

    return map_batches(docs, run, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, train_quality(docs, labels))
