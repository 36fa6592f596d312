"""Language identification on averaged hashed subword embeddings (embed.py) with calibrated rejection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embed import Model, Params, fit, score
from .quality import fold


def train_language(docs: DataFrame, held: int | None = 2, p: Params = Params(per_class=700)) -> Model | None:
    """Learn lang from text, outside the held-out fold. Rows with a null lang, text or id teach nothing."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("label"), docs["text"].cast("string").alias("text")).dropna()
    return fit(rows.where(fold(rows, 4) != held) if held is not None else rows, None, p)


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row.

    lang_pred is a learned value, or `und` with score 0 where the text is null or has no letter (or nothing was learned).
    rejected marks calibrated scores below the level that the model chose on rows kept out of its training.
    """
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    held = F.coalesce(fold(d, 4) == 2, F.lit(False)).alias("held_out")
    if model is None:
        return d.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

    def answer(m: Model, texts: list, prob: np.ndarray) -> dict:
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        best = prob.argmax(axis=1)
        s = np.where(known, prob[np.arange(len(texts)), best], 0.0)
        return {"lang_pred": pa.array([m.classes[k] if ok else "und" for k, ok in zip(best, known)], pa.string()), "score": pa.array(s, pa.float64()), "rejected": pa.array(s < m.reject)}

    return score(d.select("doc_id", held, "text"), model, answer, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_language(docs, train_language(docs))
