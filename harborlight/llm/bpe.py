"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, map_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Longer texts are encoded in parts of about this many characters.
PART = 1 << 16
#: A place that starts a match of the pattern whatever stands around: one space between word characters.
_SAFE = re.compile(r"(?<=\w) (?=\w)")


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _digits() -> list[str]:
    return [str(i) for i in range(1 << 16)]


def encode(text: str, path: str) -> list[int]:
    """Ids of a whole text; long ones are cut where a match starts in any case, so the ids are those of the uncut text."""
    e = encoding(path)
    if len(text) <= PART:
        return e.encode_ordinary(text)
    ids, at = [], 0
    while at < len(text):
        cut = _SAFE.search(text, at + PART)
        end = cut.start() if cut else len(text)
        ids += e.encode_ordinary(text[at:end])
        at = end
    return ids


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, packed) of each row; null texts are empty, and empty texts have no ids."""
    arrow_limits(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.array(encode(t or "", path), "<u4").tobytes() for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data: the bytes that the packed ids stand for; decoding stays with bytes, so no id sequence is lost to replacement characters."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoding(path)
        data = [e.decode_bytes(np.frombuffer(i or b"", "<u4").tolist()) for i in b.column("ids").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "data": pa.array(data, pa.binary())})

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids, in one pass without a shuffle.

    Null texts count as empty; repeated rows stay, each with the same values; other columns play no part.
    """
    arrow_limits(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e, digits, out = encoding(path), _digits(), ([], [], [])
        for t in b.column("text").to_pylist():
            ids = encode(t or "", path)
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
            out[2].append(hashlib.sha256(e.decode_bytes(ids)).hexdigest())
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(out[0], pa.int64()), "ids_sha256": out[1], "decoded_sha256": out[2]})

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS))
