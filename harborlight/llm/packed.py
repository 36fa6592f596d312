"""Which hashes occur more than once, over all documents: (document, hash) pairs travel as packed arrays, by parts of the hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits, by_part, mix64, text_bytes

#: Pairs that a task gathers before it sends them, and pairs about that a part receives.
BUFFER, PART = 1 << 19, 1 << 18
#: Bytes of text whose hashes are in memory at once; a longer text is taken whole.
BYTES = 1 << 20


def parts_for(pairs: int) -> int:
    return int(max(8, min(60_000, pairs // PART)))


def exchange(docs: DataFrame, pairs: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], n_parts: int, forward: bool) -> DataFrame:
    """(part, data): the pairs of all documents by part of the hash; ids must not be null.

    pairs(bytes, starts) gives the row and the 64-bit hash of each pair of a batch, a hash once a row. Where several documents of a
    buffer share a hash, one pair goes on in their place, marked 1, so a hash that very many documents hold puts a pair a buffer
    into its part. With `forward` these documents' pairs go to parts by document, marked 2: known to be repeated.
    """
    arrow_limits(docs.sparkSession)

    def pack(ids: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        # mixed once more, as a least hash of several is small: ranges of it would put most anchors into the first part
        part, marks = ((mix64(h) >> np.uint64(40)).astype(np.int64) * n_parts) >> 24, np.zeros(len(h), np.uint8)
        known = repeated(h)
        if known.any():
            _, first = np.unique(h[known], return_index=True)
            first = np.flatnonzero(known)[first]
            part, marks = [np.concatenate(x) for x in ((part[~known], part[first]), (marks[~known], np.ones(len(first), np.uint8)))]
            sent = [np.concatenate(x) for x in ((ids[~known], ids[first]), (h[~known], h[first]))]
            if forward:
                away = (mix64(ids[known].astype(np.uint64) + np.uint64(1)) % np.uint64(n_parts)).astype(np.int64)
                part, marks = np.concatenate([part, away]), np.concatenate([marks, np.full(known.sum(), 2, np.uint8)])
                sent = [np.concatenate(x) for x in ((sent[0], ids[known]), (sent[1], h[known]))]
            ids, h = sent
        order, at = by_part(part, n_parts)
        ids, h, marks = ids[order], h[order], marks[order]
        rows = np.flatnonzero(np.diff(at)).tolist()
        data = [b"".join((np.int64(at[p + 1] - at[p]).tobytes(), _runs(ids[at[p] : at[p + 1]]), h[at[p] : at[p + 1]].tobytes(), marks[at[p] : at[p + 1]].tobytes())) for p in rows]
        return pa.RecordBatch.from_pydict({"part": pa.array(rows, pa.int32()), "data": pa.array(data, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            data, starts = text_bytes(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(starts, starts[at] + BYTES, "right")) - 1)
                row, h = pairs(data[starts[at] : starts[end]], starts[at : end + 1] - starts[at])
                held.append((ids[at:end][row], h))
                size, at = size + len(h), end
                if size >= BUFFER:
                    yield pack(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield pack(*map(np.concatenate, zip(*held)))

    return docs.mapInArrow(run, "part int, data binary")


def _runs(ids: np.ndarray) -> bytes:
    """Ids in runs: how many, each run's id, each run's length."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return np.int64(len(at)).tobytes() + ids[at].tobytes() + np.diff(np.concatenate([at, [len(ids)]])).astype(np.uint32).tobytes()


def unpack(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, hashes and marks of all pairs of a part."""
    out: tuple[list, list, list] = ([], [], [])
    for d in data:
        n, runs = np.frombuffer(d, np.int64, 2)
        at = 16 + 12 * int(runs)
        ids = np.frombuffer(d, np.int64, int(runs), 16)
        out[0].append(np.repeat(ids, np.frombuffer(d, np.uint32, int(runs), 16 + 8 * int(runs))))
        out[1].append(np.frombuffer(d, np.uint64, int(n), at))
        out[2].append(np.frombuffer(d, np.uint8, int(n), at + 8 * int(n)))
    return tuple(np.concatenate(x) for x in out)


def repeated(h: np.ndarray) -> np.ndarray:
    """Which places hold a hash that occurs at another place too."""
    order = np.argsort(h)
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    out = np.zeros(len(h), bool)
    out[order] = same[1:] | same[:-1]
    return out
