"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, with a softmax on top.

Trained in numpy by stochastic gradient descent on a bounded, hash-chosen sample of labelled rows, each whole; every text is then scored whole.
As the output layer is linear, a trained model folds its vectors and its output weights into one table with a logit per bucket and
class, so scoring gathers and averages logits of the features, with no matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, documents, map_batches

#: Characters of text whose features are in memory at once.
PIECE = 1 << 18


@dataclass(frozen=True)
class Params:
    """bits: log2 of the hash buckets; per_class: bound of the labelled rows of a class taken for training."""

    bits: int = 16
    dim: int = 16
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 5
    rate: float = 1.0
    per_class: int = 1000
    seed: int = 7


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The whole text in parts of at most `most` characters, cut after white space where there is any."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at + most // 2, at + most), text.rfind("\n", at + most // 2, at + most)) + 1 or at + most
        yield text[at:cut]
        at = cut
    yield text[at:]


def buckets(texts: list[str], p: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: bucket at each place, whether a feature is there, and the starts of the texts' places."""
    joined = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    blank = (joined <= 32) | (joined == 0xA0)
    x = np.where(blank, np.uint32(32), joined) * np.uint32(0x9E3779B1)

    def settle(h: np.ndarray, salt: int) -> np.ndarray:
        h = h ^ np.uint32(salt * 0x632BE5AB & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - p.bits)

    n = len(x)
    inner = ~blank
    for g in p.grams:
        h, ok = x.copy(), np.zeros(n, bool)
        m = n - g + 1
        if m > 0:
            h = h[:m]
            ok[:m] = True
            for k in range(1, g):
                h = h * np.uint32(0x01000193) ^ x[k : k + m]
                if k < g - 1:
                    ok[:m] &= inner[k : k + m]
            h = np.concatenate([h, x[m:]])
        yield settle(h, g), ok, starts
    begin = np.flatnonzero(inner & np.concatenate([[True], blank[:-1]]))
    h, ok = np.zeros(n, np.uint32), np.zeros(n, bool)
    if len(begin):
        place = np.arange(n) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [n]])))
        power = np.cumprod(np.full(256, 0x01000193, np.uint32), dtype=np.uint32)
        h[begin] = np.add.reduceat(np.where(blank, np.uint32(0), x ^ (x >> np.uint32(16))) * power[place & 255], begin, dtype=np.uint32)
        ok[begin] = True
    yield settle(h, 1), ok, starts
    r = np.zeros(n, np.uint32)  # how far back the same word stands, by powers of two, with the word's length
    if len(begin):
        word = h[begin].astype(np.uint64) << np.uint64(32) | np.searchsorted(starts, begin, "right").astype(np.uint64)
        order = np.argsort(word, kind="stable")
        back = np.zeros(len(begin), np.int64)
        again = np.flatnonzero(word[order][1:] == word[order][:-1])
        back[order[again + 1]] = order[again + 1] - order[again]
        long = np.minimum(np.diff(np.concatenate([begin, [n]])), 12)
        r[begin] = (np.ceil(np.log2(back + 1)).astype(np.uint32) * np.uint32(16) + long.astype(np.uint32)) * np.uint32(0x9E3779B1)
    yield settle(r, 2), ok, starts


class Model:
    """classes: the learned labels; table: a logit for each bucket and class."""

    def __init__(self, classes: list, table: np.ndarray, bias: np.ndarray, p: Params, reject: float = 0.0) -> None:
        self.classes, self.table, self.bias, self.p, self.reject = classes, table, bias, p, reject

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of each whole text; a text without features has the bias alone."""
        total, count = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        flat = [(i, part) for i, t in enumerate(texts) for part in pieces(t)]
        at = 0
        while at < len(flat):
            end, chars = at, 0
            while end < len(flat) and (end == at or chars + len(flat[end][1]) <= PIECE):
                chars += len(flat[end][1])
                end += 1
            owner = np.array([i for i, _ in flat[at:end]])
            for b, ok, starts in buckets([t for _, t in flat[at:end]], self.p):
                for k in range(len(self.classes)):
                    np.add.at(total[:, k], owner, np.add.reduceat(np.where(ok, self.table[k][b], np.float32(0)), starts, dtype=np.float64))
                np.add.at(count, owner, np.add.reduceat(ok, starts, dtype=np.float64))
            at = end
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def counted(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the whole text has, in ascending order, and how often: 2^bits at most."""
    total = np.zeros(1 << p.bits, np.int64)
    for part in pieces(text):
        for b, ok, _ in buckets([part], p):
            total += np.bincount(b[ok], minlength=len(total))
    idx = np.flatnonzero(total)
    return idx.astype(np.uint16 if p.bits <= 16 else np.int32), total[idx].astype(np.uint32)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list, prior: dict, p: Params, alpha: float = 0.01) -> Model:
    """Stochastic gradient descent, one document, counted(), a step; a fifth of the rows is kept out to fit a temperature and the rejection level.

    prior: rows of each class in the whole table; the sample is even over classes, so the logits are shifted back to these shares.
    The rejection level is the lowest top probability above which at most `alpha` of the kept-out rows are wrong.
    """
    classes = sorted(set(labels))
    y = np.array([classes.index(v) for v in labels])
    rng = np.random.default_rng(p.seed)
    rows = []
    for idx, cnt in texts:
        rows.append((idx, (cnt / max(1, cnt.sum(dtype=np.int64))).astype(np.float32)))
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    vectors = ((rng.random((1 << p.bits, p.dim)) - 0.5) / p.dim).astype(np.float32)
    out, bias = np.zeros((p.dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    for epoch in range(p.epochs):
        for step, i in enumerate(rng.permutation(fit)):
            rate = np.float32(p.rate * (1 - (epoch * len(fit) + step) / (p.epochs * len(fit))))
            idx, w = rows[i]
            if not len(idx):
                continue
            h = w @ vectors[idx]
            z = h @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = out @ g
            out -= rate / (1 + h @ h) * np.outer(h, g)  # steps are held to the size of what they multiply, so they can't diverge
            bias -= np.float32(0.05) * rate * g
            vectors[idx] -= np.outer(w * (rate / ((w @ w) * (1 + np.sum(out * out)))), back)
    table = vectors @ out
    raw = np.array([rows[i][1] @ table[rows[i][0]] if len(rows[i][0]) else np.zeros(len(classes)) for i in held]).reshape(-1, len(classes)) + bias
    nll = {t: -np.mean((raw / t - np.logaddexp.reduce(raw / t, axis=1)[:, None])[np.arange(len(held)), y[held]]) if len(held) else 0.0 for t in 2.0 ** np.arange(-4, 4.25, 0.25)}
    warm = min(nll, key=nll.get)
    share = np.array([prior.get(c, 1) for c in classes], float) / np.maximum(np.bincount(y, minlength=len(classes)), 1)
    shift = np.log(share / share.mean())
    z = raw / warm + shift
    prob = np.exp(z - np.logaddexp.reduce(z, axis=1)[:, None]) if len(held) else z
    top, wrong = prob.max(axis=1), prob.argmax(axis=1) != y[held]
    down = np.argsort(-top)
    fine = np.flatnonzero(np.cumsum(wrong[down]) <= alpha * np.arange(1, len(down) + 1))
    reject = float(top[down[fine[-1]]]) if len(fine) else 0.0
    return Model(classes, np.ascontiguousarray((table / warm).T.astype(np.float32)), bias / warm + shift, p, reject)


def fit(rows: DataFrame, docs: DataFrame | None, p: Params) -> Model | None:
    """Learn from rows(doc_id, label[, text]); with docs, texts come from there. None if no labelled row has a text.

    The sample is drawn by a hash of doc_id, about p.per_class rows of each class, and reruns draw the same; counts of the classes are over all rows.
    Whole texts are counted on the executors, and only the counts of the sample, 2^bits a row at most, leave them.
    """
    prior = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not prior:
        return None
    share = F.create_map(*[F.lit(v) for c, n in prior.items() for v in (c, min(1.0, p.per_class / n))])
    drawn = rows.where((F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("label")])
    if docs is not None:
        drawn = F.broadcast(drawn.dropDuplicates(["doc_id"])).join(documents(docs), "doc_id")  # at most about per_class rows of each class
    arrow_limits(rows.sparkSession)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [counted(t or "", p) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "label": b.column("label"), "idx": pa.array([i.tobytes() for i, _ in got], pa.binary()), "cnt": pa.array([c.tobytes() for _, c in got], pa.binary())})

    found = map_batches(drawn.select("doc_id", "label", "text"), count, f"doc_id long, label {dict(drawn.dtypes)['label']}, idx binary, cnt binary")
    got = sorted((r.doc_id, r.label, bytes(r.idx), bytes(r.cnt)) for r in found.collect())
    kind = np.uint16 if p.bits <= 16 else np.int32
    return train([(np.frombuffer(i, kind), np.frombuffer(c, np.uint32)) for *_, i, c in got], [c for _, c, *_ in got], prior, p) if got else None


def score(df: DataFrame, model: Model, answer, schema: str) -> DataFrame:
    """doc_id, text and what else df has of simple columns; answer(model, texts, probabilities) gives the new columns."""
    spark = SparkSession.getActiveSession()
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast((model.classes, model.table, model.bias, model.p, model.reject))  # 2^bits floats a class

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*sent.value)
        texts = [t or "" for t in b.column("text").to_pylist()]
        new = answer(m, b.column("text").to_pylist(), m.probabilities(texts))
        kept = [n for n in b.schema.names if n != "text"]
        return pa.RecordBatch.from_pydict({n: b.column(n) for n in kept} | new)

    return map_batches(df, run, schema)
