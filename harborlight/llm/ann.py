"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals and exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, map_batches


@dataclass(frozen=True)
class Params:
    """sample: vectors (hash-chosen, about) that centroids and codes are learned from; every vector is indexed.

    block: vectors of a list that one task scans; queries: queries it scans them for, about; depth: candidates of a block that are
    reranked; recall: share of true neighbours, on the sample, that sets how many lists a query visits.
    """

    k: int = 20
    sample: int = 12_000
    bytes: int = 16
    block: int = 4096
    queries: int = 16384
    depth: int = 80
    recall: float = 0.97
    seed: int = 5


@dataclass
class Index:
    centroids: np.ndarray  # (lists, d) float32
    books: np.ndarray  # (bytes, 256, width) float32
    edges: np.ndarray  # where each code's components start
    visits: int


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, vec of the rows that take part: an id, and a vector with finite components, not all of them zero."""
    v = df[vec].cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(df["vec_id"].isNotNull() & F.coalesce(fine, F.lit(False))).select(df["vec_id"].cast("long").alias("vec_id"), v.alias("vec"))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[count > 0] = sums[count > 0] / count[count > 0, None]
        if (count == 0).any():
            c[count == 0] = x[rng.choice(len(x), int((count == 0).sum()))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * np.einsum("ij,ij->i", c, c)
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def train(x: np.ndarray, total: int, p: Params) -> Index:
    """Learn from a sample; the number of lists follows the size of the whole table, the lists to visit the recall on the sample."""
    rng = np.random.default_rng(p.seed)
    x = x.astype(np.float32)
    d = x.shape[1]
    lists = int(max(1, min(4096, len(x) // 39 + 1, total**0.5 / 4)))
    centroids = _kmeans(x, lists, rng)
    own = _nearest(x, centroids)
    rest = x - centroids[own]
    edges = np.linspace(0, d, min(p.bytes, d) + 1).astype(int)
    width = int(np.diff(edges).max())
    books = np.zeros((len(edges) - 1, 256, width), np.float32)
    for m in range(len(edges) - 1):
        part = rest[:, edges[m] : edges[m + 1]]
        books[m, :, : part.shape[1]] = _kmeans(part, 256, rng, 5)
    q = rng.choice(len(x), min(256, len(x)), replace=False)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    k = min(p.k, len(x) - 1)
    if k < 1:
        return Index(centroids, books, edges, lists)
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[q] @ centroids.T), axis=1), axis=1)  # rank of each list for each query
    need = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    visits = int(need[min(len(need) - 1, int(np.ceil(p.recall * len(need))))]) + 1
    return Index(centroids, books, edges, min(lists, visits))


def codes(ix: Index, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    rest = x.astype(np.float32) - ix.centroids[own]
    out = np.zeros((len(x), len(ix.books)), np.uint8)
    for m in range(len(ix.books)):
        w = ix.edges[m + 1] - ix.edges[m]
        out[:, m] = _nearest(rest[:, ix.edges[m] : ix.edges[m + 1]], ix.books[m, :, :w])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, is_query, p: Params = Params()) -> tuple[DataFrame, Tables]:
    """query_id, rank, vec_id, score: each query's k candidates with the largest inner products found, its own id apart.

    Scores are sums of products of the original components in double precision, in component order by numpy's pairwise sum; ties go
    to the smaller vec_id. Vectors null, zero or with null or non-finite components, or of another length than the most frequent
    one, take no part; repeated rows of an id are candidates once each. An empty table gives no rows. Other columns play no part.
    In a scanned list every candidate is scored whose estimate, with the error of its code, reaches the k-th score found so far.
    Lists are scanned in blocks by hash of vec_id, so a list, however many equal vectors it holds, is no single task.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    tables, v = Tables(spark, "ann"), usable(vectors)
    sizes = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema), tables
    d, total = sizes.d, sizes["count"]
    v = v.where(F.size("vec") == d)
    drawn = v.where(F.pmod(F.xxhash64("vec_id", F.lit(p.seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, p.sample / total)))
    x = np.array([r.vec for r in drawn.orderBy("vec_id").limit(2 * p.sample).collect()] or [v.first().vec])
    index = spark.sparkContext.broadcast(train(x, total, p))  # at most 4096 centroids

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        ix, m = index.value, _matrix(b.column("vec"))
        own = _nearest(m.astype(np.float32), ix.centroids) if len(m) else np.zeros(0, np.int64)
        c = codes(ix, m, own) if len(m) else m
        return pa.RecordBatch.from_pydict({"list": pa.array(own.astype(np.int32)), "vec_id": b.column("vec_id"), "vec": pa.array([r.tobytes() for r in m], pa.binary()), "code": pa.array([r.tobytes() for r in c], pa.binary())})

    placed = tables.write(map_batches(v, place, "list int, vec_id long, vec binary, code binary"), "index")
    counts = {r[0]: r[1] for r in placed.groupBy("list").count().collect()}  # a number a list
    blocks = {k: -(-n // p.block) for k, n in counts.items()}
    asked = placed.where(is_query(F.col("vec_id")))
    salts = max(1, -(-asked.count() // p.queries))
    how_many = spark.sparkContext.broadcast((counts, blocks))

    def route(b: pa.RecordBatch) -> pa.RecordBatch:
        ix, (count, block) = index.value, how_many.value
        ids, raw = b.column("vec_id").to_pylist(), b.column("vec").to_pylist()
        out: dict[str, list] = {k: [] for k in ("list", "block", "salt", "vec_id", "vec")}
        for i, r in zip(ids, raw):
            score = ix.centroids @ np.frombuffer(r, float).astype(np.float32)
            seen = 0
            for n, one in enumerate(np.argsort(-score, kind="stable").tolist()):
                if n >= ix.visits and seen > 4 * p.k:
                    break
                seen += count.get(one, 0)
                for s in range(block.get(one, 0)):
                    for k, v in zip(out, (one, s, i % salts, i, r)):
                        out[k].append(v)
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    queries = map_batches(asked.select("vec_id", "vec"), route, "list int, block int, salt int, vec_id long, vec binary")
    parts = F.create_map(*[F.lit(int(z)) for kv in sorted(blocks.items()) for z in kv])
    held = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), parts[F.col("list")]).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        ix, out = index.value, ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")  # equal estimates then keep the smaller ids first
            ids = left.column("vec_id").to_numpy()
            base = np.frombuffer(b"".join(left.column("vec").to_pylist()), float).reshape(len(ids), d)
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            centre = ix.centroids[left.column("list")[0].as_py()].astype(float)
            coded = np.concatenate([ix.books[m, code[:, m], : ix.edges[m + 1] - ix.edges[m]] for m in range(len(ix.books))], axis=1)
            # a product differs from its estimate by the query's length times this at most, and by float rounding
            error = np.sqrt(((base - centre - coded) ** 2).sum(axis=1)) + 1e-5 * np.sqrt((base**2).sum(axis=1).max())
            asks = right.column("vec_id").to_numpy()
            q = np.frombuffer(b"".join(right.column("vec").to_pylist()), float).reshape(len(asks), d)
            for at in range(0, len(asks), 64):
                part = q[at : at + 64].astype(np.float32)
                guess = np.zeros((len(part), len(ids)), np.float32)  # the list's own term is the same for all of it
                for m in range(len(ix.books)):
                    w = ix.edges[m + 1] - ix.edges[m]
                    guess += (part[:, ix.edges[m] : ix.edges[m + 1]] @ ix.books[m, :, :w].T)[:, code[:, m]]
                best = np.argsort(-guess, axis=1, kind="stable")[:, : p.depth + 1]
                for j in range(len(part)):
                    some = best[j][ids[best[j]] != asks[at + j]]
                    score = (base[some] * q[at + j]).sum(axis=1)
                    if len(ids) > p.depth + 1 and len(some) >= p.k:
                        least = np.partition(score, len(score) - p.k)[len(score) - p.k]
                        may = guess[j] + centre @ q[at + j] + error * np.sqrt(q[at + j] @ q[at + j]) >= least
                        may[best[j]] = False
                        may &= ids != asks[at + j]
                        more = np.flatnonzero(may)
                        some, score = np.concatenate([some, more]), np.concatenate([score, (base[more] * q[at + j]).sum(axis=1)])
                    top = np.lexsort((ids[some], -score))[: p.k]
                    out[0].append(np.full(len(top), asks[at + j]))
                    out[1].append(ids[some][top])
                    out[2].append(score[top])
        a, b, c = (np.concatenate(z) if z else np.zeros(0, t) for z, t in zip(out, (np.int64, np.int64, float)))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = held.groupBy("list", "block", "salt").cogroup(queries.groupBy("list", "block", "salt")).applyInArrow(scan, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score"), tables


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)[0]
