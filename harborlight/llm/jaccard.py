"""N-gram Jaccard join with several global token orders.

Two documents can only reach the threshold if, under any one order of all shingles, their prefixes of that order share a shingle, so
a candidate has to pass the filter of each of several orders, and only then are whole sets compared. All orders here put shingles
of one document first, then order one goes by how many documents hold a shingle, and the others by hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, Tables, arrow_limits, by_part, documents, map_batches, mix64, spread_join, text_bytes, total_bytes
from .graph import components
from .packed import exchange, parts_for, repeated, unpack

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: The first pass looks at shingles of one in this many classes of their hashes.
CLASSES = 4
#: Documents about whose counts one row of a part carries.
BUCKET = 1 << 15
#: Pairs that a block of those left after the star round may have for each row of the index: comparisons of two numbers each.
REST = 256


def shingle_sets(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each distinct n-word shingle of UTF-8 texts end to end, ordered by row and hash.

    Words are runs of bytes other than white space, A to Z lower-cased; fewer than n words count as one shingle, no words as none.
    """
    low = _LOWER[data]
    blank = _BLANK[low]
    fresh = np.concatenate([[True], blank[:-1]])[: len(low)]
    fresh[starts[:-1][starts[:-1] < len(low)]] = True
    begin = np.flatnonzero(fresh & ~blank)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    span = np.diff(np.concatenate([begin, [len(low)]]))
    place = np.arange(begin[0], len(low), dtype=np.int32) - np.repeat(begin.astype(np.int32), span)
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(span.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)])
    value = _BYTE[low[begin[0] :]]
    value *= power[place]
    value[blank[begin[0] :]] = 0
    word = mix64(np.add.reduceat(value, begin - begin[0], dtype=np.uint64))
    row = np.searchsorted(starts, begin, "right") - 1
    count = np.bincount(row, minlength=len(starts) - 1)
    first = np.cumsum(count) - count
    m = len(word) - n + 1
    at = np.flatnonzero(row[: max(0, m)] == row[n - 1 :]) if m > 0 else np.zeros(0, np.int64)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + word[at + k])
    rows, hashes = [row[at]], [h]
    short = np.flatnonzero((count > 0) & (count < n))
    for c in range(1, n):
        r = short[count[short] == c]
        g = np.full(len(r), c, np.uint64)
        for k in range(c):
            g = mix64(g * np.uint64(0xC2B2AE3D27D4EB4F) + word[first[r] + k])
        rows.append(r)
        hashes.append(g)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])])[: len(rows)]
    return rows[keep], hashes[keep]


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = text_bytes(b.column("text"))
        row, _ = shingle_sets(data, starts, n)
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": pa.array(np.bincount(row, minlength=len(starts) - 1).astype(np.int64))})

    arrow_limits(docs.sparkSession)
    return map_batches(docs, run, "doc_id long, n long")


def lone_counts(sent: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, lone): how many hashes of each document no other one has, from an exchange.

    A part sends one packed row a bucket of documents, not one a document, so rows follow parts and buckets.
    """

    def pack(table: pa.Table) -> pa.Table:
        ids, h, marks = unpack(table.column("data").to_pylist())
        got, count = np.unique(ids[~repeated(h) & (marks == 0)], return_counts=True)
        order, at = by_part((mix64(got.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)
        got, count = got[order], count[order].astype(np.uint32)
        rows = np.flatnonzero(np.diff(at)).tolist()
        return pa.table({"bucket": pa.array(rows, pa.int32()), "data": pa.array([got[at[k] : at[k + 1]].tobytes() + count[at[k] : at[k + 1]].tobytes() for k in rows], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        data = table.column("data").to_pylist()
        ids, place = np.unique(np.concatenate([np.frombuffer(d, np.int64, len(d) // 12) for d in data]), return_inverse=True)
        counts = np.concatenate([np.frombuffer(d, np.uint32, len(d) // 12, len(d) // 12 * 8) for d in data])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lone": pa.array(np.bincount(place, counts, len(ids)).astype(np.int64))})

    return sent.groupBy("part").applyInArrow(pack, "bucket int, data binary").groupBy("bucket").applyInArrow(total, "doc_id long, lone long")


def join_sets(docs: DataFrame, n: int, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sizes(doc_id, n) of all rows; members(doc_id, rep) of the documents whose set has a partner to be found; components(node, component) of reps.

    A document can only have a partner if `percent` of its shingles occur in other documents. The first pass counts, over all
    documents but for a quarter of the hash classes, shingles that are nowhere else: more than 100 - percent of the set, and the
    document is done. The rest is exact on whole sets: equal sets become one representative, shingles are counted among these, and
    those that pass again are joined.
    """
    docs = docs.where("doc_id IS NOT NULL")
    sizes = tables.write(set_sizes(docs, n), "sizes")
    rows, size = total_bytes(docs)

    def sample(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, h = shingle_sets(data, starts, n)
        pick = h % np.uint64(CLASSES) == 0
        return row[pick], h[pick]

    sent = exchange(docs, sample, parts_for(size // (6 * CLASSES)), False)
    lone = lone_counts(sent, max(8, rows // BUCKET))
    alive = tables.write(sizes.where("n > 0").join(lone, "doc_id", "left").where(f"100 * (n - coalesce(lone, 0)) >= {percent} * n").select("doc_id").distinct(), "alive")

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = text_bytes(b.column("text"))
        row, h = shingle_sets(data, starts, n)
        at = np.searchsorted(row, np.arange(len(starts)))
        keys = [hashlib.sha256(h[x:y]).digest()[:16] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "key": pa.array(keys, pa.binary()), "tokens": sets})

    sets = map_batches(docs.join(alive, "doc_id").select("doc_id", "text"), whole, "doc_id long, key binary, tokens array<long>")
    sets = tables.write(sets, "sets")
    reps = tables.write(sets.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens")), "reps")
    members = tables.write(sets.select("doc_id", "key").join(reps.select("key", "rep"), "key").select("doc_id", "rep").distinct(), "members")
    tables.drop("sets", "alive")

    need = lambda size: F.ceil(size * percent / 100)
    index = reps.select("rep", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = tables.write(index.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    shared = often.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    found = spread_join(index, often, "token", often, shared).groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    found = found.where(F.size("list") * 100 >= F.col("n") * percent).withColumn("reach", (F.size("list") - need(F.col("n")) + 1).cast("int"))
    hashed = lambda salt: F.slice(F.array_sort(F.transform("list", lambda x: F.struct(F.xxhash64(x["token"], F.lit(salt)).alias("h"), x["token"].alias("token")))), 1, F.col("reach"))["token"]
    found = found.select("rep", "n", (F.size("list") / F.col("n")).alias("known"), F.col("list")["token"].alias("tokens"), F.slice("list", 1, F.col("reach"))["token"].alias("p1"), hashed(1).alias("p2"), hashed(2).alias("p3"))
    found = tables.write(found, "found")
    index = found.select("rep", "n", "known", F.posexplode("p1").alias("at", "token"), (F.col("n") - F.size("tokens")).alias("alone"))
    index = tables.write(index.select("rep", "n", "known", "token", (F.col("n") - F.col("alone") - F.col("at")).alias("left")), "index")
    links = _links(found, index, percent, tables)
    return sizes, members, components(links, tables, "components")


def _verify(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those that pass every other order's filter and then reach the threshold on whole sets."""
    side = lambda s: found.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "tokens", "p2", "p3")])
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * percent).select("a", "b")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _links(found: DataFrame, index: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Links enough to give every component that all links give.

    A pair in one component already needs no test, so a star round first tests the pairs of one centre in each index entry, which is
    as many as the index has rows at most, and joins what it finds. Then every pair in an entry between different components is
    tested: each member meets the members outside the entry's largest component, in as many blocks of these as keep a block's pairs
    bounded by the rows of the index.
    """
    # the first shared shingle stands where both sets still have, from there on, as many shingles as they must share
    fits = (F.col("label") != F.col("o.label")) & (F.least("left", "o.left") * (100 + percent) >= (F.col("n") + F.col("o.n")) * percent)
    me = F.struct("rep", "n", "left", "label")
    entries = index.count()

    def several(labelled: DataFrame, name: str) -> DataFrame:
        """Entries with several components: rows, sum of squares by component, the largest one, and the row that shares most of its shingles."""
        by = labelled.groupBy("token", "label").agg(F.count("*").alias("c"), F.max(F.struct("known", (-F.col("rep")).alias("place"), me.alias("o"))).alias("best"))
        by = by.groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("s"), F.max(F.struct("c", "label"))["label"].alias("main"), F.max("best")["o"].alias("o"))
        return tables.write(by.where("c * c > s"), name)

    def meet(x: DataFrame, y: DataFrame, by: DataFrame, name: str) -> DataFrame:
        pairs = spread_join(x, y, "token", by.select("token", "c"), entries).where(fits).select(*_pair(F.col("rep"), F.col("o.rep"))).distinct()
        return tables.write(_verify(pairs, found, percent), name)

    labelled = index.withColumn("label", F.col("rep"))
    by = several(labelled, "open-0")
    links = meet(labelled, by.select("token", "o"), by, "links")
    parts = components(links, tables, "round")
    labelled = tables.write(index.join(parts, F.col("rep") == F.col("node"), "left").select("rep", "n", "known", "left", "token", F.coalesce("component", "rep").alias("label")), "labelled")
    by = several(labelled, "open-1")
    rest = by.agg(F.coalesce(F.sum((F.col("c") * F.col("c") - F.col("s")) / 2), F.lit(0))).first()[0]
    blocks = int(rest // max(1, REST * entries)) + 1
    open_ = tables.write(spread_join(labelled, by.select("token", "main"), "token", by.select("token", "c"), entries), "rest")
    for k in range(blocks):
        others = open_.where((F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("rep", F.lit("block")), F.lit(blocks)) == k)).select("token", me.alias("o"))
        links = links.union(meet(open_.drop("main"), others, by, f"links-{k}"))
    return links


def link(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, Tables]:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links of at least `percent` reach, itself included.

    Null and empty texts have no shingles and no links. Rows that repeat a doc_id stay, and count as one document with the links of
    each; a row with a null doc_id has a null component. Columns other than doc_id and text play no part.
    """
    d = documents(docs)
    tables = Tables(docs.sparkSession, "jaccard")
    sizes, members, parts = join_sets(d, n, percent, tables)
    where = members.join(parts, F.col("rep") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    known = sizes.join(where, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return known.union(set_sizes(d.where("doc_id IS NULL"), n).select("doc_id", "n", F.lit(None).cast("long"))), tables


def keep_first(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs, with all their columns, but for documents that links join to one with a smaller doc_id."""
    linked, tables = link(docs, n, percent)
    gone = tables.write(linked.where("component_id < doc_id").select(F.col("doc_id").alias("doc_id_")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id_"], "left_anti")


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
