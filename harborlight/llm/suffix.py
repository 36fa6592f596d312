"""Suffix arrays by induced sorting in numpy, and removal of byte strings that an earlier document holds.

A window is a WIDTH-byte string. Each has an anchor: the least hash of the GRAM-byte strings in it, so equal windows have equal
anchors. Only windows whose anchor occurs in another document can repeat; runs of them with one anchor are cut out as segments,
equal segments become one, and segments go to shards by anchor. A shard's suffix array then stands equal windows side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, documents, map_batches, mix64, spread_join, text_bytes, total_bytes
from .packed import PART, _runs, exchange, parts_for, repeated, unpack

WIDTH, GRAM = 50, 24
#: Windows of a segment at most, and bytes of segments that a shard holds, about.
RUN, SHARD = 64, 2 << 20
#: Bytes of segments, and places of segments in documents, that a task holds before it sends them.
POOL, PLACES = 48 << 20, 1 << 19


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), taking an end smaller than all symbols."""
    n = len(t)
    turn = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))  # last place of each run of a symbol
    rises = np.append(t[turn[:-1]] < t[turn[:-1] + 1], False)
    return np.repeat(rises, np.diff(np.concatenate([[-1], turn])))


def _send(sa: np.ndarray, to: np.ndarray, block: np.ndarray, t: np.ndarray, fits: np.ndarray, step: int) -> None:
    """Put the predecessors of a block's suffixes that have the wanted type at their buckets' next free places, in order."""
    pred = block[block > 0] - 1
    pred = pred[fits[pred]]
    if not len(pred):
        return
    c = t[pred]
    order = np.argsort(c, kind="stable")
    c = c[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, count)
    sa[to[c] + step * rank] = pred[order]
    to[c[first]] += step * count


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in the order that these leftmost-S suffixes' order gives; a bucket is taken in waves, as its symbol may repeat."""
    n, size = len(t), np.bincount(t, minlength=k)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int64)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    many = np.bincount(c, minlength=k)
    place = np.arange(len(lms)) - np.repeat(np.cumsum(many) - many, many)
    sa[np.repeat(end - many, many) + place] = lms[order]
    head, l_type = start.copy(), ~s_type
    sa[head[t[n - 1]]] = n - 1  # the last suffix follows the end, which is first of all
    head[t[n - 1]] += 1
    present = np.flatnonzero(size).tolist()
    for b in present:
        at = start[b]
        while at < head[b]:
            at, block = head[b], sa[at : head[b]]
            _send(sa, head, block, t, l_type, 1)
        if many[b]:
            _send(sa, head, sa[end[b] - many[b] : end[b]], t, l_type, 1)
    tail = end - 1
    for b in reversed(present):
        at = end[b] - 1
        while at > tail[b]:
            at, block = tail[b], sa[tail[b] + 1 : at + 1][::-1]
            _send(sa, tail, block, t, s_type, -1)
        if head[b] > start[b]:
            _send(sa, tail, sa[start[b] : head[b]][::-1], t, s_type, -1)
    return sa


def suffix_array(t: np.ndarray, depth: int = 0) -> np.ndarray:
    """Suffixes of t (integers from 0) in order, by induced sorting; with `depth`, by their first `depth` symbols at least.

    Leftmost-S substrings are sorted by a first induction and named; names that are not all different are sorted in turn: by
    recursion while they are few enough for buckets, else by doubling the ranks of neighbours, since here each bucket costs a call.
    """
    t = np.asarray(t)
    n = len(t)
    if n < 2:
        return np.arange(n)
    k = int(t.max()) + 1
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(lms):
        return _induce(t, s_type, lms, k)
    sa = _induce(t, s_type, lms, k)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    by = sa[is_lms[sa]]
    same = np.zeros(len(by), bool)  # as the one before, over the whole substring up to the next leftmost-S place
    live = np.arange(1, len(by))
    off = 0
    while len(live):
        a, b = by[live] + off, by[live - 1] + off
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        ok = (t[a] == t[b]) & (s_type[a] == s_type[b])
        live, a, b = live[ok], a[ok], b[ok]
        if off:
            done = is_lms[a] & is_lms[b]
            same[live[done]] = True
            live = live[~done & (is_lms[a] == is_lms[b])]
        off += 1
    name = np.zeros(n, np.int64)
    name[by] = np.cumsum(~same) - 1
    reduced, names = name[lms], int((~same).sum())
    if names < len(lms):
        inner = suffix_array(reduced, depth) if names <= 1024 else _doubled(reduced, depth)
        by = lms[inner]
    return _induce(t, s_type, by, k)


def _doubled(r: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of names, each standing for two symbols at least."""
    rank, k = r.astype(np.int64), 1
    while True:
        nxt = np.concatenate([rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64)])[: len(rank)]
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
        rank = np.empty(len(r), np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == len(r) - 1 or k >= len(r) or depth and k >= depth:
            return order


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each place, how long its suffix agrees with the one before it in order, up to `most`."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    wide = np.concatenate([t, np.zeros(most + 8, t.dtype)])
    live = np.flatnonzero(before >= 0)
    off = 0
    while len(live) and off < most:
        a, b = live + off, before[live] + off
        ok = (a < n) & (b < n)
        live = live[ok]
        live = live[wide[a[ok]] == wide[b[ok]]]
        out[live] += 1
        off += 1
    return out


# --- windows and segments --------------------------------------------------------------------------------------------


def _powers(n: int) -> int:
    return pow(0x9E3779B97F4A7C15, n, 1 << 64)


def window_anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor at each place, whether a window of a row starts there, and the row of each place."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(n, np.uint64), np.zeros(n, bool), np.zeros(n, np.int64)
    h = {1: data.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * np.uint64(_powers(k)) + h[k][k:]
    g = h[16][: n - GRAM + 1] * np.uint64(_powers(8)) + h[8][16 : 16 + n - GRAM + 1]
    del h
    g = mix64(g)
    span, m = WIDTH - GRAM + 1, 1
    while m * 2 <= span:
        g = np.minimum(g[:-m], g[m:])
        m *= 2
    if m < span:
        g = np.minimum(g[: len(g) - (span - m)], g[span - m :])
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ok = starts[1:][row] - np.arange(n) >= WIDTH
    return np.concatenate([g, np.zeros(n - len(g), np.uint64)]), ok, row


def _anchor_pairs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, ok, row = window_anchors(data, starts)
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, row = a[at], row[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
    a, row = a[new], row[new]
    order = np.lexsort((a, row))
    a, row = a[order], row[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
    return row[new], a[new]


def _shared(buckets: int):
    """Of one part, the hashes of each document that also occur elsewhere, packed by bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        ids, h, marks = unpack(table.column("data").to_pylist())
        here = marks < 2
        hit = ~here
        hit[here] = repeated(h[here]) & (marks[here] == 0)
        ids, h = ids[hit], h[hit]
        bucket = (mix64(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((ids, bucket))
        ids, h, bucket = ids[order], h[order], bucket[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(ids)).tolist() if len(ids) else [0]
        cuts = list(zip(edge[:-1], edge[1:]))
        return pa.table({"bucket": pa.array(bucket[edge[:-1]], pa.int32()), "owners": pa.array([_runs(ids[x:y]) for x, y in cuts], pa.binary()), "anchors": pa.array([h[x:y].tobytes() for x, y in cuts], pa.binary())})

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """The anchors of each document of one bucket, in one row."""
    ids = np.concatenate([_owners(x) for x in table.column("owners").to_pylist()])
    h = np.frombuffer(b"".join(table.column("anchors").to_pylist()), np.uint64)
    order = np.argsort(ids, kind="stable")
    ids, h = ids[order], h[order]
    at = np.append(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])), len(ids))
    return pa.table({"doc_id": pa.array(ids[at[:-1]], pa.int64()), "anchors": pa.array([h[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())})


def _segments(shards: int):
    """Runs of windows that share an anchor which another document has too.

    Rows of kind 0 say, for a shard and PLACES places of a task, which segments stand where in which documents; rows of kind 1 hold
    the shard's segments once a task (or once in POOL bytes of them), each with the smallest and the largest document of the task that
    has it. Segments have 64-bit keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: dict[int, list] = {}
        refs: list[tuple] = []
        held = places = 0

        def rows(kind: int, columns: list) -> pa.RecordBatch:
            n = len(columns[0])
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * n, pa.int32())} | {k: pa.array(v if v is not None else [None] * n, t) for k, v, t in zip(("part", "owners", "at", "keys", "bodies"), columns, types)})

        def part_of(anchors: np.ndarray) -> np.ndarray:
            return (mix64(anchors) % np.uint64(shards)).astype(np.int32)

        def by_shard(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
            """An order by shard, the shards there are, and where each one's rows are in that order."""
            order = np.argsort(parts, kind="stable")
            p = parts[order]
            edge = np.append(np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])), len(p))
            return order, p[edge[:-1]], list(zip(edge[:-1].tolist(), edge[1:].tolist()))

        def flush() -> pa.RecordBatch:
            least, most, anchor, content = zip(*pool.values())
            columns = [np.array(x, t) for x, t in zip((list(pool), least, most, anchor, list(map(len, content))), _BODY)]
            order, parts, cuts = by_shard(part_of(columns[3]))
            columns, content = [c[order] for c in columns], [content[i] for i in order.tolist()]
            pack = zstandard.ZstdCompressor(level=1)
            return rows(1, [parts, None, None, None, [pack.compress(b"".join((np.int64(y - x).tobytes(), *(c[x:y].tobytes() for c in columns), *content[x:y]))) for x, y in cuts]])

        def send() -> pa.RecordBatch:
            parts, ids, begin, keys = map(np.concatenate, zip(*refs))
            order, parts, cuts = by_shard(parts)
            ids, begin, keys = ids[order], begin[order], keys[order]
            return rows(0, [parts, [_runs(ids[x:y]) for x, y in cuts], *[[c[x:y].tobytes() for x, y in cuts] for c in (begin, keys)], None])

        for b in batches:
            for doc_id, text, anchors_of in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("anchors").to_pylist()):
                raw = (text or "").encode()
                a, ok, _ = window_anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                known = np.unique(np.frombuffer(anchors_of, np.uint64))
                at = np.flatnonzero(ok & (known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a)) if len(known) else known
                if not len(at):
                    continue
                new = np.concatenate([[True], (np.diff(at) != 1) | (a[at[1:]] != a[at[:-1]])])
                first = np.flatnonzero(new)
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                first = np.flatnonzero(place % RUN == 0)
                begin, end = at[first], at[np.append(first[1:], len(at)) - 1] + WIDTH
                anchors, keys = a[begin], []
                for x, y, anchor in zip(begin.tolist(), end.tolist(), anchors.tolist()):
                    content = raw[x:y]
                    key = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
                    keys.append(key)
                    one = pool.get(key)
                    if one is None:
                        pool[key] = [doc_id, doc_id, anchor, content]
                        held += len(content) + 200
                    elif doc_id < one[0]:
                        one[0] = doc_id
                    elif doc_id > one[1]:
                        one[1] = doc_id
                refs.append((part_of(anchors), np.full(len(keys), doc_id, np.int64), begin.astype(np.int32), np.array(keys, np.int64)))
                places += len(keys)
                if places >= PLACES:
                    yield send()
                    refs, places = [], 0
            if held > POOL:
                yield flush()
                pool, held = {}, 0
        if refs:
            yield send()
        if pool:
            yield flush()

    return run


def _shard(table: pa.Table) -> pa.Table:
    """Bytes [from, to) of the shard's documents that windows cover which start in a smaller document, packed by document."""
    refs, segments = (table.filter(pc.equal(table.column("kind"), k)) for k in (0, 1))
    if not refs.num_rows or not segments.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
    keys, runs = _first_holders(segments)
    place = np.frombuffer(b"".join(refs.column("at").to_pylist()), np.int32).astype(np.int64)
    owner = np.concatenate([_owners(x) for x in refs.column("owners").to_pylist()])
    mine = np.frombuffer(b"".join(refs.column("keys").to_pylist()), np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    k = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
    hit = np.flatnonzero(keys[k] == mine) if len(keys) else np.zeros(0, np.int64)
    k = order[k[hit]]
    many = np.array([len(r) for r in runs], np.int64)  # of each segment's runs of windows: how many windows, and their first document
    at = np.cumsum(many) - many
    flat = np.concatenate(runs) if runs else np.zeros((0, 2), np.int64)
    times = many[k]
    run = np.repeat(at[k] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    upto = np.cumsum(flat[:, 0]) - np.repeat(np.cumsum(flat[:, 0])[at] - flat[at, 0], many) if len(flat) else np.zeros(0, np.int64)
    own, start = np.repeat(owner[hit], times), np.repeat(place[hit], times)
    end = start + upto[run]
    gone = flat[run, 1] < own
    own, spans = own[gone], np.stack([(end - flat[run, 0])[gone], end[gone] - 1 + WIDTH], axis=1).astype("<i4")  # a text has under 2^31 bytes
    order = np.argsort(own, kind="stable")
    own, spans = own[order], spans[order]
    edge = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own)).tolist() if len(own) else [0]
    return pa.table({"doc_id": pa.array(own[edge[:-1]], pa.int64()), "spans": pa.array([spans[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])], pa.binary())})


def _owners(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    return np.repeat(np.frombuffer(packed, np.int64, n, 8), np.frombuffer(packed, np.uint32, n, 8 + 8 * n))


#: Types of a segment's key, smallest document, largest document, anchor and size, as packed rows hold them before the bytes.
_BODY = ("<i8", "<i8", "<i8", "<u8", "<u2")


def _unpacked(packed: list[bytes]) -> tuple[list[np.ndarray], Callable[[int], bytes]]:
    """The columns of all segments of a shard, and a function that gives the bytes of the segment at a place."""
    unpack_, parts, blobs = zstandard.ZstdDecompressor(), [], []
    for data in packed:
        data = unpack_.decompress(data)
        n, at, columns = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
        for t in _BODY:
            columns.append(np.frombuffer(data, t, n, at))
            at += columns[-1].nbytes
        parts.append(columns)
        blobs.append(data[at:])
    columns, blob = [np.concatenate(x) for x in zip(*parts)], b"".join(blobs)
    ends = np.cumsum(columns[4].astype(np.int64))
    return columns, lambda i: blob[ends[i] - int(columns[4][i]) : ends[i]]


def _first_holders(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each segment of a shard, the smallest document that holds each of its windows, where one is smaller than the segment's largest:
    keys, and for each the windows in runs, as (how many, document).

    Equal segments of several tasks become one. An anchor with one kind of segment needs no order: the smallest document of the
    segment holds all its windows first. The segments of all other anchors stand in one suffix array.
    """
    columns, bodies = _unpacked(table.column("bodies").to_pylist())
    raw, least, most, anchor, _ = columns
    keys, first, where = np.unique(raw, return_index=True, return_inverse=True)
    low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, where, least)
    np.maximum.at(high, where, most)
    content = [bodies(i) for i in first.tolist()]
    _, kind, count = np.unique(anchor[first], return_inverse=True, return_counts=True)
    alone = np.flatnonzero((count[kind] == 1) & (low < high))
    found, runs = alone.tolist(), [np.array([[len(content[i]) - WIDTH + 1, low[i]]]) for i in alone.tolist()]
    many = np.flatnonzero(count[kind] > 1)
    many = many[np.argsort(kind[many], kind="stable")]
    sizes = np.cumsum([len(content[i]) for i in many.tolist()])
    begin = 0
    while begin < len(many):  # whole anchors at a time, about SHARD bytes of them
        end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SHARD)) + 1
        while end < len(many) and kind[many[end]] == kind[many[end - 1]]:
            end += 1
        some = many[begin:end]
        begin = end
        for i, r in zip(some.tolist(), _ordered([content[i] for i in some.tolist()], low[some], high[some])):
            if r is not None:
                found.append(i)
                runs.append(r)
    return keys[found], runs


def _ordered(contents: list[bytes], low: np.ndarray, high: np.ndarray) -> list[np.ndarray | None]:
    sizes = np.array([len(c) for c in contents])
    t = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = 0
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    full = ends[owner] - np.arange(len(t)) >= WIDTH
    sa = suffix_array(t, RUN + WIDTH)
    joins = common_prefixes(t, sa, WIDTH) >= WIDTH
    sa = sa[full[sa]]
    group = np.cumsum(~joins[sa])
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.zeros(len(t), np.int64)
    first[sa] = np.repeat(np.minimum.reduceat(low[owner[sa]], at), np.diff(np.append(at, len(sa))))
    out: list[np.ndarray | None] = []
    for b, e, most in zip((ends - sizes).tolist(), ends.tolist(), high.tolist()):
        mine = first[b : e - WIDTH + 1]
        edge = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        out.append(np.stack([np.diff(np.append(edge, len(mine))), mine[edge]], axis=1) if mine.min() < most else None)
    return out


def _cut(raw: bytes, spans: list[bytes]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is kept."""
    s = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, s[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _find(docs: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame, Tables]:
    """base(doc_id, n_bytes, sha, first) of all rows, where all but `first` of the same text, if it is not null, are removed whole; done(doc_id, sha, n_removed, n_spans, kept_sha256, kept) of the documents that lose some bytes otherwise."""
    spark = docs.sparkSession
    arrow_limits(spark)
    tables, d = Tables(spark, "suffix"), documents(docs)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = tables.write(d.select("doc_id", F.length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "base")
    # whole copies of a smaller document lose every byte; only the smallest of each text goes on
    reps = tables.write(base.where(f"doc_id IS NOT NULL AND n_bytes >= {WIDTH}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "reps")
    d = d.where("doc_id IS NOT NULL")
    n, size = total_bytes(d)
    shared = exchange(d, _anchor_pairs, parts_for(size // 14), True).groupBy("part").applyInArrow(_shared(max(8, size // 14 // (2 * PART))), "bucket int, owners binary, anchors binary")
    asked = shared.groupBy("bucket").applyInArrow(_gathered, "doc_id long, anchors binary").join(reps.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    asked = tables.write(asked, "asked")  # so that the anchors' shuffle files go before the segments' come
    shards = int(max(8, size // (2 * SHARD)))
    names = "kind int, part int, owners binary, at binary, keys binary, bodies binary"
    segments = d.join(asked, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_segments(shards), names)
    spans = segments.groupBy("part").applyInArrow(_shard, "doc_id long, spans binary").groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    spans = tables.write(spans, "spans")
    tables.drop("asked")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            raw = (t or "").encode()
            removed, runs, kept = _cut(raw, s)
            for x, v in zip(out, (hashlib.sha256(raw).hexdigest(), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None)):
                x.append(v)
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {k: pa.array(v, t) for k, v, t in zip(("sha", "n_removed", "n_spans", "kept_sha256", "kept"), out, types)})

    done = map_batches(d.join(spans, "doc_id").select("doc_id", "text", "spans"), cut, "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string, kept string").dropDuplicates(["doc_id", "sha"])
    later = reps.where("first < last")
    # a text may have very many copies: its rows are dealt over several tasks
    return spread_join(base, later.select("sha", "first"), "sha", later.select("sha", "n"), n, "left"), done, tables


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, Tables]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Removed is each byte covered by a WIDTH-byte string that also starts in a document with a smaller doc_id. Null texts are empty;
    texts shorter than WIDTH bytes lose nothing. Rows that repeat a doc_id stay and don't remove from each other; rows with a null
    doc_id take no part and lose nothing. Columns other than doc_id and text play no part.
    """
    base, done, tables = _find(docs, False)
    all_ = base.join(done, ["doc_id", "sha"], "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    lost = lambda whole, column: F.when(copy, whole).otherwise(F.coalesce(column, F.lit(0))).cast("long").alias(column)
    return all_.select("doc_id", "n_bytes", lost(F.col("n_bytes"), "n_removed"), lost(F.lit(1), "n_spans"), F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")), tables


def strip_repeats(docs: DataFrame) -> tuple[DataFrame, Tables]:
    """docs with the removed bytes gone from text (a character that is cut apart goes whole) and n_chars, if there, set anew.

    Rows of which nothing is left go, as all they say stands in smaller documents; rows that lose nothing are as they were.
    """
    base, done, tables = _find(docs, True)
    whole = base.where("first < doc_id").select("doc_id", "sha", F.lit("").alias("kept")).distinct()
    changed = done.where("n_removed > 0").join(whole.select("doc_id", "sha"), ["doc_id", "sha"], "left_anti").select("doc_id", "sha", "kept").union(whole)
    changed = tables.write(changed, "changed").toDF("doc_id_", "sha_", "kept_")
    key = (docs["doc_id"].cast("long") == changed["doc_id_"]) & (F.sha2(F.encode(docs["text"].cast("string"), "UTF-8"), 256) == changed["sha_"])
    out = docs.join(changed, key, "left").where("kept_ IS NULL OR kept_ <> ''")
    text = F.coalesce(F.col("kept_"), docs["text"])
    fresh = {"text": text, "n_chars": F.when(F.col("kept_").isNull(), docs["n_chars"]).otherwise(F.length("kept_").cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[fresh.get(c, docs[c]).alias(c) for c in docs.columns]), tables


def op6_suffix(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
