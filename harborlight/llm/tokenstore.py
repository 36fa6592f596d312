"""Token-id output as a content-addressed store.

Format, three Parquet tables under one folder:
* chunks(digest, n, data): the unique chunks; data is zstd over little-endian unsigned ids (16 bits where the vocabulary allows,
  else 32), digest the first 16 bytes of the SHA-256 of the ids as 32-bit words;
* recipes(part, seq, doc_id, start, n_tokens, chunks, sizes, root): how a document is put together, in ascending doc_id order by part
  and seq; start counts ids within the part, root is the Merkle root of its chunks' digests;
* manifest(part, first, n_docs, n_tokens, start, root): a row a part; root is the Merkle root over its documents' roots, start the
  number of ids in all parts before.
Chunk ends are set by a rolling hash over the last WINDOW ids, so equal passages give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Tables, arrow_limits, map_batches, mix64, piece_hashes, text_bytes

VOCABULARY = "byte_bpe_50k.json"
END = 0
WINDOW, MASK, LEAST, MOST = 8, 1023, 256, 8192
#: Entries of a worker's table of known words; a full one is emptied.
SLOTS, FULL = 1 << 21, 700_000


def _byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Encodes whole texts with the model of a tokenizers file.

    A text is cut before each space that follows no white space: a match of the splitting pattern starts there in any case, so the
    ids of the parts, end to end, are the text's. Each distinct part is given to the library once and then found by a 64-bit hash.
    Texts that hold one of the file's added tokens go through the library whole (encode_batch).
    """

    def __init__(self, path: str) -> None:
        tok = Tokenizer.from_file(path)
        self.tok, self.model, self.small = tok, tok.model, tok.get_vocab_size() <= 1 << 16
        self.added = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(_byte_letters()))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.empty()

    def empty(self) -> None:
        self.keys, self.slot = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.known, self.ids, self.used = 0, np.zeros(1 << 20, np.uint32), 0
        self.at, self.len = np.zeros(FULL, np.int64), np.zeros(FULL, np.int32)

    def part(self, piece: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.findall(piece):
            plain = m.isascii() and m.isprintable()  # of these only the space has another letter
            out += [t.id for t in self.model.tokenize(m.replace(" ", self.letters[32]) if plain else m.encode().decode("latin-1").translate(self.letters))]
        return out

    def with_added(self, data: np.ndarray, starts: np.ndarray) -> list[int]:
        """The texts that hold an added token, which the file takes out before the model sees a text."""
        raw, rows = data.tobytes(), set()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                k = int(np.searchsorted(starts, at, "right")) - 1
                if at + len(content) <= starts[k + 1]:
                    rows.add(k)
                at = raw.find(content, at + 1)
        return sorted(rows)

    def find(self, h: np.ndarray) -> np.ndarray:
        got, todo, s = np.full(len(h), -1, np.int64), np.arange(len(h)), h & np.uint64(SLOTS - 1)
        while len(todo):
            held = self.slot[s]
            hit = (held >= 0) & (self.keys[s] == h[todo])
            got[todo[hit]] = held[hit]
            more = (held >= 0) & ~hit
            todo, s = todo[more], (s[more] + np.uint64(1)) & np.uint64(SLOTS - 1)
        return got

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        """Add parts with distinct hashes that the table does not hold."""
        flat, sizes = [], []
        for word in words:
            ids = self.part(word)
            flat += ids
            sizes.append(len(ids))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        size, number = np.array(sizes, np.int64), np.arange(self.known, self.known + len(h))
        self.at[number], self.len[number] = self.used + np.cumsum(size) - size, size
        self.known, self.used = self.known + len(h), self.used + len(flat)
        todo, s = np.arange(len(h)), h & np.uint64(SLOTS - 1)
        while len(todo):  # of the parts that want one slot, the first gets it if it is free; all others try the next
            _, first = np.unique(s, return_index=True)
            put = first[self.slot[s[first]] < 0]
            self.keys[s[put]], self.slot[s[put]] = h[todo[put]], number[todo[put]]
            more = np.ones(len(todo), bool)
            more[put] = False
            todo, s = todo[more], (s[more] + np.uint64(1)) & np.uint64(SLOTS - 1)

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (one more than texts)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        prev = np.concatenate([np.zeros(3, np.uint8), data[:-1]])
        last, before, third = prev[2:], prev[1:-1], prev[:-2]  # the bytes one, two and three back
        blank = (last <= 32) | ((before == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((last >= 128) & (third >= 0xE1) & (third <= 0xE3))
        cut = (data == 32) & ~blank
        cut[starts[:-1][starts[:-1] < len(data)]] = True
        begin = np.flatnonzero(cut)
        h, raw = piece_hashes(data, begin), data.tobytes()
        ends, sizes, ids = np.concatenate([begin[1:], [len(data)]]), [], []
        for k in range(0, len(h), FULL):  # a block has no more distinct parts than the table holds
            part = h[k : k + FULL]
            where = self.find(part)
            new = np.flatnonzero(where < 0)
            fresh, first = np.unique(part[new], return_index=True)
            if self.known + len(fresh) > FULL:
                self.empty()
                new, (fresh, first) = np.arange(len(part)), np.unique(part, return_index=True)
            if len(new):
                at = k + new[first]
                self.learn(fresh, [raw[x:y].decode() for x, y in zip(begin[at].tolist(), ends[at].tolist())])
                where[new] = self.find(part[new])
            size = self.len[where].astype(np.int64)
            base = self.at[where] - (np.cumsum(size) - size)
            ids.append(self.ids[np.arange(size.sum()) + np.repeat(base, size)])
            sizes.append(size)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(ids), upto[np.searchsorted(begin, starts)]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_batch(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, starts = text_bytes(column)
    e = encoder(path)
    ids, upto = e.encode(data, starts)
    rows = e.with_added(data, starts)
    if not rows:
        return ids, upto
    parts = [ids[a:b] for a, b in zip(upto[:-1], upto[1:])]
    for k in rows:
        parts[k] = np.array(e.tok.encode(data[starts[k] : starts[k + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def chunk_ends(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one document: where the rolling hash of the last WINDOW ids says so, LEAST to MOST ids apart."""
    if len(ids) <= LEAST:
        return np.array([len(ids)])
    g = mix64(ids.astype(np.uint64) + np.uint64(1))
    roll, power = g.copy(), 1
    for k in range(1, WINDOW):
        power = power * 0x9E3779B97F4A7C15 % (1 << 64)
        roll[k:] += g[:-k] * np.uint64(power)
    marks = np.flatnonzero(roll >> np.uint64(40) & np.uint64(MASK) == 0) + 1
    ends, at = [], 0
    while len(ids) - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        at = min(int(marks[k]) if k < len(marks) else len(ids), at + MOST, len(ids))
        ends.append(at)
    if at < len(ids):
        ends.append(len(ids))
    return np.array(ends)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up, and no leaves give the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, path: str, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encode every whole text (null: empty), append END, and write the three tables; they are returned as read back from there.

    One pass encodes and writes recipes and, once a task, each chunk; then ids of equal digest are thinned to one row. Rows that
    repeat a doc_id are documents of their own, in the order of their roots; a null doc_id comes first.
    """
    spark = docs.sparkSession
    arrow_limits(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, at = encode_batch(path, b.column("text"))
            kind = "<u2" if encoder(path).small else "<u4"
            out: dict[str, list] = {k: [] for k in ("kind", "doc_id", "n", "digests", "sizes", "data")}
            for doc_id, x, y in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                mine = np.append(ids[x:y], np.uint32(END)).astype("<u4")
                begin, digests, sizes = 0, [], []
                for end in chunk_ends(mine).tolist():
                    part = mine[begin:end]
                    d = hashlib.sha256(part).digest()[:16]
                    digests.append(d)
                    sizes.append(end - begin)
                    if d not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(d)
                        for k, v in zip(out, (1, None, end - begin, d, None, pack.compress(part.astype(kind).tobytes()))):
                            out[k].append(v)
                    begin = end
                for k, v in zip(out, (0, doc_id, len(mine), b"".join(digests), np.array(sizes, "<u4").tobytes(), None)):
                    out[k].append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    staged = d.mapInArrow(encode, "kind int, doc_id long, n long, digests binary, sizes binary, data binary")
    staged = tables.write(staged, "staged", ("kind",), "none")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = start = 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = start + np.cumsum(n)
            roots = [merkle([c[i : i + 16] for i in range(0, len(c), 16)]) for c in b.column("digests").to_pylist()]
            yield pa.RecordBatch.from_pydict({"part": b.column("part"), "seq": pa.array(np.arange(seq, seq + len(n))), "doc_id": b.column("doc_id"), "start": pa.array(ends - n), "n_tokens": b.column("n"), "chunks": b.column("digests"), "sizes": b.column("sizes"), "root": pa.array(roots, pa.binary())})
            seq, start = seq + len(n), int(ends[-1]) if len(n) else start

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged.where("kind = 0").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digests")
    recipes = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n", "digests", "sizes").mapInArrow(number, "part int, seq long, doc_id long, start long, n_tokens long, chunks binary, sizes binary, root binary")
    recipes = tables.write(recipes, "recipes")
    chunks = staged.where("kind = 1").select(F.col("digests").alias("digest"), F.col("n").cast("int").alias("n"), "data").dropDuplicates(["digest"])
    chunks = tables.write(chunks, "chunks")
    tables.drop("staged")
    manifest = tables.write(_manifest(recipes), "manifest")
    return chunks, recipes, manifest


def _manifest(recipes: DataFrame) -> DataFrame:
    """The tree over a part's documents, built by blocks of 4096 of them, so that no task holds a whole part's rows."""
    blocks = recipes.withColumn("block", F.floor(F.col("seq") / 4096)).groupBy("part", "block").agg(
        F.min(F.struct("seq", "doc_id"))["doc_id"].alias("first"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "root"))).alias("leaves"))
    root = F.udf(lambda leaves: merkle([bytes(x.root) for x in leaves]), "binary")
    blocks = blocks.select("part", F.col("block").alias("seq"), "first", "n_docs", "n_tokens", root("leaves").alias("root"))
    parts = blocks.groupBy("part").agg(F.min(F.struct("seq", "first"))["first"].alias("first"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), root(F.sort_array(F.collect_list(F.struct("seq", "root")))).alias("root"))
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")  # a row a part
    return parts.select("part", "first", "n_docs", "n_tokens", before.alias("start"), "root")


def _ids(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def read_ids(chunks: DataFrame, recipes: DataFrame) -> DataFrame:
    """doc_id, start (in its part), ids (packed 32-bit): the documents put together again, for readers of the store."""
    parts = recipes.select("part", "seq", "doc_id", "start", F.posexplode(_digests(F.col("chunks"))).alias("pos", "digest"))
    got = parts.join(chunks, "digest", "left").groupBy("part", "seq", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "data"))).alias("parts"))
    return got.select("doc_id", "start", F.udf(lambda ps: b"".join(_ids(bytes(p.data), p.n).tobytes() for p in ps), "binary")("parts").alias("ids"))


def _digests(c):
    return F.transform(F.sequence(F.lit(1), F.length(c), F.lit(16)), lambda i: F.substring(c, i, 16))


def _shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32 registers moved on over `after` zero bytes: products with powers of x modulo the CRC polynomial."""
    crc, after = crc.astype(np.uint32), after.astype(np.uint64)
    column = np.uint32(1) << np.arange(32, dtype=np.uint32)  # the map of one zero bit, applied to each unit
    column = np.where(column & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ column >> np.uint32(1)

    def apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where(v >> np.uint32(i) & np.uint32(1), m[i], np.uint32(0))
        return out

    for _ in range(3):
        column = apply(column, column)
    while after.any():
        odd = (after & np.uint64(1)).astype(bool)
        crc = np.where(odd, apply(column, crc), crc)
        column, after = apply(column, column), after >> np.uint64(1)
    return crc


def digests_of_documents(chunks: DataFrame, recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored files.

    Each stored chunk is read, checked against its digest and summed once; a document's CRC-32 is combined from those of its chunks
    and the ids after each, so no ids are shuffled. A missing or damaged chunk, or a recipe that differs from its root, raises.
    """

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        crc = []
        for d, n, data in zip(b.column("digest").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist()):
            ids = _ids(data, n)
            if len(ids) != n or hashlib.sha256(ids).digest()[:16] != d:
                raise ValueError(f"damaged chunk {d.hex()}")
            crc.append(zlib.crc32(ids))
        return pa.RecordBatch.from_pydict({"digest": b.column("digest"), "n": b.column("n"), "crc": pa.array(crc, pa.int64())})

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        c, s = b.column("chunks").to_pylist(), [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column("sizes").to_pylist()]
        for x, root in zip(c, b.column("root").to_pylist()):
            if merkle([x[i : i + 16] for i in range(0, len(x), 16)]) != root:
                raise ValueError("recipe differs from its root")
        row = np.repeat(np.arange(len(c)), [len(x) for x in s])
        take = pa.array(row)
        after = np.concatenate([x.sum() - np.cumsum(x) for x in s] or [np.zeros(0, np.int64)]) * 4
        return pa.RecordBatch.from_pydict({k: b.column(k).take(take) for k in ("part", "seq")} | {"digest": pa.array([x[i : i + 16] for x in c for i in range(0, len(x), 16)], pa.binary()), "size": pa.array(np.concatenate(s or [np.zeros(0, np.int64)]).astype(np.int64)), "after": pa.array(after.astype(np.int64))})

    def move(b: pa.RecordBatch) -> pa.RecordBatch:
        if b.column("crc").null_count:
            raise ValueError("missing chunk")
        return pa.RecordBatch.from_pydict({k: b.column(k) for k in ("part", "seq")} | {"crc": pa.array(_shift(b.column("crc").to_numpy(), b.column("after").to_numpy()).astype(np.int64)), "n": b.column("n")})

    sums = map_batches(chunks, check, "digest binary, n int, crc long")
    uses = map_batches(recipes.select("part", "seq", "chunks", "sizes", "root"), spread, "part int, seq long, digest binary, size long, after long")
    moved = map_batches(uses.join(sums, "digest", "left").select("part", "seq", "crc", "after", F.col("n").cast("long").alias("n")), move, "part int, seq long, crc long, n long")
    whole = moved.groupBy("part", "seq").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_tokens"))
    starts = F.broadcast(manifest.select("part", F.col("start").alias("base")))  # a row a part: at most spark.sql.shuffle.partitions
    return recipes.select("part", "seq", "doc_id", "start").join(whole, ["part", "seq"]).join(starts, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op3_tokenstore(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests_of_documents(*write_store(docs, public_tokenizers.path(VOCABULARY), Tables(spark, "tokens")))
