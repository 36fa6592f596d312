"""Each stage of the pipeline against brute force over what the stage before it kept."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken  # noqa: F401

import corpus_pipeline
from harborlight.llm import bpe, quality

from test_llm import SCHEMA, _rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(14, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _firsts(rows):
    """Rows but for documents joined, by links of 0.8, to a smaller doc_id."""
    sets, find = collections.defaultdict(list), {}
    for r in rows:
        if r.doc_id is not None:
            sets[r.doc_id].append(_sets(r.text))
            find[r.doc_id] = r.doc_id
    for _ in find:
        for a in find:
            for b in find:
                if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    find[a] = find[b] = min(find[a], find[b])
    return [r for r in rows if r.doc_id is None or find[r.doc_id] == r.doc_id]


def _stripped(rows):
    """(doc_id, text) without 50-byte strings of smaller documents; rows of which nothing is left go."""
    first, out = {}, []
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], r.doc_id)
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if r.doc_id is not None and first[b[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore") if any(gone) else r.text
        if not (any(gone) and not kept):
            out.append((r.doc_id, kept))
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id, r.text)
    good = stages["quality classifier"](spark, docs, folder)
    scored = quality.score_quality(docs, quality.train_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    rejected = {r.doc_id for r in scored if not r.predicted}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} <= {r.doc_id for r in scored}
    assert all(r.doc_id not in rejected for r in good.collect() if r.doc_id is not None)

    # from here on over all documents, so that copies and passages meet each stage
    once = stages["n-gram Jaccard join"](spark, docs, folder)
    assert once.columns == docs.columns
    assert collections.Counter(map(key, once.collect())) == collections.Counter(map(key, _firsts(docs.collect())))
    cut = stages["suffix-array dedup"](spark, docs, folder)
    assert cut.columns == docs.columns
    assert collections.Counter(map(key, cut.collect())) == collections.Counter(_stripped(docs.collect()))
    mixed = stages["mixing sources to target weights"](spark, docs, folder)
    took, had = collections.Counter(r.doc_id for r in mixed.collect()), collections.Counter(r.doc_id for r in docs.collect())
    assert mixed.columns == docs.columns and set(took) <= set(had) and all(n <= 2 * had[i] for i, n in took.items())
    path = public_tokenizers.path(bpe.RANKS)
    e, want = bpe.encoding(path), collections.Counter()
    for r in docs.collect():
        want[r.doc_id, hashlib.sha256(",".join(map(str, e.encode_ordinary(r.text or ""))).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in stages["byte-level BPE encoding and decoding"](spark, docs, folder).collect()) == want


def test_stages_of_an_empty_table(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality classifier":  # which has nothing to learn from
            assert stage(spark, none, folder).count() == 0


def test_run_goes_through_all_stages(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n, of: " ".join(rng.choice(of) + rng.choice(of) for _ in range(n))
    good, bad = ["vor", "pil", "dan", "mer", "tus"], ["zes", "que", "xyl", "jib", "wok"]
    texts = {i: words(300, good if i % 2 else bad) for i in range(160)}
    texts[161] = texts[159]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    taken = collections.Counter(r.doc_id for r in got)
    assert set(taken) == set(range(1, 160, 2)) and max(taken.values()) == 2
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
