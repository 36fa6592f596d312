"""The operators against brute force, on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken  # noqa: F401
from tokenizers import Tokenizer

from harborlight.llm import ann, bpe, common, embed, jaccard, langid, media, mixing, pages, quality, suffix, tokenstore
from harborlight.llm.common import Tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, n long, component string"


def _rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "an", "er", "ré", "tion", "Ü"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, line = text(120), text(14)
    out = [(0, base), (1, base), (2, base + " tail end"), (3, None), (4, ""), (5, "   \n"), (6, "a b"), (7, "A  B"), (8, line + "\n" + text(80)), (9, text(60) + "\n" + line), (10, base.upper()), (11, "x" * 300), (12, "y" + "x" * 200), (13, text(3000))]
    for i in range(14, 60):
        w = base.split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w) if i % 2 else text(rng.randint(1, 90))))
    out += [out[8], out[8], (None, base), (None, None)]
    return [(i, t, ["en", None, "fr"][k % 3], [None, "b", "a", "c"][k % 4], len(t or ""), "x", "y", 1, "z") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("rest, shares", [(jaccard.REST, common.SHARES), (0.2, 5)])  # few pairs a block, and keys dealt over tasks
def test_jaccard(docs, rows, empty, monkeypatch, rest, shares):
    monkeypatch.setattr(jaccard, "REST", rest)
    monkeypatch.setattr(common, "SHARES", shares)
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    find = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    find[a] = find[b] = min(find[a], find[b])
    got = [tuple(r) for r in jaccard.link(docs)[0].collect()]
    want = [(i, len(sets[i]) if i is not None else None, find.get(i)) for i, *_ in rows]
    assert collections.Counter((i, n if i is not None else None, c) for i, n, c in got) == collections.Counter(want)
    assert jaccard.link(empty)[0].count() == 0


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(60):
        t = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 90))]
        assert suffix.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("shares", [1000, 1 << 40])
def test_suffix_removal(docs, rows, empty, monkeypatch, shares):
    monkeypatch.setattr(common, "SHARES", shares)
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = collections.Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[(i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    assert collections.Counter(map(tuple, suffix.remove_repeats(docs)[0].collect())) == want
    kept = suffix.strip_repeats(docs)[0]
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 3, 4, 6}
    assert suffix.remove_repeats(empty)[0].count() == 0


def test_token_store(spark, docs, rows, empty):
    path = public_tokenizers.path(tokenstore.VOCABULARY)
    tok = Tokenizer.from_file(path)
    store = tokenstore.write_store(docs, path, Tables(spark, "t"))
    got = sorted(tuple(r) for r in tokenstore.digests_of_documents(*store).where("doc_id is not null").collect())
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t, *_ in rows]
    at, want = sum(len(x) for i, x in ids if i is None), []
    for i, x in sorted(((i, x) for i, x in ids if i is not None), key=lambda p: p[0]):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    back = {r.doc_id: bytes(r.ids) for r in tokenstore.read_ids(*store[:2]).collect()}
    assert back[13] == dict(ids)[13].tobytes() and back[4] == b"\0\0\0\0"
    assert tokenstore.digests_of_documents(*tokenstore.write_store(empty, path, Tables(spark, "t"))).count() == 0


def test_bpe(docs, rows, empty):
    path = public_tokenizers.path(bpe.RANKS)
    e = bpe.encoding(path)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = e.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, bpe.round_trip(docs, path).collect())) == want
    assert bpe.round_trip(empty, path).count() == 0
    long = "word and more. " * 20_000
    assert bpe.encode(long, path) == e.encode_ordinary(long)


def test_png_round_trip_with_every_filter(docs, rows):
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (7, 5), (40, 576)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.read_png(media.write_png(x)) == x).all()
    x = rng.integers(0, 256, (5, 9), dtype=np.uint8)
    rows_ = np.zeros((5, 10), np.uint8)
    for y in range(5):  # one row of each filter, by the formulas
        rows_[y, 0] = y
        for k in range(9):
            a, b, c = (int(x[y, k - 1]) if k else 0), (int(x[y - 1, k]) if y else 0), (int(x[y - 1, k - 1]) if y and k else 0)
            p = min((a, b, c), key=lambda v: abs(a + b - c - v))
            rows_[y, k + 1] = (int(x[y, k]) - [0, a, b, (a + b) // 2, p][y]) % 256
    assert (media._unfilter(rows_, 1) == x).all()
    with pytest.raises(ValueError):
        media.read_png(media.write_png(x)[:-3] + b"abc")
    got = {r.doc_id: r for r in media.media_features(media.to_media(docs)).collect()}
    for i, t, *_ in rows:
        if i is not None:
            p = media.payload(t)[1]
            assert (got[i].payload_sha256, got[i].tail_crc32) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_mixing(docs, rows, empty):
    got = [r.asDict() for r in mixing.mix(docs)[0].collect()]
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) <= 1.5 * sum(r["size"] for r in got) <= sum({r["source_size"]: r["target"] for r in got}.values()) * 1.001
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.mix(docs.repartition(3))[0].collect())
    assert mixing.mix(empty)[0].count() == 0


def test_mixing_on_two_levels(docs, monkeypatch):
    def found():
        return sorted(map(str, mixing.mix(docs)[0].collect()))

    want = found()
    for name, value in (("GROUP", 1), ("SLICE", 2), ("FAN", 3)):
        monkeypatch.setattr(mixing, name, value)
    assert found() == want


def test_classifiers(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(14, 60)] + [(None, 1, 0), (14, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, quality.train_quality(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score_quality(empty, quality.train_quality(empty, labels)).count() == 0
    got = {r.doc_id: r for r in langid.predict_language(docs, langid.train_language(docs)).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[13].lang_pred in ("en", "fr")


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:180] = x[100]
    rows = [(i, x[i].tolist()) for i in range(900)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (None, [1.0] * 16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(dict)
    for r in ann.search(d, lambda i: i % 20 == 0)[0].collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    v, hits = x.astype(float), 0
    for q in range(0, 900, 20):
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        hits += len(set(want.tolist()) & {i for i, _ in got[q].values()})
        assert [sc for _, (_, sc) in sorted(got[q].items())] == sorted((s[i] for i, _ in got[q].values()), reverse=True) and len(got[q]) == 20
    assert len(got) == 45 and hits >= 0.9 * 20 * 45
    assert ann.search(d.limit(0), lambda i: i % 20 == 0)[0].count() == 0


def test_pages(spark):
    shell = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div><article><h1>One &amp; two</h1><p><b>First{}<br><p>Next  line</p></article><aside>side</aside><footer>foot</footer>'
    d = spark.createDataFrame([(1, "http://a/1", shell.format(1)), (2, "http://a/2", shell.format(2)), (3, None, None), (4, "http://b/", ""), (5, "x", "<div>plain <i>words</i></div><form>no</form>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(d).collect()}
    assert got == {1: "One & two\nFirst1\nNext line", 2: "One & two\nFirst2\nNext line", 3: "", 4: "", 5: "plain words"}


def test_pages_without_an_article(spark):
    page = '<body><div class="top">Site</div>{}<div class="text"><p>Own <i>words</i> {}</p><p>Same in all</p></div><div class="end">Made by us</div>'
    note = '<div class="box"><span>Read more</span></div>'
    rows = [(i, "http://c/", page.format(note if i < 4 else "", f"of {i}")) for i in range(6)]
    rows += [(10 + i, "http://d/", page.format(note, "once")) for i in range(5)]
    rows += [(20, "http://e/", "<main> </main><p>Below <b>an</b> empty main</p>"), (21, "http://f/", "bare"), (22, "http://c/", "<article>Site<b>x</b></article><p>y")]
    rows += [(30 + i, "http://g/", f"<article><p>One <b>bold</b> word</p><p>{i}</p></article>") for i in range(4)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the template goes, an optional part of it too; the words that stand between them stay, in blocks of block elements alone
    want = {i: f"of {i}" for i in range(6)} | {10 + i: "Site\nRead more\nOwn words once\nSame in all\nMade by us" for i in range(5)}
    assert got == want | {20: "Below an empty main", 21: "bare", 22: "Sitex"} | {30 + i: f"One bold word\n{i}" for i in range(4)}


def test_pages_with_a_template_in_the_article(spark):
    """Fixed containers of a host's articles go; prose, parts that vary, optional parts and all that stands in copies alone stay."""
    page = '<nav>Menu {0}</nav><main><div class="top">Our <b>site</b></div><h1>News</h1><div class="by">By {1}</div><div class="text"><p>Same start</p>Own words {1}{2}</div><section>Get our app</section></main>'
    rows = [(i, "http://a/", page.format(i, i, "<div class='q'>Quoted</div>" if i < 3 else "")) for i in range(5)]
    rows += [(10 + i, "http://b/", page.format(i, 7, "")) for i in range(5)]  # copies of one article below different menus
    rows += [(20 + i, "http://c/", page.format(i, i, "")) for i in range(2)]  # too few
    rows += [(30 + i, "http://d/", f"<article><div>Alike</div></article><p>{i}</p>") for i in range(4)] + [(40 + i, "http://e/", f"<article><div>One</div><div>{i}</div></article>") for i in range(4)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(d).collect()}
    text = lambda i, quoted="": f"News\nBy {i}\nSame start\nOwn words {i}{quoted}"
    want = {i: text(i, "\nQuoted" if i < 3 else "") for i in range(5)}
    want |= {k: f"Our site\n{text(i)}\nGet our app" for k, i in [(10 + i, 7) for i in range(5)] + [(20, 0), (21, 1)]}
    assert got == want | {30 + i: "Alike" for i in range(4)} | {40 + i: f"One\n{i}" for i in range(4)}
    # the stage decides: without its tokens the fixed parts stay
    assert pages.article(rows[4][2], frozenset()) == f"Our site\n{text(4)}\nGet our app"


def test_training_reads_whole_texts(spark):
    rng = random.Random(6)
    words = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    start = words(5000, ["the", "and", "ing", "ter"])
    assert len(start) > 1 << 14
    rows = [(i, start + " " + words(4000, ["vorka", "pilum"] if i % 2 else ["zesty", "queb"]), "en" if i % 2 else "fr") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect():
        assert r.predicted == r.doc_id % 2
    for r in langid.predict_language(docs, langid.train_language(docs)).collect():
        assert r.lang_pred == ("en" if r.doc_id % 2 else "fr")
    text, p = rows[0][1] * 12, embed.Params()  # of more than one piece
    want = collections.Counter(x for part in embed.pieces(text) for b, ok, _ in embed.buckets([part], p) for x in b[ok].tolist())
    assert len(text) > embed.PIECE and dict(zip(*(x.tolist() for x in embed.counted(text, p)))) == want


def test_token_store_takes_added_tokens(spark):
    path = public_tokenizers.path(tokenstore.VOCABULARY)
    tok, end = Tokenizer.from_file(path), "<|endoftext|>"
    texts = ["plain words here", f"one{end}two", f"a  {end}  b", end, f"{end}{end} x\n", "cut <|endof", "text|> off", "", None, f"é{end}é " * 400, "<|<|endoftext|>|>"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in tokenstore.digests_of_documents(*tokenstore.write_store(d, path, Tables(spark, "t"))).collect())
    at, want = 0, []
    for i, t in enumerate(texts):
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want and tok.token_to_id(end) in tok.encode(texts[1], add_special_tokens=False).ids


def test_neighbours_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x[300:700] = x[300] + rng.normal(size=(400, 64)) * 1e-4
    x = x.astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.search(d, lambda i: (i >= 300) & (i < 700) & (i % 20 == 0))[0].collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(300, 700, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.98 * 20 * 20, hits


def test_empty_tables_repeated_rows_and_clashing_columns(spark, docs, empty):
    assert media.media_features(media.to_media(empty)).count() == 0
    assert langid.predict_language(empty, langid.train_language(docs)).count() == 0
    page = "page_id long, url string, html string, host string, texts string, copy int, copies int, n int"
    assert pages.extract(spark.createDataFrame([], page)).count() == 0
    html = "<nav>Menu</nav><article><p>One</p></article>"
    rows = [(1, "http://a/", html, "h", "t", 1, 2, 3)] * 3 + [(2, None, None, None, None, None, None, None)]
    got = collections.Counter(tuple(r) for r in pages.extract(spark.createDataFrame(rows, page)).select("page_id", "text", "n_chars").collect())
    assert got == {(1, "One", 3): 3, (2, "", 0): 1}
    got = collections.Counter(r.doc_id for r in langid.predict_language(docs, langid.train_language(docs)).collect())
    assert got == collections.Counter(r.doc_id for r in docs.collect())
