"""Operators in a free style against plain references: round trips, brute force, hand-made cases."""

import html
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import CLASH, ODD, SF
from unionlake.llm import near_dup, ngram_lm, packing, page_text, queries, token_files
from unionlake.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


# near-dedup

def brute_classes(rows, threshold=0.8, width=5):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= threshold * len(a | b)):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_near_classes_brute_force(spark, make_docs):
    r = random.Random(3)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for g in range(12):
        base = r.choices(vocabulary, k=r.choice([30, 80, 200]))
        for _ in range(r.choice([1, 3, 9])):
            rows.append(" ".join(w if r.random() > 0.01 * (g % 4) else r.choice(vocabulary) for w in base))
    rows = list(enumerate(rows)) + [(d + 1000 if d is not None else None, t) for d, t in ODD]
    got = near_dup.near_classes(make_docs(rows, CLASH))
    assert sorted(((x.doc_id, x.class_id) for x in got.collect()), key=str) == brute_classes(rows)


def test_near_dedup_keeps_one(make_docs, spark):
    docs = make_docs(ODD, CLASH)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == [1, 4, 5, 7, 8, None]
    assert near_dup.near_classes(docs.limit(0)).count() == 0 and near_dup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_darts_estimate_weighted_similarity():
    g = np.random.default_rng(1)
    w = [g.uniform(0.2, 9, 200) for _ in range(2)]
    e = np.arange(1, 201, dtype=np.uint64)
    s = near_dup.dart_signatures(np.concatenate((e, e)), np.repeat([0, 1], 200), np.concatenate(w), 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum()) < 0.04


# token files

@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cut_encoding_equals_whole_texts(path):
    texts = [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    texts += [t for _, t in ODD] + ["<|startoftext|>a<|endoftext|> don't it'll 's. a's're x.y,z!!w e.g. 3.14 ''s '.s", "NBSP  a    b　 c   d \u0085 e", "a  b \n\n c\t", "é.a à a é’s 1,2 — .a —.b é x"]
    ids, ends = Encoder(path).encode(pa.array(texts, pa.string()))
    t = Tokenizer.from_file(path)
    for i, x in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_blocks_round_trip(tmp_path):
    g = np.random.default_rng(5)
    for ids in (np.zeros(0), np.zeros(700), g.integers(0, 2**32, 3000), np.where(g.random(5000) < 0.02, 2**31, g.integers(50, 60, 5000)), np.full(513, 2**32 - 1)):
        ids = ids.astype(np.uint32)
        path = tmp_path / f"f{len(ids)}"
        with open(path, "wb") as f:
            w = token_files.Writer(f, stretch=1000)
            for k, part in enumerate(np.array_split(ids, 7)):
                w.add(k if k else None, part)
            w.close()
        r = token_files.Reader(path)
        back = list(r.documents(stretch=2))
        assert [d for d, _ in back] == [None, 1, 2, 3, 4, 5, 6]
        assert np.array_equal(np.concatenate([p for _, parts in back for p in parts] or [ids[:0]]), ids)
        assert len(ids) <= token_files.BLOCK or np.array_equal(r.blocks(1, 2), ids[token_files.BLOCK : 2 * token_files.BLOCK])
    skewed = b"".join(token_files.pack_blocks(np.where(g.random(1 << 16) < 0.02, 2**31, g.integers(50, 60, 1 << 16)).astype(np.uint32)))
    assert len(skewed) < (1 << 16) * 0.8  # exceptions don't widen the block


def encoded(path, rows, end):
    t = Tokenizer.from_file(path)
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [end]) for d, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, make_docs):
    rows = ODD + [(d + 100, t) for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()]
    docs = make_docs(rows, CLASH).repartition(5)
    got = [tuple(r) for r in token_files.read_token_files(token_files.write_token_files(docs, BYTE)).collect()]
    want, at = [], 0
    for d, ids in encoded(BYTE, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), 0):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), BYTE)).count() == 0


# packing

def test_packing(make_docs):
    docs = make_docs(ODD + [(100 + i, "word " * n) for i, n in enumerate([9000, 4095, 4096, 1, 2048, 2047] * 5)], CLASH)
    cut = packing.pieces(docs, WORD)
    want = Counter((d, k, at, len(p), crc(p)) for d, ids in encoded(WORD, [(r.doc_id, r.text) for r in docs.collect()], 1) for k, at in enumerate(range(0, len(ids), 4096)) for p in [ids[at : at + 4096]])
    for group in (50_000, 7):
        packed = packing.pack(cut, group=group)
        rows = packed.collect()
        assert Counter(tuple(r)[:5] for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 4096
    used, bound = packing.certificate(packing.pack(cut))
    assert bound <= used <= bound + 1
    assert packing.pack(packing.pieces(docs.limit(0), WORD)).count() == 0


@pytest.mark.parametrize("low,high", [(700, 2000), (1000, 1600), (1, 4096)])
def test_exchange_brings_partitions_near_one_task(spark, low, high):
    g = np.random.default_rng(low)
    lengths = g.integers(low, high + 1, 6000)
    cut = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECE)
    packed = packing.pack(cut, group=500)
    used, bound = packing.certificate(packed)
    alone = sum(len(packing.best_fit(p, 4096)[2]) for p in np.array_split(lengths, 12))  # partitions without an exchange
    whole = len(packing.best_fit(lengths, 4096)[2])
    assert packed.count() == 6000 and packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").isEmpty()
    assert bound <= used <= alone and used - whole <= max(2, 0.02 * whole), (bound, whole, used, alone)


def test_given_up_sequences():
    fill, counts = np.array([4096, 10, 4000, 4096, 3000, 3500]), np.array([1, 1, 2, 3, 2, 3])
    assert np.flatnonzero(packing.given_up(fill, counts, True, 4096)).tolist() == [1]
    assert np.flatnonzero(packing.given_up(fill, counts, False, 4096)).tolist() == [1, 4, 5]
    assert not packing.given_up(np.array([4096]), np.array([9]), True, 4096).any()
    assert packing.given_up(np.array([4000]), np.array([9]), False, 4096).all()


def test_bounds_never_exceed_best_packings():
    r = random.Random(2)
    for _ in range(300):
        capacity, sizes = 20, [r.randint(1, 20) for _ in range(r.randint(1, 8))]
        best = len(sizes)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= capacity:
                    bins[b] += sizes[i]
                    go(i + 1, bins)
                    bins[b] -= sizes[i]
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        assert packing.lower_bound(np.array(sizes), capacity) <= best <= len(packing.best_fit(np.array(sizes), capacity)[2])
    assert packing.lower_bound(np.array([11] * 6), 20) == 6  # more than the sum says


# page text

def test_lines_and_flags():
    page = """<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><header>Top</header><div class="side-bar cookie">c</div><form>f<input></form>
    <article class="post"><header><h1>A &amp; B &copy; &#233;&nbsp;x</h1></header><p>One <b>t</b>wo<br>three<p>four<script>no()</script><div id="comments">bad</div><aside>s</aside>&am</article><footer>foot</footer><p>loose <"""
    text = page_text.main_text(page_text.lines(page), set())
    assert text == "A & B © é x One two three four &am"
    assert page_text.lines(None) == page_text.lines("") == page_text.lines("<p> </p><!-- x") == []
    assert page_text.main_text(page_text.lines("a<br>b <i>c</i>d"), {1}) == "a"


def test_marks_of_layout_wrappers():
    text = lambda page, shared=(): page_text.main_text(page_text.lines(page), set(shared))
    body = "<h1>Title</h1><p>The text of the page.</p>"
    for name in ("content has-sidebar", "post no-comments", "social-studies", "sidebar", "comments"):
        for page in (f'<div class="{name}"><article>{body}</article></div><div>tail</div>', f'<section id="{name}"><div>{body}</div></section>'):
            assert text(page) == "Title The text of the page.", page
    assert text(f'<div class="sidebar"><p>Menu</p>{body}</div>', {0}) == "Title The text of the page."
    assert text(f'<form action=x><div class=page><article>{body}</article></div></form>') == "Title The text of the page."
    for mark in ("sidebar", "ad-banner", "x cookie_notice", "comments"):
        assert text(f'{body}<div class="{mark}">gone <p>too</p></div>') == "Title The text of the page."
    assert text(f'<article>{body}<div class="comments">{"long " * 50}<article>reply</article></div></article>') == "Title The text of the page."
    assert text(f"<article>{body}</article><aside><article>other</article></aside>") == "Title The text of the page."
    assert text(f'<div id=comments><article class=comment>reply</article></div><article>{body}</article>') == "Title The text of the page."
    for name in ("select", "button", "iframe"):
        assert text(f"<div><{name}>{body}</div>") == "Title The text of the page."
    assert text(f"{body}<script>code") == "Title The text of the page."
    deep = text('<div class="sidebar">' * 3000 + body + "</div>" * 3000)
    assert deep == "Title The text of the page."


def test_shared_places_are_a_longest_common_subsequence():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        places = page_text.shared_places(a, b)
        assert len(places) == t[-1][-1] and places == sorted(set(places))
        it = iter(b)
        assert all(any(x == y for y in it) for x in (a[p] for p in places))


def test_extract(spark):
    pages = [(i, f"http://h.com/a/{i}", f"<div>Menu</div><div>Second</div><p>own {i}</p><div>Bottom</div>") for i in range(6)]
    pages += [(90, "http://solo.com/", "<p>x</p>"), (91, None, "<article>y</article>"), (92, "http://e.com/", None), (92, "http://e.com/", ""), (93, "http://h.com/a/0", "<div>Menu</div>again"), (None, "u", "<p>&lt;</p>")]
    df = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, key string, host string")
    got = Counter((r.page_id, r.text) for r in page_text.extract(df).collect())
    assert got == Counter([(i, f"own {i}") for i in range(6)] + [(90, "x"), (91, "y"), (92, ""), (92, ""), (93, "again"), (None, "<")])
    assert page_text.extract(df.limit(0)).count() == 0


def test_extract_deletes_repeated_lines_of_articles(spark):
    long = "A paragraph that every page of this host quotes word by word, and that is far too long to be a notice. " * 3
    body = lambda i: f"<article><p>Share this</p><h1>Title {i}</h1><p>own text number {i} of the page, which nobody else has{' and more of it' * 40}</p><p>{long}</p>{f'<p>more {i}</p>' * i}<p>Quoted.</p>{f'<p>rest {i}</p>' * i}<p>Read more of us</p></article>"
    pages = [(i, f"http://h.com/a/{i}", body(i)) for i in range(5)]
    copies = [(10 + i, f"http://copy.com/{i}", "<article><h1>Same</h1><p>the whole article</p></article>") for i in range(4)]
    df = spark.createDataFrame(pages + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract(df).collect()}
    for i in range(5):
        edge = lambda t: f"{t} " if i in (0, 4) else ""  # noqa: B023, E731  the ends of the host have one neighbour, which proves nothing
        kept = f"more {i} " * i + "Quoted. " + f"rest {i} " * i
        assert got[i].startswith(f"{edge('Share this')}Title {i} own text number {i}") and long.strip() in got[i] and kept in f"{got[i]} "
        assert got[i].endswith("Read more of us") == (i in (0, 4))
    assert {got[10 + i] for i in range(4)} == {"Same the whole article"}


def test_extract_articles_of_the_table(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.QUERIES["op5_page_differencing"](spark, SF).collect()}
    for i, h in duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        text = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", article)))).strip()
        assert got[i] == (text, len(text))


# language model

def brute_model(train, docs):
    uni, pairs = Counter(), Counter()
    for t in train:
        w = [*t, "</s>"]
        uni.update(w)
        pairs.update(zip(["<s>", *w], w))
    cont, ctx = Counter(v for _, v in pairs), Counter()
    for (u, _), c in pairs.items():
        ctx[u] += c
    many = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
    dp, dw = ngram_lm.discounts(*many(pairs)), ngram_lm.discounts(*many(cont))
    n, v, total = sum(uni.values()), len(uni), sum(cont.values())
    mass = sum(dw[min(c, 3)] for c in cont.values()) / total if total else 1.0
    back = Counter()
    for (u, _), c in pairs.items():
        back[u] += dp[min(c, 3)]

    def p(u, w):
        low = (max(cont[w] - dw[min(cont[w], 3)], 0) / total if total else 0) + mass / (v + 1)
        return (max(pairs[u, w] - dp[min(pairs[u, w], 3)], 0) + back[u] * low) / ctx[u] if ctx[u] else low

    out = []
    for t in docs:
        w = [*t, "</s>"]
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w))))
    vocabulary = list(uni)
    for u in ["<s>", *vocabulary[:5], "never seen"]:
        assert abs(sum(p(u, x) for x in [*vocabulary, "unknown"]) - 1) < 1e-9
    return out


def low(t):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)]


@pytest.mark.parametrize("shards", [4_000_000, 3000, 30])
def test_model_against_brute_force(spark, make_docs, shards):
    rows = ODD + [(d + 100, t) for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' limit 60").fetchall()]
    docs = make_docs(rows).select("doc_id", "text", ngram_lm.held_out("doc_id").alias("held_out"))
    kept = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 != 0
    model = ngram_lm.train(docs.where("not held_out"), pairs_per_shard=shards, most=5000)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram_lm.score(docs, model).collect()), key=str)
    want = brute_model([low(t) for d, t in rows if kept(d)], [low(t) for _, t in rows])
    assert model.words.total == want[0][2]
    for g, w in zip(got, sorted(((d, a, b, x, y) for (d, _), (a, b, _, x, y) in zip(rows, want)), key=str)):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)


def test_model_beats_word_counts_on_held_out_texts(spark):
    r = [x for x in queries.QUERIES["op8_kneser_ney"](spark, SF.replace("0.001", "0.01")).collect() if x.held_out]
    assert len(r) > 20 and sum(x.score for x in r) > sum(x.base_score for x in r)


def test_model_of_nothing(spark, make_docs):
    empty = make_docs([]).select("doc_id", "text")
    model = ngram_lm.train(empty)
    assert ngram_lm.score(empty, model).count() == 0
    row = ngram_lm.score(make_docs(["a b"]), model).first()
    assert (row.n_tokens, row.n_known) == (3, 0) and row.score == pytest.approx(0.0)


def test_files_need_a_mounted_folder(spark, monkeypatch):
    from unionlake.llm import shared

    monkeypatch.setattr(shared, "scratch_path", lambda s, n: f"hdfs://x/{n}")
    with pytest.raises(ValueError):
        shared.shared_dir(spark, "a")
    assert not os.path.exists("hdfs:")
