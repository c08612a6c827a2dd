"""Training-data operators against plain versions, on the smallest tables and on odd rows."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import bpe, chat, components, decontam, langid, minhash, queries, sharding, similar, simhash, sitetree, toxicity, urls
from tests.compare import connect, spark_rows, sql_rows

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, pos int"
ODD = [(1, None, "en", "s", 0, "x", 1, 1), (2, "", "en", "s", 0, "x", 1, 1), (3, "the same text of more than five words here", "en", "s", 0, "x", 1, 1), (3, "the same text of more than five words here", "en", "s", 0, "x", 1, 1), (None, "the same text of more than five words here", None, None, None, None, None, None), (5, "a " * 30000, "en", "s", 0, "x", 1, 1), (6, "12 34 !?", "fr", "s", 0, "x", 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL[name])


def test_chat_sql_on_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(None if c % 9 == 4 else c, None if t == 9 else t, [None, "", "user", "bot"][rng.integers(0, 4)], [None, "", "a", "b"][rng.integers(0, 4)]) for c in range(60) for t in rng.integers(0, 10, rng.integers(1, 5)).tolist()]
    rows += [(100, t, "user", f"x{t}") for t in range(5000)] + [(101, t, "user", f"x{t}") for t in range(70)]
    schema = "conv_id long, turn long, role string, text string"
    con = connect("/root/testdata/sf0.001")
    con.sql("drop view conversations")
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert spark_rows(chat.format_chats(spark.createDataFrame(rows, schema))) == sql_rows(con, queries.ORACLE_SQL["op2_chat"])


def test_turns_without_a_conversation_are_all_rendered(spark):
    """Each was a conversation of its own, so what began another conversation, or came twice, was gone."""
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "user", "own"), (None, 2, "user", "own"), (None, 300, "bot", "else"), (None, None, "bot", "")]
    con = connect("/root/testdata/sf0.001")
    con.sql("drop view conversations")
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    df = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in (("bot", ""), ("user", "hi"), ("user", "own"), ("user", "own"), ("bot", "else")))
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in df.collect()} == {(1, 2, 1), (None, 5, 1)} and told in {r.text for r in df.collect()}
    assert spark_rows(df) == sql_rows(con, queries.ORACLE_SQL["op2_chat"])


def law(rows, n):
    sizes = Counter(r.shard for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sum(sizes.values()) == n and max(sizes.values()) - min([sizes.get(s, 0) for s in range(max(sizes) + 1)]) <= 1


def test_sharding(spark, docs, odd):
    rows = sharding.shuffle_to_shards(docs, 24).collect()
    law(rows, docs.count())
    import zlib

    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    law(sharding.shuffle_to_shards(odd, 3).collect(), len(ODD))
    assert sharding.shuffle_to_shards(odd.limit(0), 3).count() == 0


def test_hypergeometric_law(spark):
    u = sharding.uniform(F.lit(1), F.col("id"))
    got = Counter(r.x for r in spark.range(20000).select(sharding.hypergeometric(F.lit(50), F.lit(20), F.lit(10), u).alias("x")).collect())
    from math import comb

    for k in range(11):
        assert abs(got[k] / 20000 - comb(20, k) * comb(30, 10 - k) / comb(50, 10)) < 0.012


def test_communication_matrix(spark):
    sizes = [(i, n) for i, n in enumerate([0, 7, 100, 3, 250, 11, 0, 1, 64])]
    df = spark.createDataFrame(sizes, "source int, n long")
    total = sum(n for _, n in sizes)
    cells = []
    for seed in range(10):
        rows = {r.source: r.counts for r in sharding.communication_matrix(df, 5, 3, seed).collect()}
        assert {i: sum(c) for i, c in rows.items()} == dict(sizes)
        assert [sum(c) for c in zip(*rows.values())] == [total // 5 + (j < total % 5) for j in range(5)]
        cells.append(rows[4])
    # rows of one source in one shard: mean and variance of the hypergeometric law
    x, share = np.array(cells, float), 250 / total
    want = share * total / 5
    spread = total / 5 * share * (1 - share) * (total - total / 5) / (total - 1)
    assert abs(x.mean() - want) < 0.5 and 0.5 * spread < x.var() < 1.8 * spread


def test_simhash_against_brute_force(spark, docs, odd):
    rng = np.random.default_rng(0)
    codes = {int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 5)))) for b in rng.integers(0, 2**63, 8, np.uint64) for _ in range(60)}
    codes = np.array(sorted(codes), np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    label = np.arange(len(codes))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(codes))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    for hot in (20000, 40):
        root = {r.node: r.root for r in components.connected_components(simhash.link_fingerprints(df, 3, hot)).collect()}
        found = defaultdict(set)
        for c, want in zip(codes.view(np.int64).tolist(), label.tolist()):
            found[root.get(c, c)].add(want)
        assert len(found) == len(set(label.tolist())) and all(len(v) == 1 for v in found.values())
    for n in (10, 10_000, 10**6, 10**9, 10**12):
        masks = [m % 2**64 for m in simhash.block_masks(3, n)]
        for _ in range(300):
            x = int(rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
            y = x ^ sum(1 << int(b) for b in {*rng.integers(0, 64, 3)})
            assert any(x & m == y & m for m in masks)
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    kept = similar.drop_similar(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
    assert similar.similar_documents(odd.limit(0)).count() == 0 and similar.drop_similar(odd.limit(0)).columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_gray_index_prunes_and_loses_nothing(spark, docs):
    codes = np.array(sorted({simhash.simhash(r.text) for r in docs.collect()}), np.int64).view(np.uint64)
    rng = np.random.default_rng(4)
    codes = np.unique(np.concatenate([codes, codes ^ (np.uint64(1) << rng.integers(0, 64, len(codes), np.uint64)), rng.integers(0, 2**63, 2000, np.uint64)]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    pairs = {tuple(p) for p in simhash.near_leaves(codes, 3).tolist()}
    n = -(-len(codes) // simhash.LEAF)
    near = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
    assert {(i // simhash.LEAF, j // simhash.LEAF) for i, j in near if i <= j} <= pairs
    assert len(pairs) < 0.6 * n * (n + 1) / 2
    label = simhash.link_node(codes, 3)
    assert all(label[i] == label[j] for i, j in near)


def test_simhash_hash_is_sparks(spark):
    assert simhash.simhash("A b c") == spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(7, "the SAME text of more than five words here"), (8, None), (9, "!!"), (10, "a a a a a a a a a a a a")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): r for r in decontam.contamination(odd, items).collect()}
    assert decontam.contamination(odd, items).count() == len(ODD)
    assert rows[3, 9].n_hit == rows[None, 9].n_hit == 9 and rows[5, 30000].n_hit == 30000 and not rows[1, 0].contaminated and not rows[6, 2].contaminated
    assert rows[3, 9].items_sha256 == hashlib.sha256(b"7").hexdigest() and rows[1, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.doc_id for r in decontam.drop_contaminated(odd, items).collect()) == [1, 2, 6]
    assert decontam.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    clash = odd.withColumns({"_did": F.lit(1), "_H": F.lit(2), "_id": F.lit(3), "_hash": F.lit(4)})
    assert sorted(r.doc_id for r in decontam.drop_contaminated(clash, items).collect()) == [1, 2, 6]
    assert sorted(r.doc_id for r in similar.drop_similar(clash).collect()) == sorted(r.doc_id for r in similar.drop_similar(odd).collect())


def plain_contamination(docs, items, window=10, slop=20):
    """n_words, n_hit, n_items, items_sha256, n_near of each (doc_id, text), word by word."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    texts = {(i, tuple(words(t))) for i, t in items if words(t)}
    out = []
    for doc_id, text in docs:
        w, hit, ids, near = words(text), set(), set(), 0
        for i, x in texts:
            size = min(window, len(x))
            wins = {x[s : s + size] for s in range(len(x) - size + 1)}
            at = [s for s in range(len(w) - size + 1) if tuple(w[s : s + size]) in wins]
            hit.update(p for s in at for p in range(s, s + size))
            ids.update([i] if at else [])
            n = len(set(x))
            near += n > 1 and any(set(x) <= set(w[s : s + n + slop - 1]) for s in range(len(w)))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest(), bool(hit), near))
    return out


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [("i1", " ".join(rng.choice(vocabulary, 14))), ("i1", " ".join(rng.choice(vocabulary, 14))), (None, " ".join(rng.choice(vocabulary, 12))), (None, "a a a a a a a a a a a"), ("i2", "w1 w2 w3"), ("i3", None), ("i4", "w7"), ("i5", "w5 absent"), ("i6", "w1 w2 w3")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(3)]
        _, t = items[rng.integers(0, len(items))]
        cut = (t or "").split()[rng.integers(0, 3) :]
        docs.append((None if i % 10 == 0 else f"d{i % 50}", " ".join([parts[0], " ".join(cut).upper(), parts[1], "w3, w2 x x W1", parts[2]])))
    docs += [docs[3], docs[3], ("d0", "a " * 400), (None, None), ("e", "")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.contamination(df, bench).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain_contamination(docs, items), key=key)
    assert len([r for r in got if r.n_near]) > 5 and len([r for r in got if r.n_hit]) > 20
    clean = [r.doc_id for r in got if not r.contaminated]
    assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in decontam.drop_contaminated(df, bench).collect())


def test_proximity_takes_all_terms(spark):
    texts = ["alpha beta x x gamma", "alpha beta " + "x " * 40 + "gamma", "gamma x alpha alpha x beta gamma x alpha", "alpha beta"]
    near = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = decontam.item_words(spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta absent")], "item_id long, text string"))
    index = decontam.build_index(near, items)
    found = decontam.proximity_matches(near, items, index, decontam.term_counts(index), 5).join(items, "ino").join(near.select("doc_id", *decontam._key()), ["did", "h"])
    assert sorted((r.doc_id, r.item_id, r.gap) for r in found.collect()) == [(0, 1, 4), (2, 1, 3)]


def test_bpe_equals_library(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, ref = bpe.load(path), Tokenizer.from_file(path)
    texts = [r.text for r in docs.limit(60).collect()] + ["", " ", "a<|endoftext|> b", "  x \n\n y\t", "aaaaaaaaaaa" * 30, "日本語 🙂 don't I'LL", "\x1c a　b\x85"]
    for t, e in zip(texts, ref.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(t)
        assert ids == e.ids and own.decode(ids) == ref.decode(e.ids, skip_special_tokens=False)
    rows = bpe.encode_and_decode(odd, path).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert bpe.encode_and_decode(odd.limit(0), path).count() == 0


def test_language(spark, odd):
    words = {"en": "the of and that with from", "de": "der die und nicht mit von", "fr": "les des pour avec dans une", "es": "los las por con una para"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(w.split(), 30)), lang) for i, (lang, w) in enumerate(list(words.items()) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, 20).join(df, "doc_id").collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    told = {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()}
    assert told[1] == told[2] == told[6] == "und" and told[3] != "und"
    assert langid.identify(odd.limit(0)).count() == 0


def test_toxicity(spark, odd):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join([*rng.choice(words, 30), *(["insultx"] if bad else [])])))
        labels.append((i, 1, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(df, lab, 200).where("held_out").join(lab, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.98
    assert toxicity.score_documents(odd, lab.limit(0)).where("score is null or score >= 0.5").count() == 0
    assert toxicity.score_documents(odd.limit(0), lab).count() == 0


def test_toxicity_of_pairs():
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts, y = [], []
    for _ in range(2500):  # neither term tells anything alone
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join([*rng.choice(words, 30), *["insult"] * a, *["group"] * b]))
        y.append(float(a == b))
    rows = [np.array(sorted(toxicity.text_buckets(t)), np.int32) for t in texts]
    score = toxicity.FactorizationMachine().fit(rows[:2000], np.array(y[:2000]), 0.5).scorer()(texts[2000:])
    assert np.mean((score >= 0.5) == np.array(y[2000:])) > 0.98


def test_best_cut():
    m, y = np.array([3.0, 2.0, 2.0, 1.0, -1.0]), np.array([1.0, 1.0, 1.0, 0.0, 1.0])
    assert toxicity.best_cut(m, y, 1.0) == -1.5 and toxicity.best_cut(m, y, 5.0) == 1.5


def test_pages(spark):
    page = '<html><head><title>t</title></head><body><nav><ul><li>Home</li></ul></nav><article><h1>Title</h1><p>One &amp; <b>two</b>\n three<p>four<div class="comments"><p>no</div></article><footer>f</footer></body></html>'
    assert sitetree.Page(page).main_text() == "Title\n\nOne & two three\n\nfour"
    rows = [(i, f"http://h.example.org/{i}", f"<body><div class=x>same line</div><div class=y>own text {i}</div><p>more {i}</p></body>") for i in range(12)] + [(None, None, None), (98, "x", ""), (99, "http://h.example.org/", "<p>a<b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitetree.extract(df).collect()}
    assert got[3] == "own text 3\n\nmore 3" and got[None] == got[98] == "" and got[99] == "a<b"
    assert sitetree.extract(df.limit(0)).count() == 0


def test_pages_of_noise_alone_are_empty(spark):
    top = '<div class="top"><p>The Site</p></div>'
    rows = [(i, f"http://h.example.org/{i}", f'<body>{top}<div class="story"><p>Story {i}</p><p>goes on {i * 7}</p></div></body>') for i in range(12)]
    rows += [(50, "http://h.example.org/50", f"<body>{top}</body>"), (51, "http://h.example.org/51", f'<body>{top}<div class="story"></div></body>')]
    got = {r.page_id: (r.text, r.n_chars) for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3][0] == "Story 3\n\ngoes on 21" and got[50] == got[51] == ("", 0)


def test_pages_in_constant_chrome(spark):
    def chrome(body):
        return f'<html><body><div class="top"><p>The Site</p><p>All the news</p></div><div class="wrap">{body}</div><div class="bottom">Contact us</div></body></html>'

    rows = [(i, f"http://h.example.org/{i}", chrome(f"<main><h1>Title {i}</h1><p>Text {i}</p></main>")) for i in range(12)]
    rows += [(i, f"http://g.example.org/{i}", chrome(f'<div class="story">Story {i}</div>')) for i in range(100, 112)]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n\nText {i}" for i in range(12)} | {i: f"Story {i}" for i in range(100, 112)}


def test_pages_with_boilerplate_in_articles(spark):
    def page(text):
        return f'<body><article><h1>Title {text}</h1><p>Text {text}</p><div class="closing"><p>Thank you for reading</p></div></article><p>between</p><article><p>More {text}</p></article></body>'

    own = [(i, f"http://h.example.org/{i}", page(i)) for i in range(12)]
    copies = [(i, f"http://h.example.org/{i}", page("copied")) for i in range(100, 160)]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(own + copies, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {t}\n\nText {t}\n\nMore {t}" for i, t in [*((i, i) for i in range(12)), *((i, "copied") for i in range(100, 160))]}


def test_pages_keep_article_text_whatever_its_class(spark):
    names = ["social-science", "legal-analysis", "section-header", "search-results", "notice-period"]
    body = "".join(f'<div class="{n}"><h2>{n}</h2><p>Text of {n}</p></div>' for n in names)
    rows = [(1, "http://a.example.org/", f"<body><article>{body}</article></body>", 5, 6), (2, "http://b.example.org/", f"<body>{body}</body>", 5, 6)]
    got = sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host long, noisy int")).collect()
    assert {r.text for r in got} == {"\n\n".join(f"{n}\n\nText of {n}" for n in names)}
    whole = " ".join(f"w{i}" for i in range(200_000))
    assert sitetree.Page(f"<article><p>{whole}</p><article><p>a reader's</p></article><section itemprop='comment'>no</section><div role=search>no</div></article>").main_text() == whole


def test_pages_of_small_hosts_learn_from_others(spark):
    def page(i):
        return f'<body><div class="top"><p>Same everywhere</p></div><div class="story"><p>Story {i}</p></div></body>'

    rows = [(10 * h + i, f"http://h{h}.example.org/{i}", page(10 * h + i)) for h in range(8) for i in range(2)]
    df = spark.createDataFrame([*rows, (99, "http://one.example.org/", page(99))], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in sitetree.extract(df).collect()} == {i: f"Story {i}" for i in [*(r[0] for r in rows), 99]}
    assert sitetree.extract(df, 0.0).where("text not like 'Same everywhere%'").count() == 0


def test_importance_against_brute_force(spark, sf_dir):
    from math import log

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", urls.host_of(F.col("url")).alias("host"))
    distinct = sitetree.distinct_pages(pages)
    own = sitetree.own_importance(sitetree.node_statistics(distinct), distinct.groupBy("host").agg(F.count("*").alias("pages")))
    got = {(r.host, r.node): r for r in own.collect()}
    low = {(r.host, r.node): r.importance for r in sitetree.importance(own).collect()}
    by = defaultdict(dict)
    for r in pages.collect():
        page = sitetree.Page(r.html)
        by[r.host].setdefault(tuple(t for main, _, _, t in page.blocks if main or not page.has_main), page.marks())
    want = {}
    for host, found in by.items():
        m, nodes = len(found), defaultdict(lambda: (Counter(), Counter()))
        for marks in found.values():
            for node, side, content, feature in marks:
                nodes[node, side][content][feature] += 1
        for (node, side), (kids, texts) in nodes.items():
            content = np.mean([1 - log(n) / log(m) for n in texts.values()]) if texts and m > 1 else 1.0
            shown = min(1.0, -sum(n / m * log(n / m) / log(m) for n in kids.values())) if m > 1 else 0.0
            want[host, node] = (side, m, (shown + content) / 2 if side == sitetree.BESIDE else max(content, (shown + content) / 2))
    assert set(got) == set(want)
    sums = defaultdict(lambda: [0.0, 0.0])
    for (host, node), (side, m, own) in want.items():
        assert got[host, node].side == side and got[host, node].pages == m and (m == 1 or abs(got[host, node].own - own) < 1e-9)
        sums[node][0] += (m - 1) * own
        sums[node][1] += m - 1
    for (host, node), (side, m, own) in want.items():
        prior = (sums[node][0] + 4 * (side != sitetree.BESIDE)) / (sums[node][1] + 4)
        assert abs(low[host, node] - ((m - 1) * own + 4 * prior) / (m + 3)) < 1e-9


def test_pages_need_the_tree(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    on, off = ({r.page_id: r.text for r in sitetree.extract(pages, t).collect()} for t in (sitetree.THRESHOLD, 0.0))
    html = {r.page_id: r.html for r in pages.collect()}
    article = {i: sitetree.Page(h[h.index("<article>") : h.index("</article>")]).main_text() for i, h in html.items()}
    assert on == article and all(off[i] != on[i] for i in on)


def test_minhash(spark, docs, odd):
    got = {r.doc_id: r for r in minhash.fingerprint_documents(docs).collect()}
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    h = minhash.Hasher()
    for r, nxt in list(zip(rows, rows[1:] + rows[:1]))[:: max(1, len(rows) // 40)]:
        new = minhash.edited(r.text or "", nxt.text or "")
        a, b, c = h.fingerprint(r.text or ""), h.fingerprint(new), h.fingerprint(nxt.text or "")
        mine = got[r.doc_id]
        assert (mine.n_chars, mine.edited_sha256, mine.fingerprint, mine.edited_fingerprint, mine.near_edited, mine.near_next) == (len(r.text or ""), hashlib.sha256(new.encode()).hexdigest(), minhash.as_hex(a), minhash.as_hex(b), minhash.likeness(a, b), minhash.likeness(a, c))
    assert minhash.fingerprint_documents(odd).count() == len(ODD)
    assert minhash.fingerprint_documents(odd.limit(0)).count() == 0
    least = -(1 << 63)
    ids = [7, least, None, None, None, 7, (1 << 63) - 1, 0]
    few = [(i, f"text {n} of a few words that follow each other " + "x" * n) for n, i in enumerate(ids)]
    got = sorted(map(tuple, minhash.fingerprint_documents(spark.createDataFrame(few, "doc_id long, text string")).select("doc_id", "n_chars", "edited_sha256").collect()), key=str)
    order = {r.text: r.h for r in spark.createDataFrame(few, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    few.sort(key=lambda r: (r[0] is None, -(r[0] or 0), order[r[1]]))
    assert got == sorted([(i, len(t), hashlib.sha256(minhash.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(few, few[1:] + few[:1])], key=str)
    pairs = spark.createDataFrame([(1, " ".join(map(str, range(100)))), (2, " ".join(map(str, range(99))) + " x"), (3, "other words that have nothing in common")], "doc_id long, text string")
    assert [(r.a, r.b) for r in minhash.near_duplicate_links(pairs).collect()] == [(1, 2)]


def test_minhash_of_long_texts():
    h = minhash.Hasher()
    words = [[f"{side}{i}" for i in range(100_000)] for side in "ab"]
    mixed = words[0][:50_000] + words[1][50_000:]
    for x, y in ((words[0], words[1]), (words[0], mixed)):
        x, y = h.shingles(" ".join(x)), h.shingles(" ".join(y))
        exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(minhash.likeness(h.signature(x), h.signature(y)) - exact) < 0.15


def test_near_duplicate_links_in_large_buckets(spark):
    core = [f"core{i}" for i in range(400)]
    rows = [(2 * i + j, " ".join(core + [f"pair{i}x{w}" for w in range(14)] + [f"own{i}x{j}x{w}" for w in range(39)])) for i in range(200) for j in (0, 1)]
    h = minhash.Hasher()
    sets = [set(h.shingles(t).tolist()) for _, t in rows]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want == {(2 * i, 2 * i + 1) for i in range(200)}
    assert {(r.a, r.b) for r in minhash.near_duplicate_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_chat_and_urls_odd_rows(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, None, None), (None, 0, "user", "alone"), (4, None, "user", "late")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.format_chats(conv).collect()}
    assert set(got) == {1, None, 4} and got[1][:2] == (2, 2) and got[1][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>\n<|im_end|>\n"
    long = spark.createDataFrame([(c, i + 252, "user", f"t{i}", 0, 0, 0) for c, n in ((1, 9000), (2, 8), (3, 300)) for i in range(n)], "conv_id long, turn long, role string, text string, pos int, h1 int, lone int")
    (got,) = chat.format_chats(long).collect()  # the others begin as this one does
    assert (got.conv_id, got.n_turns, got.text) == (1, 9000, "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(9000)))
    (one,) = chat.format_chats(long.where("conv_id = 2")).collect()
    assert one.n_turns == 8
    assert chat.format_chats(conv.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.org/es/1?x"), (4, "http://x.com/de/2"), (None, "http://bad.net/en/3#q")], "page_id long, url string")
    labels = spark.createDataFrame([(3, 0, 1)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert (rows[3].host, rows[3].path, rows[3].rule, rows[3].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block") and rows[4].verdict == "block" and rows[1].host == rows[2].host == ""
    assert urls.judge(pages.limit(0), labels).count() == 0
    many = spark.createDataFrame([(i, f"http://bad.net/en/{i}") for i in range(50)] + [(i, f"http://good.net/en/{i}") for i in range(50, 100)], "page_id long, url string")
    lab = spark.createDataFrame([(i, int(i >= 50), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    assert {(r.host, r.verdict) for r in urls.judge(many, lab).collect()} == {("bad.net", "block"), ("good.net", "allow")}


def test_domains(spark):
    want = {"www.a.co.uk": ("a.co.uk", "co.uk"), "x.y.github.io": ("y.github.io", "github.io"), "10.0.0.1:80": ("10.0.0.1", "ip"), "u:p@b.h.org:8080": ("h.org", "org"), "localhost": ("localhost", "localhost"), "": ("", ""), "uk": ("uk", "uk"), "co.uk": ("co.uk", "co.uk")}
    got = spark.createDataFrame([(h,) for h in want], "host string").select("host", *(c.alias(n) for n, c in zip("ds", urls.domain_and_suffix(F.col("host"))))).collect()
    assert {r.host: (r.d, r.s) for r in got} == want


def five_words(text):
    """The set of five-word shingles, of all words if they are fewer."""
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(pairs, nodes):
    root = {n: n for n in nodes}
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for n in sorted(nodes):
        root[n] = root[root[n]]
    return root


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    rows, near, far = [], [], []
    for base in range(160):
        text = list(rng.choice(words, 300))
        other = list(text)
        n = (0, 2, 4, 6, 20, 60, 5, 7)[base % 8]
        for at in rng.choice(300, n, replace=False):
            other[at] = f"x{at}"
        rows += [(2 * base, " ".join(text)), (2 * base + 1, " ".join(other).upper() if base % 3 else " ".join(other))]
        (near if jaccard(five_words(rows[-1][1]), five_words(rows[-2][1])) >= 0.8 else far).append(base)
    rows += [(1000, None), (1001, ""), (1002, " \t"), (None, rows[0][1]), (1003, "one"), (1004, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in near) >= 0.97 * len(near) > 70
    assert all(found[2 * i + 1] == 2 * i + 1 for i in far) and all(found[2 * i] == 2 * i for i in range(160))  # none without a verified link
    assert found[None] == 0 and found[1001] == found[1002] == 1000 and found[1003] != found[1004]
    kept = similar.drop_similar(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values())) and kept.columns == docs.columns


def test_similar_tables(spark):
    """Recall and truth of links on the documents of sf0.1, against all pairs that share a rare enough shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.root for r in similar.similar_documents(docs).collect()}
    sets, ids = {}, {}
    for r in docs.orderBy("doc_id").collect():
        s = frozenset(five_words(r.text or ""))
        ids.setdefault(s, []).append(r.doc_id)
    sets = {v[0]: s for s, v in ids.items() if s}
    assert all(len({found[d] for d in v}) == 1 for v in ids.values())  # one set, one class
    count = Counter(g for s in sets.values() for g in s)
    by = defaultdict(list)
    for d, s in sets.items():
        rare = sorted(s, key=lambda g: (count[g], g))
        for g in rare[: len(s) - math.ceil(0.8 * len(s)) + 1]:  # two sets at 0.8 share one of these
            by[g].append(d)
    pairs = {(a, b) for v in by.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    true = {p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8}
    want = classes(true, sets)
    missed = [p for p in true if found[p[0]] != found[p[1]]]
    assert len(true) > 40 and len(missed) <= 0.05 * len(true)
    group = defaultdict(set)
    for d in sets:
        group[found[d]].add(want[d])
    assert all(len(v) == 1 for v in group.values())  # no class joins what verified links do not


def test_blocks_lose_nothing(spark, monkeypatch):
    """Groups in which some pairs hold and others do not, with one pair verified first and blocks of a few texts."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(200)]
        for c in range(40):
            text = list(base)
            for at in rng.choice(200, 1 + c % 3, replace=False):
                text[at] = f"c{c}x{at}"
            rows.append((g * 100 + c, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: five_words(t) for d, t in rows}
    true = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    want = classes(true, sets)
    assert 100 < len(true) < 4 * 40 * 39 / 2 * 0.9
    monkeypatch.setattr(similar, "EDGES", 1)
    for block in (3, 512):
        monkeypatch.setattr(similar, "BLOCK", block)
        found = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
        assert all(want[found[d]] == want[d] for d in sets)
        assert sum(found[a] == found[b] for a, b in true) >= 0.99 * len(true)


def test_links_of_a_block():
    rng = np.random.default_rng(12)
    base = np.sort(rng.integers(0, 2**63, 300, np.uint64))
    sets = [np.sort(np.concatenate([base[: 300 - k], rng.integers(0, 2**63, k, np.uint64)])) for k in rng.integers(0, 60, 60)] + [np.array([5], np.uint64)] * 2
    n = len(sets)
    block = {"code": np.arange(n) * 10, "root": np.r_[np.arange(n - 2), 0, 99], "fine": np.zeros((n, similar.LANES), np.int64), "s": [x.view(np.int64) for x in sets]}
    near = {(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    for side in (np.full(n, 2), np.arange(n) % 2):
        found = {(a // 10, b // 10) for a, b, _ in similar.block_links(block | {"side": side}, 5, 0.8)}
        fits = {(i, j) for i, j in near if side[i] != side[j] or side[i] == 2}
        assert {(max(p), min(p)) for p in found} <= fits
        same = [(0, n - 2)]
        assert classes([*found, *same], range(n)) == classes([*fits, *same], range(n))


def test_masks_of_wide_distances():
    rng = np.random.default_rng(6)
    for n in (10, 10**5, 10**7, 10**9, 10**12):
        masks = [m % 2**64 for m in simhash.block_masks(similar.DISTANCE, n)]
        for _ in range(200):
            x = int(rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
            y = x ^ sum(1 << int(b) for b in {*rng.integers(0, 64, similar.DISTANCE)})
            assert any(x & m == y & m for m in masks)


def test_forest_and_pairs_of_a_node():
    rng = np.random.default_rng(7)
    codes = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 3), np.uint64), axis=1) for c in rng.integers(0, 2**63, 12, np.uint64)]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    fine = rng.integers(0, 4, (len(codes), similar.LANES)).astype(np.uint64)
    close = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= similar.DISTANCE) & (np.bitwise_count(fine[:, None] ^ fine[None, :]).sum(axis=2) <= 1)
    want = {(i, j) for i, j in np.argwhere(close).tolist() if i < j}
    tree = {(int(i), int(j)) for a, b in similar.node_pairs(codes, fine, 1) for i, j in zip(a, b)}
    assert tree <= want and len(tree) < len(codes)
    assert classes(tree, range(len(codes))) == classes(want, range(len(codes)))


def test_fine_limit():
    assert similar.fine_limit(0.8) == 31 and similar.fine_limit(1.0) == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.collect(), docs.schema)
    final = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(final) == {r.doc_id for r in kept.select("doc_id").collect()}
    assert corpus_pipeline.keep_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf_dir).count() == docs.where("text rlike '[a-zA-Z]'").count()
    assert {r.lang for r in corpus_pipeline.keep_languages(spark, docs, sf_dir, ("fr",)).where("n_chars > 500").collect()} == {"fr"}
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tree = langid.train(docs)
    items = [re.findall(decontam.WORD, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    wins = {tuple(x.lower() for x in w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    lower = lambda w: w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    clean, seen = set(), []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if model.scorer()([r.text])[0] >= 0.5:
            continue
        lang, sure = tree.predict(r.text)
        if lang not in corpus_pipeline.LANGUAGES or sure < corpus_pipeline.LEAST_SCORE:
            continue
        own = five_words(r.text)
        if any(jaccard(own, x) >= 0.8 for x in seen):
            continue
        seen.append(own)
        w = [lower(x) for x in re.findall(decontam.WORD, r.text)]
        if not any(tuple(w[i : i + 10]) in wins for i in range(max(1, len(w) - 9))):
            clean.add(r.doc_id)
    assert set(final) == clean
