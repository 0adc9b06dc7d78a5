"""URL cascade, near-duplicates, chats, pages and the pipeline against plain counterparts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.llm import chat_hmm, components, html_tree, minhash, queries, url_filter
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


def test_url_edges(spark, edges):
    got = {r["page_id"]: r for r in queries.op1_url_filter(spark, edges).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("", "", None, "allow")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[4]["host"], got[4]["path"]) == ("a:", "//b/c")
    assert got[5]["verdict"] == "block"
    assert (got[6]["rule"], got[6]["verdict"]) == ("net/de/", "allow")


def listed_by_cascade(spark, cascade, universe):
    h1, h2 = url_filter.hashes(F.col("key"))
    rows = universe.select("key", h1.alias("a"), h2.alias("b")).collect()
    import pyarrow as pa

    got = cascade.has(np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows]), pa.array([r["key"] for r in rows]))
    return {r["key"] for r, hit in zip(rows, got, strict=True) if hit}


def test_cascade_is_exact(spark):
    universe = spark.range(30000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("substr(key, 2) % 5 = 0").unionAll(spark.createDataFrame([("unseen",), (None,), ("",)], "key string"))
    cascade = url_filter.build(universe, listed)
    assert len(cascade.levels) > 1
    want = {f"h{i}" for i in range(0, 30000, 5)}
    assert listed_by_cascade(spark, cascade, universe) == want
    for parts in (2, 7):
        assert {r["key"] for r in url_filter.listed_by_parts(universe, listed, parts).collect()} == want


def test_equal_hashes_end_in_text(spark, monkeypatch):
    # all keys have one of three fingerprints, so no level parts listed from unlisted ones
    monkeypatch.setattr(url_filter, "hashes", lambda k: (F.length(k).cast("bigint"), F.lit(7).cast("bigint")))
    universe = spark.createDataFrame([(k,) for k in ("a", "b", "cc", "dd", "eee")], "key string")
    listed = spark.createDataFrame([("a",), ("dd",), ("zz",)], "key string")
    cascade = url_filter.build(universe, listed)
    assert len(cascade.levels) == url_filter.MAX_LEVELS
    assert cascade.remainder == {"a", "dd"}
    assert listed_by_cascade(spark, cascade, universe) == {"a", "dd"}
    assert {r["key"] for r in url_filter.listed_by_parts(universe, listed, 3, 4).collect()} == {"a", "dd"}


def test_levels_hash_anew():
    r = np.random.default_rng(5)
    h = r.integers(-(1 << 63), 1 << 63, (2, 4000))
    a, b = (url_filter.positions(h[0], h[1], level, 32768) for level in (0, 1))
    same = (a[:, None, 0] == a[None, :400, 0]) & ~np.eye(4000, 400, dtype=bool)
    x, y = np.nonzero(same)
    assert len(x) > 10
    assert (b[x, 0] == b[y, 0]).mean() < 0.2


def test_lists_of_any_length(spark):
    rows = spark.createDataFrame([("a.x.com",), ("x.com",), ("y.com",), ("",)], "host string")
    listed = spark.createDataFrame([("x.com",), ("",), (None,)], "key string")
    for limit in (0, 1 << 20):
        assert {r["host"]: r["listed"] for r in url_filter.is_listed(rows, listed, limit, 1).collect()} == {"a.x.com": True, "x.com": True, "y.com": False, "": False}
    assert not any(r["listed"] for r in url_filter.is_listed(rows, listed.where("key = 'none'")).collect())


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = t.encode().lower().split() if t else []
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def plain_components(ids, sets):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    random.seed(12)
    texts, base = [], [" ".join(random.choice("abcdefghij") + str(random.randrange(30)) for _ in range(40)) for _ in range(4)]
    for _ in range(260):  # edited copies of few texts: many pairs near the limit, chains, equal sets
        words = random.choice(base).split()
        for _ in range(random.randrange(0, 6)):
            words[random.randrange(len(words))] = random.choice("xyz") + str(random.randrange(99))
        texts.append(" ".join(words))
    texts += ["", None, "  \n", "one", "ONE", "one two", "one\x0btwo", "one two one two", "a b c d", "a b c d e"]
    ids = list(range(5, 5 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)
    for k in (2, 5):
        sets = plain_sets(texts, k)
        want = plain_components(ids, sets)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == dict(zip(ids, map(len, sets), strict=True))
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_block_comparison():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 30, 25)).astype(np.uint64) for _ in range(60)]
    component, block = np.arange(60) % 7, np.arange(60) % 2
    a, b = minhash.linked_pairs(sets, component, block, 60)
    want = {
        (i, j) for i in range(60) for j in range(i + 1, 60)
        if component[i] != component[j] and block[i] != block[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
    }
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    assert want


def test_circulant_signature_estimates_similarity():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], r.integers(0, 1 << 63, 100).astype(np.uint64)])
    s = minhash.signatures([np.unique(a), np.unique(b)], 600)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.08
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.scatter32(x))) == len(x)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_deduplicate_keeps_columns(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    assert ids == sorted(map(str, [1, 2, 3, 4, 7, None, None, 8, 10, 11, 12]))


def test_viterbi_is_best_path():
    hmm = chat_hmm.Hmm.fit([(1, 0, "Hi?", "user"), (1, 1, "Well, yes.\nIt is.", "assistant"), (1, 2, "So?", "user"), (2, 0, "Be kind.", "system"), (2, 1, "Hello there", "user")])
    lines = [("Hi?", True), ("User: x", False), ("Yes.", True), ("well", False)]

    def score(path):
        total = 0.0
        for i, (line, first) in enumerate(lines):
            e = hmm.emissions(line, first, i == 0)[path[i]]
            step = hmm.turn if first or chat_hmm.marker(line)[0] else hmm.stay
            total += e + (hmm.start[path[i]] if i == 0 else step[path[i - 1]][path[i]])
        return total

    from itertools import product

    best = max(product(range(3), repeat=4), key=score)
    assert score(hmm.viterbi(lines, None, None)) == pytest.approx(score(best))


def test_markers():
    assert chat_hmm.marker("User: hi") == ("user", 6)
    assert chat_hmm.marker("### Assistant: ok")[0] == "assistant"
    assert chat_hmm.marker("<|im_start|>system")[0] == "system"
    assert chat_hmm.marker("Answering is hard")[0] == ""


def test_one_conversation_over_many_partitions(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    hmm = chat_hmm.fit(rows)
    one = rows.select(F.lit(7).cast("long").alias("conv_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("turn"), "text")
    a, b = ({(r["turn"], r["rendered"]) for r in chat_hmm.parse(one, hmm, n).collect()} for n in (1, 11))
    assert a == b
    assert len(a) > 20


def test_transcript_is_taken_apart(spark):
    rows = spark.createDataFrame([(1, 0, "System: be nice\nUser: hi there\nhow are you?\nAssistant: fine")], "conv_id long, turn long, text string")
    got = chat_hmm.parse(rows, chat_hmm.fit(spark.read.parquet(f"{DATA}/conversations.parquet"))).first()
    assert got["rendered"] == "<|system|>\nbe nice\n<|end|>\n<|user|>\nhi there\nhow are you?\n<|end|>\n<|assistant|>\nfine\n<|end|>\n"


def test_messages_give_exact_marginals():
    model = html_tree.default_model()
    page = html_tree.Page("<body><div class=nav><p>x</p></div><article><p>some words here</p></article></body>")
    forest, unary = html_tree.Forest([page]), model.unary([page])
    p, _ = forest.marginals(unary, model.pair)
    n = len(page.tag)
    weight = np.zeros(n)
    total = 0.0
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        s = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(model.pair[html_tree.kind(page.tag[i]), y[page.parent[i]], y[i]] for i in range(1, n)))
        total += s
        weight += s * np.array(y)
    assert np.allclose(p, weight / total)


def test_held_out_pages():
    model = html_tree.default_model()
    pages = html_tree.labelled_pages(60, seed=77)
    parsed = [html_tree.Page(s) for s, _ in pages]
    p, _ = html_tree.Forest(parsed).marginals(model.unary(parsed), model.pair)
    y = np.array([i in good for q, (_, good) in zip(parsed, pages, strict=True) for i in range(len(q.tag))])
    assert ((p >= 0.5) == y).mean() > 0.98


def test_page_edges(spark, edges):
    got = {r["page_id"]: r for r in queries.op10_html(spark, edges).collect()}
    assert got[1]["text"] == ""
    assert got[4]["text"] == "Of A&B A&B c are some words of a paragraph to read."
    assert got[7]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from backtrail.llm import bpe, decontam, language_id, quality_fm

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    model = quality_fm.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [r for r in rows if model.scores([r[1]])[0] >= 0.5]
    profiles = language_id.fit(spark.createDataFrame(rows, docs.schema))
    rows = [r for r in rows if (x := profiles.identify(r[1]))[0] != "und" and x[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    component = plain_components([r[0] for r in rows], plain_sets([r[1] for r in rows], 5))
    rows = [r for r in rows if component[r[0]] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if not decontam.Matcher(items, decontam.ERROR_RATE).matches(r[1])]
    own = bpe.load(queries.word_bpe_path())
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {r[0]: own.encode(r[1]) for r in rows}
    assert 0 < len(got) < docs.count()
