"""The numbered operators against brute force, and their defined results for odd rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontaminate, exact_dedup, language, mixing, near_dup, sharding, token_count, url_filter
from tessera.llm import toxicity
from tessera.llm.components import connected_components
from tessera.llm.oracle import LLM_ORACLE
from tessera.llm.queries import op1_sharding, op2_url_filter, op3_mixing, op9_exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard string"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
BASE = " ".join(f"term{i}" for i in range(60))


def rows():
    near = BASE.replace("term59", "other")
    texts = [BASE, BASE.upper(), near, "", None, "one two", "one two", LONG, "Ünï cöde ÄÖ", BASE + " " + LONG[:50]]
    out = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", 0, "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[1], (None, "null id", None, "s1", 0, None, None), (None, BASE, None, "s1", 0, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{d}/documents.parquet")
    bench = [(7, " ".join(BASE.split()[3:20])), (8, "one TWO"), (None, None), (9, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, int(i == 5)) for i in range(9)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def lower_ascii(t):
    return (t or "").encode().lower().decode()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_jump_moves_rows_only_to_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 16, 99):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert a.min() >= 0 and a.max() == n - 1 and set(b[a != b]) <= {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02


def scalar_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_op1_shards_by_the_scalar_jump_hash(spark, folder):
    for r in op1_sharding(spark, folder).collect():
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard) == (scalar_jump(key, 16), scalar_jump(key, 17))


def test_op1_of_an_empty_table(spark, docs):
    assert sharding.with_slots(sharding.assign_shards(docs.limit(0), 16), "shard", F.lit(0).cast("long"), []).isEmpty()


def test_op1_rows_sizes_and_slots(spark, folder):
    got = op1_sharding(spark, folder).toPandas()
    want = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted(zip(got["size"], got.text_crc32)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.groupby(got.doc_id.fillna(-1)).shard.nunique().max() == 1


def test_url_rules_and_aliases(spark):
    page = [
        (1, "https://a.Example.NET/en/x?q#f", None), (2, "http://b.net/x", ""), (3, "http://c.com/y",
         '<link href="http://b.net/x" rel="canonical">'), (4, "http://d.com/z",
         '<meta http-equiv="refresh" content="0; url=//c.com/y">'), (5, "http://e.org/fr/1", ""),
        (6, "http://e.org/other", '<link rel=canonical href="/fr/1">'), (7, None, None), (8, "nothing", ""),
        (9, "http://xnet/", ""), (2, "http://b.net/x", "")]
    df = spark.createDataFrame(page, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("allow", "org/fr/")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect() if r.page_id != 2)
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (3, "c.com", "/y", None, "block"),
        (4, "d.com", "/z", None, "block"), (5, "e.org", "/fr/1", "org/fr/", "allow"),
        (6, "e.org", "/other", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "xnet", "/", None, "allow")]
    assert url_filter.judge(df.limit(0), rules).count() == 0


def judged(spark, pages, rules):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.verdict for r in url_filter.judge(df, rules).collect()}


@pytest.mark.parametrize("page,link,there,alias", [
    ("http://c.com/y", "http://b.net", "http://b.net/", True),  # a home page with and without its slash
    ("http://c.com/d/e/y", "../../x/./z/", "https://c.com/x/z/", True),
    ("http://c.com/d/y", "../../../q", "http://c.com/q", True),
    ("http://c.com/p", "?q=1", "http://c.com/p?q=1", True),
    ("http://c.com", "?q=1", "http://c.com/?q=1", True),
    ("http://c.com/p", "/a?x=1&amp;y=2", "http://c.com/a?x=1&y=2", True),
    ("http://c.com/p#f", "http://C.COM/p2#g", "http://c.com/p2", True),
    ("http://c.com/d/..", "z", "http://c.com/d/z", True),
    ("http://c.com/p", "/a?x=1", "http://c.com/a?x=2", False),
    ("http://c.com/p", "mailto:x@c.com", "http://c.com/x@c.com", False),
    ("http://c.com/p", "#top", "http://c.com/other", False),
])
def test_alias_forms(spark, page, link, there, alias):
    tag = f'<LINK rel="canonical" href="{link}">'
    pages = [(1, page, f'<link rel=icon href="/i">{tag}'), (2, there, None), (3, there, f'<link rel="canonical" href="http://bad.net/x">')]
    got = judged(spark, pages, [("block", "bad.net/")])
    assert got[2] == got[3] == "block" and got[1] == ("block" if alias else "allow")


def test_verdicts_equal_a_recursive_closure(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(12)
    hosts = ["a.net", "b.com", "x.example.net", "c.org", "Example.com"]
    paths = ["", "/", "/p", "/d/q", "/en/a", "/d/../p", "/fr/./1", "/de/z", "/../p"]
    url = lambda: f"http{'s' * int(rng.integers(2))}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '', '?q=1', '#f'])}"
    links = ["../p", "?q=1", "/p", "//b.com", "x/../y", "#x", "mailto:a@b", "/p?a=1&amp;b=2"]
    pages = []
    for i in range(120):
        target = rng.choice([url(), rng.choice(links)])
        tag = [None, "", f'<link rel="canonical" href="{target}">', f"<META http-equiv=refresh content='0; url={target}'>"][int(rng.integers(4))]
        pages.append((i, [url(), url(), url(), "no url", None][int(rng.integers(5))], tag))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(LLM_ORACLE["op2_url_filter"]).fetchall()
    got = [tuple(r) for r in op2_url_filter(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {v for *_, rule, v in got if rule is None} == {"allow", "block"}


def test_all_links_of_a_page_count(spark):
    html = ('<link href="http://one.com/" rel="canonical"><link rel="canonical" href="http://two.com/">'
            '<meta http-equiv="refresh" content="0; url=http://three.com/"><meta content="5;URL=http://four.com/" http-equiv=refresh>')
    pages = [(0, "http://zero.com/", html), *[(i, f"http://{n}.com/", None) for i, n in enumerate(("one", "two", "three", "four"), 1)]]
    for bad in ("one", "two", "three", "four"):
        assert set(judged(spark, pages, [("block", f"{bad}.com/")]).values()) == {"block"}
    got = judged(spark, pages, [("block", "one.com/"), ("allow", "four.com/")])
    assert got == {0: "allow", 1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_very_long_hosts_and_paths(spark):
    host, path = "a." * 500_000 + "net", "/x" * 300_000
    pages = [(1, f"http://{host}/", None), (2, f"http://b.org{path}", None), (3, f"http://b.org{path}/..", None), (4, "http:///p", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(df, [("block", "net/"), ("block", "b.org/x/x/")]).collect()}
    assert got[1].verdict == "block" and got[1].host == host and got[2].verdict == got[3].verdict == "block"
    assert got[2].path == path and (got[4].host, got[4].path, got[4].verdict) == ("", "/p", "allow")


def test_ties_of_rules_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://x.example.net/en/a", "", "kept", "kept", "gone")] * 2,
                               "page_id long, url string, html string, class string, _url string, rule string")
    # Equally long rules of one url: allow goes first. The longer rule wins whatever it says.
    got = url_filter.judge(df, [("block", "example.net/en/"), ("allow", "x.example.net/e"), ("block", "net/")]).collect()
    assert [(r.rule, r.verdict, r["class"], r["_url"]) for r in got] == [("x.example.net/e", "allow", "kept", "kept")] * 2
    assert [r.verdict for r in url_filter.judge(df, []).collect()] == ["allow", "allow"]


def test_mix_hits_targets(spark, folder):
    got = op3_mixing(spark, folder).toPandas()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows())
    assert sorted(got["size"]) == sizes and (got.taken <= 3 * got["size"]).all()
    for target, g in got.groupby("target"):
        assert abs(g.taken.sum() - target) <= 2 + 2 * sum(sizes) / 2 ** 14
    again = op3_mixing(spark, folder).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_mix_takes_what_the_schedule_holds(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 500)
    whole = mixing.taken_words(docs).toPandas().taken.sum()
    full = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda goals: full(goals).where("slot % 2 = 0"))
    half = mixing.taken_words(docs).toPandas().taken.sum()
    assert 0.4 * whole < half < 0.6 * whole
    assert mixing.taken_words(docs.limit(0)).isEmpty()


def test_blocks_of_a_mix_hold_equal_words(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod("id", F.lit(3))).alias("source"),
                                  F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    got = mixing.mix(df).groupBy("slot", "g").agg(F.sum(F.expr("to_word - from_word")).alias("n")).toPandas()
    assert got.slot.nunique() == 128 and (got.groupby("g").n.max() - got.groupby("g").n.min() <= 1).all()
    assert got.n.max() - got.n.min() <= 0.1 * got.n.mean() and got.n.min() >= 512 * 0.95


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 90)], "g string, source_size long")
    got = {r.g: r.target for r in mixing.targets(sizes).collect()}
    assert got["0a"] == 30 and got["0c"] == 270 and got["0b"] == pytest.approx(800)


def test_stream_spans_sum_to_taken(spark, docs):
    stream = mixing.mix(docs).toPandas()
    taken = mixing.taken_words(docs).toPandas()
    assert (stream.to_word - stream.from_word).sum() == taken.taken.sum()
    assert mixing.mix(docs.limit(0)).isEmpty()


def test_tiny_sources_beside_large_ones_get_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 1500)  # 32 slots of about 2,000 words
    sizes = {"a": [5000] * 4, "b": [3, 4], "c": [1], "d": [9000, 1000], "e": [200] * 3, "f": [30_000], "h": [0, 2]}
    data = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate((s, n) for s, v in sizes.items() for n in v)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    taken = mixing.taken_words(df).toPandas()
    by = taken.groupby("g").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() < 1).all() and by.taken.sum() == by["size"].sum()
    assert (taken.taken <= 3 * taken["size"]).all() and by.taken["0b"] == 21 and by.taken["0c"] == 3
    stream = mixing.mix(df).toPandas()
    stream["n"] = stream.to_word - stream.from_word
    assert (stream.n > 0).all() and stream.slot.between(0, 31).all()
    assert stream.groupby("id").n.sum().to_dict() == taken[taken.taken > 0].set_index("id").taken.to_dict()
    once = stream.sort_values(["id", "pass", "from_word"]).groupby(["id", "pass"])
    for _, g in once:  # no word of a pass twice
        assert (g.from_word.to_numpy()[1:] == g.to_word.to_numpy()[:-1]).all()
    halves = stream[stream.g == "0f"].groupby(stream.slot // 16).n.sum()
    assert halves.max() - halves.min() <= 2 * by.taken["0f"] / stream[stream.g == "0f"].slot.nunique()


def test_goals_of_many_small_sources_sum_to_all_words(spark):
    sizes = spark.createDataFrame([(f"0{i:04}", 1) for i in range(800)], "g string, source_size long")
    got = mixing.targets(sizes).toPandas()
    assert got.goal.sum() == 800 and ((got.goal - got.target).abs() < 1).all()


def test_views_of_a_dialogue(spark):
    t = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, None, None), (None, 1, "ann", "x")]
    v = chat.perspectives(spark.createDataFrame(t, "conv_id long, turn long, role string, text string"))
    got = {(r.conv, r.view): r for r in chat.rendered(v).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    bob = got[1, "bob"]
    assert bob.text == ("<|im_start|>system\nS<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n"
                        "<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n")
    assert [bob.text[s:e] for s, e in bob.masked] == ["<|im_start|>assistant\nyo<|im_end|>\n"]


def test_toxicity_learns_and_scores_every_row(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a, b in itertools.product(["ka", "lo", "mi", "re"], ["ta", "no", "su", "ve"])]
    data = [(i, " ".join(rng.choice(words, 30)) + (" vile scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    data += [(1000, None, None), (1001, "", 0), (None, "scum", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    fold = toxicity.in_fold(F.col("doc_id"), 5)
    model = toxicity.fit(df.drop("toxic"), df.drop("text"), fold != 0)
    got = df.select("toxic", (fold == 0).alias("held"), toxicity.score(model, F.col("text")).alias("s")).toPandas()
    assert got.s.between(0, 1).all()
    held = got[got.held & got.toxic.notna()]
    assert ((held.s >= 0.5) == (held.toxic == 1)).mean() > 0.95
    none = toxicity.fit(df.select("doc_id", "text").limit(0), df.drop("text").limit(0), fold != 0)
    assert 0 <= none.score("x") <= 1


def test_toxicity_of_texts_of_several_megabytes(spark):
    rng = np.random.default_rng(5)
    parts = ["".join(x) for x in itertools.product("bdfgklmnprstvz", "aeiou")]
    prose = lambda n: " ".join("".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(n))
    bad = ["vile scum", "utter filth"]
    data = [(i, prose(rng.integers(200, 900)) + (f" {bad[i // 4 % 2]} " + prose(40) if i % 4 == 0 else ""), int(i % 4 == 0))
            for i in range(480)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"), F.lit(True))
    clean = " ".join(prose(300) for _ in range(1200))
    assert len(clean) > 2_000_000 and model.score(clean) < 0.5 and model.score(prose(50)) < 0.5
    for at in (0, len(clean) // 3, len(clean)):  # one toxic passage anywhere
        assert model.score(f"{clean[:at]} {prose(20)} vile scum {prose(20)} {clean[at:]}") >= 0.5


def test_toxicity_windows_see_every_kept_ngram_and_no_other():
    text = "".join(np.random.default_rng(6).choice(list("abcdefgh é"), 100_000))
    raw = toxicity.raw_bytes(text).tobytes()
    name = lambda g: int.from_bytes(bytes([len(g)]) + g, "big")
    kept = sorted({raw[i:i + n] for i in range(0, len(raw) - 5, 997) for n in toxicity.NGRAMS} | {b"zzz", b"xyzzy"})
    vocabulary = toxicity.Vocabulary(np.array([name(g) for g in kept]))
    windows = [set(w.tolist()) for w in vocabulary.windows(text)]
    assert len(windows) == -(-len(raw) // toxicity.HALF) - 1
    for k, got in enumerate(windows):
        part = raw[k * toxicity.HALF:(k + 2) * toxicity.HALF + 4]
        assert got == {j for j, g in enumerate(kept) if -1 < part.find(g) < 2 * toxicity.HALF}
    assert [len(list(vocabulary.windows(t))) for t in ("a", "a" * toxicity.HALF, "a" * 3 * toxicity.HALF)] == [1, 1, 3]


def brute_contamination(texts, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for d, t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def test_contamination(spark, docs):
    items = [(7, " ".join(BASE.split()[3:20])), (8, "one TWO"), (9, "two"), (10, None), (11, "ÜNÏ"), (12, "a a a a a a a a a a a")]
    extra = docs.select("doc_id", "text").union(spark.createDataFrame([(50, "a " * 30)], "doc_id long, text string"))
    got = decontaminate.contamination(extra, spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = brute_contamination([(r[0], r[1]) for r in rows()] + [(50, "a " * 30)], items)
    assert sorted([(r.id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=key) == sorted(want, key=key)
    none = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").isEmpty() and none.count() == len(rows())


def shingled(t):
    w = lower_ascii(t).split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute_groups(texts):
    sets = [shingled(t) for _, t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            group = [group[j] if g == group[i] else g for g in group]
    low = {}
    for g, (d, _) in zip(group, texts):
        low[g] = min([x for x in (low.get(g), d) if x is not None], default=None)
    return [(d, len(s), low[g]) for (d, _), s, g in zip(texts, sets, group)]


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(3)
    texts = [(r[0], r[1]) for r in rows()]
    for f in range(3):  # families around the threshold; crowded keys take the shingle join
        base = [f"f{f}w{i}" for i in range(90)]
        for k in range(25):
            w = list(base)
            for at in rng.choice(90, rng.integers(0, 7), replace=False):
                w[at] = f"x{rng.integers(1e9)}"
            texts.append((100 + 30 * f + k, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute_groups(texts), key=key)
    assert near_dup.near_duplicates(docs.limit(0)).isEmpty()


def test_language(spark):
    en, de = "the cat sat on the mat and then it ran ", "der hund lief durch den wald und schlief "
    data = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(40)]
    data += [(100, None, None), (101, "123 !", "en"), (102, "", None), (103, en * 400, None), (None, "der wald", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    fold = toxicity.in_fold(F.col("doc_id"), 4)
    got = {r.doc_id: r for r in language.identify(df, fold != 2).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert {r.lang_pred for r in language.identify(df, F.lit(False)).collect()} == {"und"}


def test_automaton_phrases():
    def brute(text, train):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i:j + 1] in train:
                j += 1
            n, i = n + 1, j
        return n

    rng = np.random.default_rng(1)
    train = bytes(rng.choice(list(b"abc"), 300).tolist())
    # Long texts run over many blocks; copies of the training text make phrases longer than a block.
    texts = [bytes(rng.choice(list(b"abcz"), n).tolist()) for n in (1, 7, 400, 511, 512, 513, 1024, 5000)]
    texts += [train * 9, train[7:] + train * 5 + b"zz" + train, b"z" * 2000, b"a" * 3000]
    for t in (train, train * 8 + b"ab"):
        got = language.cross_parse(texts, (("x", t),))[:, 0] * [len(x) for x in texts]
        assert got.round().astype(int).tolist() == [brute(x, t) for x in texts]


def test_shares_of_a_budget():
    assert language.shares([10, 10_000, 3, 10_000], 1013) == [10, 500, 3, 500]
    assert language.shares([5, 6], 100) == [5, 6] and language.shares([], 9) == []


def test_language_of_few_texts_and_other_scripts(spark):
    ru, el = "быстрая лиса прыгает через ленивую собаку ", "η γρήγορη αλεπού πηδάει πάνω από το σκυλί "
    data = [(1, ru * 3000, "ru"), (2, el, "el"), (3, "", "el"), (4, None, "ru")] + [(i, "the quick fox jumps over it ", "en") for i in range(10, 90)]
    df = spark.createDataFrame([*data, data[0], (5, ru[5:30], None), (6, el[4:30], None), (7, "quick fox", None)],
                               "doc_id long, text string, lang string").withColumn("_g", F.lit(1)).withColumn("score", F.lit("clash"))
    sizes = {lang: len(t) for lang, t in language.training_text(df, "doc_id", "text", "lang", F.lit(True))}
    assert sizes["ru"] > 0.9 * language.BUDGET and 60 < sizes["el"] < 100 and sizes["en"] < 48 * 30
    got = language.identify(df, F.lit(True))
    assert got.columns == [*df.columns, "lang_pred"]
    by = {r.doc_id: r.lang_pred for r in got.collect()}
    assert (by[5], by[6], by[7], by[3], by[4]) == ("ru", "el", "en", "und", "und")
    assert language.identify(df.limit(0), F.lit(True)).isEmpty()


def test_exact_duplicates(spark, folder):
    got = op9_exact_dedup(spark, folder).toPandas()
    by = {}
    for r in rows():
        by.setdefault(lower_ascii(r[1]), []).append(r[0])
    assert len(got) == len(rows())
    for text, ids in by.items():
        g = got[got.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        best = max([i for i in ids if i is not None], default=None)
        assert (g.group_size == len(ids)).all() and len(g) == len(ids)
        assert g.keep_id.isna().all() if best is None else (g.keep_id == best).all()


def test_exact_duplicates_of_empty_and_hot_tables(spark, docs):
    assert exact_dedup.duplicate_groups(docs.limit(0)).isEmpty()
    hot = spark.range(3000).repartition(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "Same").otherwise(
        F.col("id").cast("string")).alias("text"))
    got = exact_dedup.duplicate_groups(hot)
    assert got.where("kept").count() == 1001 and got.agg(F.max("group_size")).first()[0] == 2000


def test_token_counts_by_brute_force(spark):
    tokens = (b" ", b"a", b"b", b"c", b"ab", b"abc", b"bca", b" ab", b" abca", b"cab", b"\xc3", b"\xbc")

    def brute(w):
        n = 0
        while w:
            w = w[max(len(t) for t in tokens if w.startswith(t)):]
            n += 1
        return n

    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcü"), rng.integers(1, 12))) for _ in range(50)) for _ in range(5)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string")
    got = [tuple(r.c) for r in df.select(token_count.token_counts(F.col("text"), tokens).alias("c")).collect()]
    assert got == [(len(t.split()), sum(brute(b" " + w.encode()) for w in t.split())) for t in texts] + [(0, 0), (0, 0)]
    assert token_count.LongestMatch(tokens).count(b"az") == 1


def test_pipeline_keeps_one_of_repeated_rows(spark, folder):
    data = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 2), (1, "another text", "en", "s", 3),
            (2, "", "en", "s", 4), (2, "", "en", None, 5), (None, None, None, None, 6), (None, None, None, None, 6), (3, LONG, "en", "s", 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, folder).collect()]
    assert sorted(map(str, got)) == sorted(map(str, {(d, t) for d, t, *_ in data}))


def test_pipeline_shards_alone(spark, folder, docs):
    got = corpus_pipeline.shard(spark, docs, folder).toPandas()
    assert len(got) == len(rows()) and got.groupby(got.doc_id.fillna(-1)).shard.nunique().max() == 1
    assert "grown_shard" not in got and got.shard.between(0, 15).all()


def test_pipeline(spark, folder, docs):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, folder)
        assert d.columns == docs.columns, name
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert set(out.columns) == set(docs.columns) and not {1, 2, 6} & set(out.doc_id.dropna().astype(int))
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.isEmpty()
