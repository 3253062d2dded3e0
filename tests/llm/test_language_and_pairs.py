"""Language model, filter audit and hard negatives against brute force, and their defined results for odd rows."""

from __future__ import annotations

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, hard_negatives, maxent, near_dup
from tessera.llm.queries import op11_maxent, op12_filter_audit, op13_hard_negatives

DOC = "doc_id long, text string, source string, n long, part string, row long, word string, key string"


def docs_rows():
    rng = np.random.default_rng(4)
    words = [a + b for a, b in itertools.product(["ka", "LO", "mi", "re"], ["ta", "no", "Su", "ve"])]
    texts = [" ".join(rng.choice(words, rng.integers(1, 400))) for _ in range(60)]
    texts += ["", None, "one\ttwo\x0bthree", "A B C $ d", "Ünï cöde ÄÖ ÄÖ", "x" * 70_000, " ".join(["AB cd"] * 20_000), " ", None]
    texts += texts[:6] + [texts[3]] * 5
    out = [(i, t, [None, "", "s1", "s2"][i % 4], 1, "clash", 7, "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[2], out[2], (None, texts[3], "s1", 1, "", 0, "", ""), (None, texts[3], "s1", 1, "", 0, "", ""),
                  (None, None, None, 1, "", 0, "", "")]


LABELS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 70, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (6, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs_rows(), DOC).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def in_fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


@pytest.mark.parametrize("table", [1 << 18, 5])
def test_base_scores_by_brute_force(spark, folder, monkeypatch, table):
    monkeypatch.setattr(maxent, "TABLE", table)  # 5: nearly all words meet their counts in the join
    count = collections.Counter(w for r in docs_rows() if in_fold(r[0], 7) != 2 for w in tokens(r[1]))
    total, distinct = sum(count.values()), len(count)
    want = []
    for r in docs_rows():
        t = tokens(r[1])
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t)
        want.append((r[0] is None, r[0] or 0, in_fold(r[0], 7) == 2, len(t), sum(w in count for w in t), total, round(base, 4)))
    got = op11_maxent(spark, folder).collect()
    rows = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]
    assert sorted(rows) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(6000)]
    texts = [" ".join(words[int(k)] for k in rng.zipf(1.15, 400) % 6000) for _ in range(60)]
    v = maxent.vocabulary(maxent.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    seen = sorted({x for t in texts for x in t.split()})
    assert v.distinct == len(v.words) == len(seen) + 1 > maxent.HEAD + 200
    model = maxent.Model(v)
    for _ in range(3):
        model.learn(texts)
    for history in ("", "w1", "w1 w2", "never seen"):
        at, total = len(history.split()), 0.0
        for chunk in maxent.stream([f"{history} {w}" for w in [*seen, ""]]):
            first = np.searchsorted(chunk[0], np.unique(chunk[0]))
            total += (10 ** model.log10(chunk)[1][first + at]).sum()
            rows = [r[first[:1] + at] for r in model.features(chunk)[3]]
        power = model.classes.powers(rows, v.class_prior)[0]
        unseen = 10 ** v.tail(np.arange(maxent.TAILS), np.zeros(maxent.TAILS))
        assert total + float((power / power.sum())[maxent.CLASSES:] @ unseen) == pytest.approx(1, abs=1e-4)


def test_layer_gradient_is_that_of_the_softmax():
    rng = np.random.default_rng(0)
    layer = maxent.Layer()
    rows = [rng.integers(0, 40, 500) for _ in range(3)]
    layer.weights[:40] = rng.normal(size=(40, maxent.WIDTH))
    prior, target = np.zeros(maxent.WIDTH, np.float32), rng.integers(0, maxent.WIDTH, 500)
    z = sum(layer.weights[r] for r in rows).astype(float)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(layer.log_share(rows, prior, target), np.log(p[np.arange(500), target]), atol=1e-4)
    p[np.arange(500), target] -= 1
    want = np.zeros((40, maxent.WIDTH))
    for r in rows:
        np.add.at(want, r, p)
    old = layer.weights[:40].copy()
    layer.update(rows, prior, target)
    energy = (want ** 2).sum(axis=1)
    assert np.allclose(layer.seen[:40], energy, rtol=1e-3)
    assert np.allclose(old - layer.weights[:40], maxent.RATE * want / np.sqrt(energy)[:, None], atol=1e-3)


def test_stream_of_long_texts_equals_plain_split(monkeypatch):
    monkeypatch.setattr(maxent, "CHUNK", 50)
    texts = [r[1] for r in docs_rows()[:66]]
    got, numbers = [], []
    for number, h, _, h1, _, h2, _ in maxent.stream(texts):
        got += list(zip(h.tolist(), h1.tolist(), h2.tolist()))
        numbers += number.tolist()
    name = lambda w: maxent.END if w is None else int(maxent.hashed_words(w.encode())[0][0])
    want, at = [], []
    for i, t in enumerate(texts):
        w = [None, None, *tokens(t)]
        want += [(name(w[k]), name(w[k - 1]), name(w[k - 2])) for k in range(2, len(w))]
        at += [i] * (len(w) - 2)
    assert got == want and numbers == at


def test_language_model_of_empty_tables(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    assert maxent.language_model_scores(d.limit(0), F.lit(True)).isEmpty()
    got = maxent.language_model_scores(d.where("doc_id < 5"), F.lit(False)).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in got] == [(0, 0, 0.0)] * 7 and all(math.isfinite(r.score) for r in got)


def brute_audit():
    low = {}
    for r in docs_rows():
        if r[0] is not None:
            low[r[1] or ""] = min(low.get(r[1] or "", r[0]), r[0])
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, t in LABELS if t == 1 and i is not None}
    rows = []
    for r in docs_rows():
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(c for c, f in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search(r"[#$%&*|]", t)), r[0] is not None and r[0] > low[t])) if f)
        rows.append((r[2] or "", fails, r[0] in good, r[0] in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        removed_by = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                c, seen = order[step - 1], order[:step - 1]
                n = collections.Counter()
                for p, fails, g, x in rows:
                    if p != part:
                        continue
                    before, hit = bool(set(seen) & set(fails)), c in fails
                    n["kept"] += not before and not hit
                    n["removed"] += hit and not before
                    n["redundant"] += hit and before
                    n["unique_fails"] += fails == c
                    n["good_lost"] += hit and not before and g
                    n["toxic_lost"] += hit and not before and x
                removed_by[c] += n["removed"]
                out[part, order, step] = [n[m] for m in filter_audit.MEASURES]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def test_audit_by_brute_force(spark, folder):
    got = {(r.part, r.filter_order, r.step): [*(r[m] for m in filter_audit.MEASURES), r.shapley]
           for r in op12_filter_audit(spark, folder).collect()}
    assert got == brute_audit() and len(got) == 3 * 600


def test_audit_of_empty_tables(spark, folder):
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert filter_audit.audit(d.limit(0), labels).isEmpty()
    assert filter_audit.audit(d, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_packed_fields_do_not_overflow():
    most = (1 << 63) - 1
    both = filter_audit.unpacked(most * filter_audit.packed(31, True, True) + filter_audit.packed(0, False, False))
    assert both[0] == (1, most, 0, 0, most, most) and both[4] == (1, 0, most, 0, 0, 0)


VECTORS = "vec_id long, embedding array<float>, label int, score long, lane string, block string"


def vector_rows():
    rng = np.random.default_rng(9)
    out = [(i, [float(x) for x in rng.integers(-6, 7, 4) / 16 + (0.4 if i % 3 else 0)], int(rng.integers(0, 3)), 1, "c", "c") for i in range(0, 700)]
    out += [(701, None, 1, 0, "", ""), (702, [0.1, None, 0.2, 0.3], 1, 0, "", ""), (703, [float("nan"), 0.1, 0.1, 0.1], 1, 0, "", ""),
            (704, [0.5, float("inf"), 0.1, 0.1], 2, 0, "", ""), (705, [0.5, 0.5, 0.5, 0.5], None, 0, "", ""), (800, [], 1, 0, "", ""),
            (706, [0.5, 0.5], 2, 0, "", ""), (None, [0.5, 0.4, 0.3, 0.9], 1, 0, "", ""), (None, [0.4, 0.4, 0.3, 0.9], 2, 0, "", ""),
            (900, [1e30, 0.0, 0.0, 0.0], 2, 0, "", ""), (-100, [0.5, 0.4, 0.3, 0.9], 0, 0, "", ""), (1000, [0.0, 0.0, 0.0, 0.0], 1, 0, "", "")]
    return out + out[:40] + [out[100]] * 30


def brute_negatives():
    rows = set()
    for i, v, label, *_ in vector_rows():
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        q = tuple(max(-(1 << 20), min(1 << 20, math.floor(256 * float(np.float32(x))))) for x in v)
        rows.add((i, label, q + (0,) * (4 - len(q))))
    out = []
    for i, label, q in rows:
        if i is None or i % 100:
            continue
        order = lambda s: sorted(s, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        score = lambda r: sum(a * b for a, b in zip(q, r[2]))
        positives = order({(score(r), r[0]) for r in rows if r[0] != i and r[1] == label})[:5]
        others = order({(score(r), r[0]) for r in rows if r[1] != label})
        for s, p in positives:
            fits = [x for x in others if 30 * s <= 100 * x[0] <= 90 * s][:10]
            out += [(i, p, k, n, s, t) for k, (t, n) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("sizes", [(16_384, 1_024), (37, 3)])
def test_hard_negatives_by_brute_force(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "ROWS", sizes[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[1])
    spark.createDataFrame(vector_rows(), VECTORS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(map(tuple, op13_hard_negatives(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(brute_negatives(), key=key) and len(got) > 100


def test_hard_negatives_of_tables_without_anchors(spark):
    df = spark.createDataFrame(vector_rows(), VECTORS)
    assert hard_negatives.mine(df.limit(0)).isEmpty()
    assert hard_negatives.mine(df.where("vec_id % 100 <> 0")).isEmpty()
    assert hard_negatives.mine(df.where("vec_id = 100")).isEmpty()


def test_packed_keys_sort_by_falling_score_then_id():
    rows = hard_negatives.Block(np.array([-5, 0, 7, 7], np.int64).tobytes(), np.array([0, 0, 0, 1], bool).tobytes(),
                                np.zeros(4, np.int64).tobytes(), 0, b"")
    keys = {}
    for s, kind, at in itertools.product((-(1 << 60), -1, 0, 5, 1 << 60), (0, 1), range(4)):
        keys[hard_negatives._keys(1, 2, np.array([s]), kind, rows, np.array([at]))[0]] = (s, kind, at)
    assert [keys[k] for k in sorted(keys)] == sorted(keys.values(), key=lambda x: (-x[0], x[1], x[2]))
    assert all(hard_negatives.unpack(k)[1:] == (s, kind, [-5, 0, 7, None][at]) for k, (s, kind, at) in keys.items())


def test_updates_follow_the_tokens_not_the_partitions(spark, monkeypatch):
    rows = [(i % 2, f"w{i % 7} w{i % 3} x") for i in range(400)]
    texts = spark.createDataFrame(rows, "deal long, text string").repartition(50)
    v = maxent.vocabulary(maxent.word_counts(texts))
    tasks = []
    summed = maxent.tree_sum
    monkeypatch.setattr(maxent, "tree_sum", lambda parts: tasks.append(parts.getNumPartitions()) or summed(parts))
    monkeypatch.setattr(maxent, "TOKENS_A_TASK", 400)
    maxent.train(texts, v)
    assert v.tokens == 1600 and tasks == [2, 2]


def test_copies_meet_two_hubs_however_many_keys_they_share(spark):
    posts = spark.createDataFrame([(k, i, 30) for k in range(20) for i in range(150)], "key long, node long, n int")
    assert near_dup.star_pairs(posts, near_dup.hub_orders()).count() <= 2 * 150


def test_near_copies_meet_what_they_were_made_from(spark, monkeypatch):
    """Copies that are similar to their original alone: linked with it first, not compared pair by pair."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for c in range(120):
        words = list(base)
        for at in rng.choice(30, 3, replace=False) * 5:
            words[at] = f"edit{c}x{at}"
        texts.append(" ".join(words))
    texts.insert(60, " ".join(base))
    asked, verified = [], near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = near_dup.near_duplicates(df).collect()
    assert {r.component_id for r in got} == {0}
    assert len(asked) == 2 and asked[1] < 121, asked
