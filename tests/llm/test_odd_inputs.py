"""Empty tables, ties, repeated rows, long texts and clashing names, where the other tests don't have them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, exact_dedup, near_dup, sharding, token_count, toxicity

TURNS = "conv_id long, turn long, role string, text string, view string, mask string, segment string, end string"


def test_dialogues_with_ties_repeats_and_clashing_names(spark):
    rows = [(1, 0, "ann", "b", "x", "x", "x", "x"), (1, 0, "ann", "a", "x", "x", "x", "x"), (1, 0, "bob", "z", "x", "x", "x", "x"),
            (1, 1, "ann", "a", "x", "x", "x", "x"), (1, 1, "ann", "a", "x", "x", "x", "x"), (2, None, "system", "only", "x", "x", "x", "x")]
    views = chat.perspectives(spark.createDataFrame(rows, TURNS))
    got = {(r.conv, r.view): r.text for r in chat.rendered(views).collect()}
    ann = [("assistant", "a"), ("assistant", "b"), ("user name=bob", "z"), ("assistant", "a"), ("assistant", "a")]
    assert set(got) == {(1, "ann"), (1, "bob")}
    assert got[1, "ann"] == "".join(f"<|im_start|>{who}\n{t}<|im_end|>\n" for who, t in ann)
    assert chat.perspectives(spark.createDataFrame([], TURNS)).isEmpty()


def test_long_turns(spark):
    rows = [(1, i, "ann" if i % 2 else "bob", "wörd " * 100_000, "", "", "", "") for i in range(4)]
    views = chat.perspectives(spark.createDataFrame(rows, TURNS)).where("view = 'ann'").orderBy("start").collect()
    assert [r.start for r in views] == [0, *[r.end for r in views[:-1]]] and all(r.end - r.start == len(r.segment) for r in views)


def test_token_counts_of_long_texts_and_clashing_names(spark):
    tokens = (b" ", b"a", b"b", b" ab", b"ab")
    long = "ab " * 400_000 + "a" * 300_000
    df = spark.createDataFrame([(long, 1), ("", 2), (None, 3), ("ab ab", 4)], "text string, c int")
    got = {r.c: tuple(r.n) for r in df.withColumn("n", token_count.token_counts(F.col("text"), tokens)).collect()}
    assert got == {1: (400_001, 400_000 + 300_001), 2: (0, 0), 3: (0, 0), 4: (2, 2)}
    assert df.limit(0).select(token_count.token_counts(F.col("text"), tokens)).isEmpty()


def test_contamination_of_empty_documents(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "two")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), bench).isEmpty()
    assert decontaminate.contamination(docs, bench).first().n_hit == 1


def test_toxicity_with_clashing_names_and_repeated_labels(spark):
    rng = np.random.default_rng(0)
    prose = lambda: " ".join(rng.choice(["kata", "lono", "misu", "reve", "kano"], 40))
    data = [(i, prose() + (" vile scum" if i % 3 == 0 else ""), 1, "clash", 0.5) for i in range(300)]
    docs = spark.createDataFrame([*data, data[0], data[1]], "doc_id long, text string, y int, f string, size double")
    labels = [(i, int(i % 3 == 0), "clash") for i in range(300)]
    labels = spark.createDataFrame([*labels, (0, None, ""), (3, 0, ""), (None, 1, "")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = docs.withColumn("score", toxicity.score(model, F.col("text"))).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got) and len(got) == 302
    assert docs.limit(0).select(toxicity.score(model, F.col("text"))).isEmpty()


def test_shards_are_written_whole(spark, tmp_path):
    df = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text", "cast(id as string) as slot")
    sharding.write_shards(df, f"{tmp_path}/out", 4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {r.doc_id: r.shard for r in sharding.assign_shards(df, 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want and set(want.values()) == {0, 1, 2, 3}


def test_rows_without_their_copies(spark):
    df = spark.createDataFrame([(1, "Same", "x"), (5, "same", "y"), (3, "other", "z"), (None, None, "n")], "doc_id long, text string, id string")
    got = exact_dedup.drop_duplicates(df).collect()
    assert sorted((r.id, r.text) for r in got if r.doc_id is not None) == [("y", "same"), ("z", "other")]


def test_recall_of_pairs_near_the_threshold(spark):
    """Several hundred pairs of one changed run of words, similarity 0.75 to 0.80, and as many below 0.75."""
    data, want = [], set()
    for k in range(400):
        words = [f"p{k}w{i}" for i in range(104)]  # 100 shingles
        changed = list(words)
        width = 8 + k // 2 % 3 if k % 2 else 12  # a run of so many new words changes width + 4 shingles
        changed[40:40 + width] = [f"q{k}x{i}" for i in range(width)]
        gone = width + 4
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        if 100 * (100 - gone) >= 75 * (100 + gone):
            want.add(2 * k)
    got = near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    linked = {r.component_id for r in got if not r.kept}
    assert linked == want and len(want) >= 200
