import random

from pyspark.sql import functions as F

from conftest import docs_df
from tessera.functions.text import PHONE_PATTERN
from tessera.operators import rules
from tessera.operators.rules import detect_emails, detect_phones, find_span_array, find_spans
from tessera.operators.tokens import document_words


def _phones(spark, texts, **kw):
    docs = docs_df(spark, texts)
    words = document_words(docs)
    rows = detect_phones(docs, words, **kw).orderBy("document", "token").collect()
    return [(r.document, r.token, r.label, r.token_str) for r in rows]


def test_reference_phone_formats(spark):
    got = _phones(spark, ["call (555)123-4567 x", "or 555.123.4567 x"], pattern=PHONE_PATTERN)
    assert got == [(0, 1, "B-PHONE_NUM", "("), (0, 2, "I-PHONE_NUM", "555"), (0, 3, "I-PHONE_NUM", ")"),
                   (0, 4, "I-PHONE_NUM", "123-4567"), (1, 1, "B-PHONE_NUM", "555.123.4567")]
    assert len({d for d, *_ in got}) == 2


def test_phone_needs_trailing_whitespace(spark):
    assert _phones(spark, ["555.123.4567"], pattern=PHONE_PATTERN) == []


def test_all_matches_or_last_only(spark):
    text = "a 555.123.4567 b 555.765.4321 c"
    assert len(_phones(spark, [text])) == 2
    last = _phones(spark, [text], last_match_only=True)
    assert [t for *_, t in last] == ["555.765.4321"]


def test_email_full_match_only(spark):
    # A corpus word that is not wholly an address does not match.
    words = spark.createDataFrame([(0, 0, "<a@b.co>"), (0, 1, "a@b.co"), (0, 2, "x@y.org")],
                                  "document long, token int, word string")
    got = [r.token_str for r in detect_emails(words).collect()]
    assert sorted(got) == ["a@b.co", "x@y.org"]
    # In running text the tokeniser splits the brackets off.
    docs = docs_df(spark, ["<a@b.co>"])
    assert [r.token_str for r in detect_emails(document_words(docs)).collect()] == ["a@b.co"]


def test_email_with_final_newline_is_not_a_match(spark):
    words = spark.createDataFrame([(0, 0, "a@b.co\n")], "document long, token int, word string")
    assert detect_emails(words).count() == 0


def _spans(spark, doc, target, greedy):
    df = spark.createDataFrame([(doc, target)], "tokens array<string>, target array<string>")
    return df.select(find_span_array(F.col("tokens"), F.col("target"), greedy).alias("s")).first().s


def test_span_search_backtracking(spark):
    assert _spans(spark, ["a", "a", "b"], ["a", "b"], greedy=False) == [[1, 2]]
    assert _spans(spark, ["a", "a", "b"], ["a", "b"], greedy=True) == []
    assert _spans(spark, ["a", "b", "c", "a", "b"], ["a", "b"], greedy=True) == [[0, 1], [3, 4]]


def test_span_search_overlaps(spark):
    assert _spans(spark, ["a", "a", "a"], ["a", "a"], greedy=True) == [[0, 1]]
    assert _spans(spark, ["a", "a", "a"], ["a", "a"], greedy=False) == [[0, 1], [1, 2]]
    assert _spans(spark, ["a"], [], greedy=False) == []


def test_ngram_join_matches_array_search(spark):
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate(["a", "a", "a", "b", "a", "b"])],
                                  "document long, token int, word string")
    targets = spark.createDataFrame([(0, 0, 0, "a", 2), (0, 0, 1, "a", 2), (0, 1, 0, "a", 2), (0, 1, 1, "b", 2)],
                                    "document long, hit int, k int, target_word string, target_len int")
    got = sorted((r.start, r.end) for r in find_spans(words, targets).collect())
    assert got == [(0, 1), (1, 2), (2, 3), (4, 5)]


def _targets(spark, seqs):
    rows = [(d, h, k, w, len(t)) for d, h, t in seqs for k, w in enumerate(t)]
    return spark.createDataFrame(rows, "document long, hit int, k int, target_word string, target_len int")


def test_span_search_by_brute_force(spark):
    rng = random.Random(5)
    docs = {d: [rng.choice("abc") for _ in range(rng.randint(0, 60))] for d in range(12)}
    seqs = [(d, h, [rng.choice("abc") for _ in range(rng.randint(1, 6))]) for d in range(10) for h in range(6)] + [(77, 0, ["a"])]
    words = spark.createDataFrame([(d, i, w) for d, ws in docs.items() for i, w in enumerate(ws)], "document long, token int, word string")
    want = {(d, i, i + len(t) - 1) for d, _, t in seqs for i in range(len(docs.get(d, [])) - len(t) + 1) if docs[d][i:i + len(t)] == t}
    got = [(r.document, r.start, r.end) for r in find_spans(words, _targets(spark, seqs)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_spans_of_equal_hash_are_told_apart(spark, monkeypatch):
    """With a hash that is the same for every word, the check word by word decides alone."""
    monkeypatch.setattr(rules, "_word_hash", lambda word: F.lit(7).cast("long"))
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate("abcabdabc")], "document long, token int, word string")
    got = find_spans(words, _targets(spark, [(0, 0, list("abc")), (0, 1, list("bd"))]))
    assert sorted((r.start, r.end) for r in got.collect()) == [(0, 2), (4, 5), (6, 8)]


def test_span_search_builds_no_array_of_words(spark):
    """A document of a million words: every step is a row, a window or a join."""
    words = spark.range(1_000_000).selectExpr("0L as document", "cast(id as int) as token", "concat('w', id % 1000) as word")
    seqs = [(0, h, [f"w{(i + h) % 1000}" for i in range(3 + h)]) for h in range(4)] + [(0, 9, ["w5", "w5"])]
    found = find_spans(words, _targets(spark, seqs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "transform(" not in plan and "slice(" not in plan
    assert found.count() == 4 * 1000
