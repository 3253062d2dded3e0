"""Rule detectors: e-mail words, phone numbers in the full text, and token-span search.

Every detector emits the prediction schema ``(document, token, label, token_str, score)``
with ``score = 1.0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (EMAIL_PATTERN, PHONE_PATTERN_EXTENDED, WORD_PATTERN, full_match,
                              match_word)

PRED_COLS = ("document", "token", "label", "token_str", "score")


def detect_emails(words: DataFrame) -> DataFrame:
    """Words that are wholly an e-mail address -> ``B-EMAIL``."""
    return words.where(F.col("word").contains("@") & full_match(F.col("word"), EMAIL_PATTERN)).select(
        "document",
        "token",
        F.lit("B-EMAIL").alias("label"),
        F.col("word").alias("token_str"),
        F.lit(1.0).alias("score"),
    )


def has_phone(text: Column, pattern: str = PHONE_PATTERN_EXTENDED) -> Column:
    """Whether :func:`phone_targets` finds anything in a text."""
    return text.rlike(pattern)


def phone_words(text: Column, pattern: str = PHONE_PATTERN_EXTENDED) -> Column:
    """The hits of :func:`phone_targets` in a text as arrays of words."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda hit: F.regexp_extract_all(hit, F.lit(WORD_PATTERN), F.lit(0)))
    return F.transform(hits, lambda matches: F.transform(matches, match_word))


def phone_targets(docs: DataFrame, text_col: str = "text",
                  pattern: str = PHONE_PATTERN_EXTENDED,
                  last_match_only: bool = False) -> DataFrame:
    """Every regex hit in the text, re-tokenised into target words.

    Rows ``(document, hit, k, target_word, target_len)``: word ``k`` of hit number ``hit``.
    ``last_match_only`` keeps only each document's last hit (the exact legacy behaviour).
    """
    hits = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
    per_doc = docs.select("document", hits.alias("_hits")).where(F.size("_hits") > 0)
    if last_match_only:
        per_doc = per_doc.select("document", F.array(F.element_at("_hits", -1)).alias("_hits"))
    per_hit = per_doc.select("document", F.posexplode("_hits").alias("hit", "_hit"))
    target = F.regexp_extract_all(F.col("_hit"), F.lit(WORD_PATTERN), F.lit(0))
    return per_hit.select(
        "document", "hit", F.size(target).alias("target_len"),
        F.posexplode(target).alias("k", "_m"),
    ).select(
        "document",
        F.col("hit").cast("int").alias("hit"),
        F.col("k").cast("int").alias("k"),
        match_word(F.col("_m")).alias("target_word"),
        F.col("target_len").cast("int").alias("target_len"),
    )


def _word_hash(word: Column) -> Column:
    """31 bits of a word's hash: sums over a document fit a long."""
    return F.xxhash64(word).bitwiseAND(F.lit((1 << 31) - 1))


def find_spans(words: DataFrame, targets: DataFrame) -> DataFrame:
    """All occurrences of each target word sequence among a document's words.

    Exact search, overlapping matches included, by a rolling hash. Running sums over a document's word
    hashes, plain and weighted by position, give the hash of any run of words from its two ends:
    ``sum(h)`` and ``sum(k * (h mod 2**15))``. A word equal to a target's first word opens one run for each
    length that targets beginning with it have; the run's end is looked up by position, its hash is
    joined to the target hashes, and what is found is verified word by word. Every step is a row operation,
    window or equi-join within the layout by document: no array of words or n-grams is built, and no word is
    paired with every target. ``token`` must count a document's words from 0 without gaps. Returns
    ``(document, start, end)``.
    """
    low = lambda h: h.bitwiseAND(F.lit((1 << 15) - 1))
    t = targets.withColumn("_h", _word_hash(F.col("target_word")))
    hashed = t.groupBy("document", "hit", "target_len").agg(
        F.max(F.when(F.col("k") == 0, F.col("_h"))).alias("_first"), F.sum("_h").alias("_sum"),
        F.sum(F.col("k") * low(F.col("_h"))).alias("_weighted"))
    openings = hashed.select("document", "_first", "target_len").distinct()
    asked = words.select("document", "token", "word").join(targets.select("document").distinct(), "document", "left_semi")
    h, at = F.col("_h"), F.col("token").cast("long")
    running = Window.partitionBy("document").orderBy("token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = asked.withColumn("_h", _word_hash(F.col("word"))).select(
        "document", "token", "_h", F.sum(h).over(running).alias("_sum"), F.sum(low(h)).over(running).alias("_low"),
        F.sum(at * low(h)).over(running).alias("_weighted"))
    starts = sums.join(openings.withColumnRenamed("_first", "_h"), ["document", "_h"]).select(
        "document", F.col("_h").alias("_first"), "target_len", F.col("token").alias("start"),
        (F.col("token") + F.col("target_len") - 1).alias("token"), (F.col("_sum") - h).alias("_sum0"),
        (F.col("_low") - low(h)).alias("_low0"), (F.col("_weighted") - at * low(h)).alias("_weighted0"))
    runs = starts.join(sums.select("document", "token", "_sum", "_low", "_weighted"), ["document", "token"]).select(
        "document", "_first", "target_len", "start", (F.col("_sum") - F.col("_sum0")).alias("_sum"),
        (F.col("_weighted") - F.col("_weighted0") - F.col("start") * (F.col("_low") - F.col("_low0"))).alias("_weighted"))
    found = runs.join(hashed, ["document", "_first", "target_len", "_sum", "_weighted"]).select(
        "document", "hit", "start", "target_len")
    spelled = found.join(targets.select("document", "hit", "k", "target_word"), ["document", "hit"]).select(
        "document", "hit", "start", "target_len", "target_word", (F.col("start") + F.col("k")).alias("token"))
    same = spelled.join(asked, ["document", "token"]).where(F.col("word") == F.col("target_word"))
    spans = same.groupBy("document", "hit", "start", "target_len").agg(F.count(F.lit(1)).alias("_same")).where("_same = target_len")
    return spans.select("document", F.col("start").cast("int").alias("start"),
                        (F.col("start") + F.col("target_len") - 1).cast("int").alias("end")).distinct()


def span_word_labels(spans: DataFrame, words: DataFrame, entity: str) -> DataFrame:
    """Words covered by spans -> ``B-``/``I-<entity>`` rows, one per word (``B-`` wins)."""
    covered = spans.select(
        "document", "start", F.explode(F.sequence("start", "end")).alias("token")
    ).select(
        "document", F.col("token").cast("int").alias("token"),
        F.when(F.col("token") == F.col("start"), F.lit(f"B-{entity}"))
        .otherwise(F.lit(f"I-{entity}")).alias("label"),
    )
    one = covered.groupBy("document", "token").agg(F.min("label").alias("label"))
    # Only the words of documents that have a span: the semi-join goes below the tokeniser.
    asked = words.join(spans.select("document").distinct(), "document", "left_semi")
    return one.join(asked.select("document", "token", F.col("word").alias("token_str")),
                    ["document", "token"], "inner").select(
        "document", "token", "label", "token_str", F.lit(1.0).alias("score"))


def detect_phones(docs: DataFrame, words: DataFrame, text_col: str = "text",
                  pattern: str = PHONE_PATTERN_EXTENDED, last_match_only: bool = False,
                  greedy: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """Phone numbers: regex hits in the full text, located as word spans.

    Default: all hits, all occurrences (true search). ``last_match_only`` / ``greedy`` give
    the legacy behaviour (only the last hit's spans; span search without backtracking). ``targets``: the
    :func:`phone_targets` of these documents, if they are at hand (a cache).
    """
    if targets is None:
        targets = phone_targets(docs, text_col, pattern, last_match_only)
    if greedy:
        spans = greedy_spans(words, targets)
    else:
        spans = find_spans(words, targets)
    return span_word_labels(spans, words, "PHONE_NUM")


def greedy_spans(words: DataFrame, targets: DataFrame) -> DataFrame:
    """Span search without backtracking, over the document's word array.

    A left-to-right scan: on a mismatch the position counter resets and the current word is
    not retried as a start, so ``[a, a, b]`` does not contain ``[a, b]``.
    """
    target_arrays = targets.groupBy("document", "hit").agg(
        F.array_sort(F.collect_list(F.struct("k", "target_word"))).alias("_t")
    ).select("document", "hit", F.transform("_t", lambda s: s["target_word"]).alias("target"))
    doc_tokens = words.groupBy("document").agg(
        F.array_sort(F.collect_list(F.struct("token", "word"))).alias("_w")
    ).select("document", F.transform("_w", lambda s: s["word"]).alias("tokens"))
    joined = target_arrays.join(doc_tokens, "document")
    return joined.select(
        "document", F.explode(find_span_array(F.col("tokens"), F.col("target"), greedy=True)).alias("_s")
    ).select("document", F.col("_s")[0].alias("start"), F.element_at("_s", -1).alias("end"))


def find_span_array(tokens: Column, target: Column, greedy: bool = False) -> Column:
    """Spans (arrays of positions) of ``target`` inside ``tokens``, as a column expression.

    ``tokens`` and ``target`` must be stored columns (not expressions), since they are read
    inside lambdas. Empty target -> no span.
    """
    n = F.size(tokens)
    m = F.size(target)
    empty = F.array().cast("array<array<int>>")
    if not greedy:
        starts = F.filter(
            F.sequence(F.lit(0), n - m),
            lambda i: (tokens[i] == target[0]) & (F.slice(tokens, i + 1, m) == target),
        )
        found = F.transform(starts, lambda i: F.sequence(i, i + m - 1))
        return F.when((m > 0) & (n >= m), found).otherwise(empty)
    zero = F.struct(
        F.lit(0).alias("idx"),
        F.array().cast("array<int>").alias("span"),
        empty.alias("spans"),
    )

    def step(acc, i):
        hit = tokens[i] == target[acc["idx"]]
        done = acc["idx"] + 1 == m
        return (
            F.when(~hit, F.struct(F.lit(0).alias("idx"), F.array().cast("array<int>").alias("span"),
                                  acc["spans"].alias("spans")))
            .when(done, F.struct(F.lit(0).alias("idx"), F.array().cast("array<int>").alias("span"),
                                 F.array_append(acc["spans"], F.array_append(acc["span"], i)).alias("spans")))
            .otherwise(F.struct((acc["idx"] + 1).alias("idx"), F.array_append(acc["span"], i).alias("span"),
                                acc["spans"].alias("spans")))
        )

    scan = F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda acc: acc["spans"])
    return F.when((m > 0) & (n > 0), scan).otherwise(empty)


def detect_rules(docs: DataFrame, words: DataFrame, text_col: str = "text",
                 pattern: str = PHONE_PATTERN_EXTENDED, last_match_only: bool = False,
                 greedy: bool = False, targets: DataFrame | None = None, phone_words: DataFrame | None = None) -> DataFrame:
    """E-mail and phone rule hits together (bag union, both in the prediction schema). ``phone_words``: those of ``words``
    whose document has a phone hit (:func:`has_phone`), if they are at hand."""
    return detect_emails(words).unionByName(
        detect_phones(docs, words if phone_words is None else phone_words, text_col, pattern, last_match_only, greedy, targets))
