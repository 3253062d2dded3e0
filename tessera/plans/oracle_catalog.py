"""SQL oracle text per query key (DuckDB dialect; see :mod:`tessera.plans.oracle`)."""

from __future__ import annotations

from ..schema import (FOCAL_ALPHA_O, FOCAL_GAMMA, F5_GATE, NUM_LABELS, O_ID, RULE_LABELS, TEST_MAX_PIECES,
                      TRAIN_MAX_PIECES, TRUNCATE_LEFT_WORDS)
from ..functions.text import EMAIL_PATTERN
from .oracle import LABEL_LIST, RUNNING, _decode_ctes, calibrate_sql, decode_sql, q, with_chain

P = ", ".join(f"p{i}" for i in range(NUM_LABELS))
RP = ", ".join(f"round(p{i}, 6) AS p{i}" for i in range(NUM_LABELS))
Z = ", ".join(f"z{i}" for i in range(NUM_LABELS))


def _pos(seed: int, col: str = "document") -> str:
    return f"md5('{seed}:' || CAST({col} AS VARCHAR)), {col}"


CORPORA = [
    ("src", """SELECT doc_id AS document, text,
               CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4 AS corpus FROM documents"""),
    ("c3", """SELECT *, row_number() OVER (ORDER BY document) - 1 AS pos, count(*) OVER () AS n
              FROM src WHERE corpus = 3"""),
    ("loaded_raw", """SELECT document, text, corpus FROM src WHERE corpus < 3
                      UNION ALL SELECT document, text, corpus FROM c3 WHERE pos < n // 10"""),
    ("stats", "SELECT corpus, count(*) AS n, max(document) AS max_id FROM loaded_raw GROUP BY corpus"),
    ("offs", """SELECT corpus, n, max_id, CASE WHEN corpus = 0 THEN 0 ELSE
                  (SELECT max_id + 1 FROM stats WHERE corpus = 0)
                  + coalesce(sum(CASE WHEN corpus > 0 THEN n END) OVER (ORDER BY corpus
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS "offset"
                FROM stats"""),
    ("renum", """SELECT l.corpus, l.document AS source_document, l.text,
                   CAST(CASE WHEN l.corpus = 0 THEN l.document
                        ELSE o."offset" + row_number() OVER (PARTITION BY l.corpus ORDER BY l.document) - 1 END
                        AS BIGINT) AS document
                 FROM loaded_raw l JOIN offs o ON o.corpus = l.corpus"""),
]
# The same chain over all rows of the four corpora.
WHOLE_CORPORA = [(n, "SELECT document, text, corpus FROM src" if n == "loaded_raw" else sql)
                 for n, sql in CORPORA if n != "c3"]

SPLITS = [
    ("all_docs", "SELECT doc_id AS document FROM documents"),
    ("outer_f", f"""SELECT document, ntile({10}) OVER (ORDER BY {_pos(77)}) - 1 AS fold FROM all_docs"""),
    ("inner_f", f"""SELECT document, ntile({10}) OVER (ORDER BY {_pos(42)}) - 1 AS fold
                    FROM outer_f WHERE fold <> 9"""),
    ("test_fold", f"""SELECT document FROM (SELECT document, ntile(5) OVER (ORDER BY {_pos(42)}) - 1 AS fold
                      FROM all_docs) WHERE fold = 2"""),
]

COUNTS = """SELECT document, CAST(count(*) AS INTEGER) AS n_words,
                   CAST(count(*) FILTER (WHERE label <> 'O') AS INTEGER) AS target_num,
                   CASE WHEN count(*) FILTER (WHERE label <> 'O') > 0 THEN 1 ELSE 0 END AS "group"
            FROM {src} GROUP BY document"""

PIECE_LABELS = [
    ("pl_words", """SELECT *, lead(label) OVER (PARTITION BY document ORDER BY token) AS next_label FROM silver"""),
    ("pl_real", """SELECT p.document, p.piece, p.start, w.char_end, w.blank, w.trailing_whitespace, w.label, w.next_label
                   FROM (SELECT * FROM pieces WHERE start + "end" > 0) p
                   ASOF JOIN pl_words w ON p.document = w.document AND p.start >= w.char_start"""),
    ("piece_labels", """SELECT document, piece, CASE
                          WHEN start < char_end AND NOT blank THEN label
                          WHEN start < char_end AND start + 1 < char_end THEN label
                          WHEN start < char_end AND trailing_whitespace THEN 'O'
                          ELSE coalesce(next_label, 'O') END AS label FROM pl_real
                        UNION ALL SELECT document, piece, 'O' FROM pieces WHERE start + "end" = 0"""),
]

def _member_sql(m: str, key: str) -> list[tuple[str, str]]:
    """Probabilities of one ensemble member as a list per piece."""
    z = ", ".join(f"CAST(('0x' || substr({m}h, {2 * i + 1}, 2)) AS INTEGER) / 32.0 + CASE WHEN y = {i} THEN 4.0 ELSE 0.0 END"
                  + (" + 2.0" if i == O_ID else "") for i in range(NUM_LABELS))
    return [(f"{m}z", f"SELECT document, piece, [{z}] AS z FROM (SELECT document, piece, md5({key}) AS {m}h, y FROM py)"),
            (f"{m}e", f"SELECT document, piece, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM {m}z"),
            (f"{m}p", f"SELECT document, piece, e, list_sum(e) AS s FROM {m}e")]


GATE = _decode_ctes(1)
#: The gate's word predictions at threshold 0.25 alone: no grid, no repeated chain.
GATE_025 = [
    ("pick1", f"""SELECT document, token, token_str, piece, CASE WHEN p_o < 0.25 THEN l_no ELSE l_all END AS lid,
                    CASE WHEN p_o < 0.25 THEN p_no ELSE p_all END AS score FROM
                    (SELECT document, token, token_str, piece, l_all, l_no, p_o, greatest({", ".join(f"p{i}" for i in range(NUM_LABELS))}) AS p_all,
                       greatest({", ".join(f"p{i}" for i in range(NUM_LABELS) if i != O_ID)}) AS p_no FROM aligned)"""),
    ("word1", f"""SELECT document, token, arg_min(token_str, piece) AS token_str, {LABEL_LIST}[arg_min(lid, piece) + 1] AS raw_label,
                    arg_min(score, piece) AS score FROM pick1 WHERE lid <> {O_ID} GROUP BY document, token"""),
    ("cont1", """SELECT *, COALESCE(lag(token) OVER d = token - 1 AND substr(lag(raw_label) OVER d, 3) = substr(raw_label, 3), false) AS cont
                 FROM word1 WINDOW d AS (PARTITION BY document ORDER BY token)"""),
    ("aligned_rp", """SELECT r.document, r.token, r.word AS token_value, r.label AS label_real,
                        CASE WHEN p.raw_label IS NULL THEN 'O' WHEN substr(p.raw_label, 1, 1) = 'I' AND NOT p.cont
                             THEN 'B-' || substr(p.raw_label, 3) ELSE p.raw_label END AS label_pred,
                        p.token_str, round(p.score, 6) AS score
                      FROM silver r LEFT JOIN cont1 p ON r.document = p.document AND r.token = p.token"""),
]
GATE_RULES = _decode_ctes(1, RULE_LABELS, rules=True)


def _metrics_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}tp, n_pred, n_true, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(CASE WHEN 25.0 * precision + recall > 0 THEN 26.0 * precision * recall / (25.0 * precision + recall) END, 6) AS f5
               FROM (SELECT {k}tp, n_pred, n_true,
                       CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                       CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall FROM {src})"""


PRED025 = "SELECT document, token, label, token_str, score FROM preds WHERE threshold = 0.25"

ENT = GATE + [
    ("p025", PRED025),
    ("pe", """SELECT document, entity_type, start, "end" FROM pred_ents WHERE threshold = 0.25"""),
    ("em", """SELECT coalesce(p.document, t.document) AS document, coalesce(p.entity_type, t.entity_type) AS entity_type,
                     coalesce(p.start, t.start) AS start, coalesce(p."end", t."end") AS "end",
                     p.document IS NOT NULL AS is_pred, t.document IS NOT NULL AS is_true
              FROM pe p FULL OUTER JOIN true_ents t ON p.document = t.document AND p.entity_type = t.entity_type
                   AND p.start = t.start AND p."end" = t."end" """),
    ("aligned_rp", """SELECT coalesce(r.document, p.document) AS document, coalesce(r.token, p.token) AS token,
                             r.word AS token_value, coalesce(r.label, 'O') AS label_real,
                             coalesce(p.label, 'O') AS label_pred, p.token_str, round(p.score, 6) AS score
                      FROM silver r FULL OUTER JOIN p025 p ON r.document = p.document AND r.token = p.token"""),
]

VOCAB_TYPES = "(VALUES ('EMAIL'), ('ID_NUM'), ('NAME_STUDENT'), ('PHONE_NUM'), ('STREET_ADDRESS'), ('URL_PERSONAL'), ('USERNAME')) v(entity_type)"


def _focal() -> str:
    y = "list_position(" + LABEL_LIST + ", l.label) - 1"
    py = "CASE y " + " ".join(f"WHEN {i} THEN p{i}" for i in range(NUM_LABELS)) + " END"
    return with_chain(PIECE_LABELS + [
        ("fl", f"SELECT s.*, {y} AS y FROM scores s JOIN piece_labels l ON l.document = s.document AND l.piece = s.piece"),
        ("fl2", f"""SELECT CASE WHEN y = {O_ID} THEN {FOCAL_ALPHA_O!r} ELSE 1.0 END
                       * pow(1.0 - {py}, {FOCAL_GAMMA!r}) * -ln({py}) AS loss FROM fl WHERE y <> -100"""),
    ], "SELECT round(coalesce(avg(loss), 0.0), 6) AS loss, CAST(count(*) AS BIGINT) AS n_rows FROM fl2")


def _plan_ctes(extras: tuple[int, ...] = (1,), double: bool = True, positives_only: bool = True) -> list[tuple[str, str]]:
    """The rows of a training set: ``tplan`` (split, origin, source_document, document, skip, n_words, target_num, group)."""
    cut = f"greatest(s.n_words - {TRUNCATE_LEFT_WORDS}, 0)"
    full = """SELECT 'train' AS split, 'base_full' AS origin, document AS source_document, document, false AS cut
              FROM i42 WHERE fold <> 5 UNION ALL """ if double else ""
    wanted = """WHERE "group" = 1 OR origin IN ('val', 'extra')""" if positives_only else ""
    return CORPORA + [
        ("base_docs", "SELECT document FROM renum WHERE corpus = 0"),
        ("o77", f"SELECT document, ntile(10) OVER (ORDER BY {_pos(77)}) - 1 AS fold FROM base_docs"),
        ("i42", f"SELECT document, ntile(10) OVER (ORDER BY {_pos(42)}) - 1 AS fold FROM o77 WHERE fold <> 9"),
        ("tcopies", f"""{full}SELECT 'train' AS split, 'base_cut' AS origin, document AS source_document,
                       document + (SELECT max(document) + 1 FROM renum) AS document, true AS cut FROM i42 WHERE fold <> 5
                     UNION ALL SELECT 'val', 'val', document, document, true FROM i42 WHERE fold = 5
                     UNION ALL SELECT 'train', 'extra', source_document, document, true FROM renum
                               WHERE corpus IN ({", ".join(map(str, extras))})"""),
        ("tsized", f"""SELECT c.split, c.origin, c.source_document, c.document, c.cut,
                        CAST(count(s.token) AS INTEGER) AS n_words,
                        CAST(count(s.token) FILTER (WHERE s.label <> 'O') AS INTEGER) AS target_num,
                        CASE WHEN count(s.token) FILTER (WHERE s.label <> 'O') > 0 THEN 1 ELSE 0 END AS "group"
                      FROM tcopies c LEFT JOIN silver s ON s.document = c.source_document
                        AND (NOT c.cut OR s.token >= {cut}) GROUP BY ALL"""),
        ("tplan", f"""SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY {_pos(42)}) - 1 AS BIGINT) AS position
                      FROM tsized {wanted}"""),
    ]


def _prepare() -> str:
    return with_chain(_plan_ctes(), """SELECT origin, document, position, n_words, target_num, "group"
        FROM tplan WHERE split = 'train'""")


def _training_set(**settings) -> str:
    words = f"""SELECT p.document, s.token, s.n_words, s.word, s.blank, s.label, s.trailing_whitespace, s.prev_space,
                       s.char_start, s.char_end, CASE WHEN p.cut THEN greatest(s.n_words - {TRUNCATE_LEFT_WORDS}, 0) ELSE 0 END AS skip
                FROM silver s JOIN tplan p ON p.source_document = s.document"""
    return with_chain(_plan_ctes(**settings) + _example_ctes(words), """SELECT split, origin, tx.document, position, label_ids, starts,
        ends, length, n_words, target_num, "group" FROM tx JOIN tplan ON tx.document = tplan.document""")


def _example_ctes(words: str) -> list[tuple[str, str]]:
    """``tx``: the pieces of each example as text, from ``words`` with the number of words to ``skip``."""
    last = TRAIN_MAX_PIECES - 1
    label = """CASE WHEN start < char_end AND (NOT blank OR start + 1 < char_end) THEN label
                    WHEN start < char_end AND trailing_whitespace THEN 'O' ELSE coalesce(next_label, 'O') END"""
    return [
        ("te", words),
        ("tw", """SELECT document, token - skip AS token, n_words - skip AS n_words, blank, label,
                     trailing_whitespace, prev_space AND token > skip AS prev_space,
                     CASE WHEN blank THEN 0 ELSE CAST(ceil(length(word) / 4.0) AS INTEGER) END AS k,
                     char_start - min(char_start) OVER (PARTITION BY document) AS char_start,
                     char_end - min(char_start) OVER (PARTITION BY document) AS char_end
                   FROM te WHERE token >= skip"""),
        ("tc", f"""SELECT *, CAST(sum(k) OVER (PARTITION BY document ORDER BY token {RUNNING}) AS INTEGER) - k AS before,
                     lead(label) OVER (PARTITION BY document ORDER BY token) AS next_label FROM tw"""),
        ("tr", "SELECT document, before, char_start, char_end, prev_space, unnest(range(k)) AS j FROM tc WHERE k > 0"),
        ("tp", f"""SELECT document, before + j + 1 AS piece, char_start + 4 * j - CASE WHEN j = 0 AND prev_space THEN 1 ELSE 0 END AS start,
                     least(char_start + 4 * j + 4, char_end) AS "end" FROM tr WHERE before + j + 1 < {last}"""),
        ("tl", f"""SELECT p.document, p.piece, p.start, p."end", {label} AS label
                   FROM tp p ASOF JOIN tc w ON p.document = w.document AND p.start >= w.char_start
                   UNION ALL SELECT document, 0, 0, 0, 'O' FROM tc WHERE token = 0
                   UNION ALL SELECT document, least(before + k + 1, {last}), 0, 0, 'O' FROM tc WHERE token = n_words - 1"""),
        ("tx", f"""SELECT document, string_agg(CAST(list_position({LABEL_LIST}, label) - 1 AS VARCHAR), ' ' ORDER BY piece) AS label_ids,
                     string_agg(CAST(start AS VARCHAR), ' ' ORDER BY piece) AS starts,
                     string_agg(CAST("end" AS VARCHAR), ' ' ORDER BY piece) AS ends, count(*) AS length FROM tl GROUP BY document"""),
    ]


def _examples() -> str:
    words = f"""SELECT document, token, n_words, word, blank, label, trailing_whitespace, prev_space, char_start, char_end,
                       greatest(n_words - {TRUNCATE_LEFT_WORDS}, 0) AS skip FROM silver"""
    return with_chain(_example_ctes(words) + [("tn", COUNTS.format(src="tw"))],
                      """SELECT tx.*, target_num, "group" FROM tx JOIN tn ON tx.document = tn.document""")


def _piece_metrics() -> str:
    return with_chain(PIECE_LABELS + [
        ("pm", f"""SELECT a.document, row_number() OVER (PARTITION BY a.document ORDER BY a.piece) AS pos,
                     {LABEL_LIST}[a.l_all + 1] AS pred, l.label AS real
                   FROM am a JOIN piece_labels l ON a.document = l.document AND a.piece = l.piece WHERE a.start + a."end" > 0"""),
        ("ps", "SELECT 'p' AS side, document, pos, pred AS lab FROM pm UNION ALL SELECT 't', document, pos, real FROM pm"),
        ("pb", "SELECT *, lag(lab, 1, 'O') OVER (PARTITION BY side, document ORDER BY pos) AS prev FROM ps"),
        ("pg", f"""SELECT *, sum(CASE WHEN lab <> 'O' AND (lab LIKE 'B%' OR substr(prev, 3) <> substr(lab, 3)) THEN 1 ELSE 0 END)
                     OVER (PARTITION BY side, document ORDER BY pos {RUNNING}) AS grp FROM pb"""),
        ("pe2", """SELECT side, document, substr(min(lab), 3) AS entity_type, min(pos) AS s, max(pos) AS e
                   FROM pg WHERE lab <> 'O' GROUP BY side, document, grp"""),
        ("pk", """SELECT document, entity_type, s, e, bool_or(side = 'p') AS p, bool_or(side = 't') AS t FROM pe2 GROUP BY ALL"""),
        ("pt", f"""SELECT v.entity_type, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p) AS n_pred,
                     count(*) FILTER (WHERE t) AS n_true FROM {VOCAB_TYPES} LEFT JOIN pk ON pk.entity_type = v.entity_type GROUP BY 1"""),
        ("c", """SELECT * FROM pt UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(n_pred) AS BIGINT),
                 CAST(sum(n_true) AS BIGINT) FROM pt"""),
    ], _metrics_sql("c", "entity_type"))


def _sequences_sweep() -> str:
    repaired = """CASE WHEN mode > 0 AND substr(raw_label, 1, 1) = 'I' AND NOT cont THEN 'B-' || substr(raw_label, 3)
                       WHEN mode = 2 AND substr(raw_label, 1, 1) = 'B' AND cont THEN 'I-' || substr(raw_label, 3) ELSE raw_label END"""
    return with_chain(GATE + [
        ("modes", "SELECT * FROM (VALUES (0), (1), (2)) m(mode)"),
        ("pm", f"SELECT mode, threshold, document, token, {repaired} AS label FROM cont CROSS JOIN modes"),
    ], """SELECT g.mode, g.threshold, s.document, count(*) AS n_tokens, string_agg(s.label, ' ' ORDER BY s.token) AS labels_real,
                 string_agg(coalesce(p.label, 'O'), ' ' ORDER BY s.token) AS labels_pred
          FROM (SELECT mode, threshold FROM modes CROSS JOIN grid) g CROSS JOIN silver s
          LEFT JOIN pm p ON p.mode = g.mode AND p.threshold = g.threshold AND p.document = s.document AND p.token = s.token
          GROUP BY g.mode, g.threshold, s.document""")


def _report_sweep() -> str:
    repaired = """CASE WHEN mode > 0 AND substr(raw_label, 1, 1) = 'I' AND NOT cont THEN 'B-' || substr(raw_label, 3)
                       WHEN mode = 2 AND substr(raw_label, 1, 1) = 'B' AND cont THEN 'I-' || substr(raw_label, 3) ELSE raw_label END"""
    return with_chain(GATE + [
        ("modes", "SELECT * FROM (VALUES (0), (1), (2)) m(mode)"),
        ("pm", f"SELECT mode, threshold, document, token, {repaired} AS label, token_str, score FROM cont CROSS JOIN modes"),
        ("want", "SELECT mode, threshold, s.* FROM silver s CROSS JOIN modes CROSS JOIN grid WHERE label <> 'O'"),
    ], """SELECT w.mode, w.threshold, w.document, w.token, w.word AS token_value, w.label AS label_real,
                 coalesce(p.label, 'O') AS label_pred, p.token_str, round(p.score, 6) AS score
          FROM want w LEFT JOIN pm p ON p.mode = w.mode AND p.threshold = w.threshold AND p.document = w.document AND p.token = w.token
          WHERE coalesce(p.label, 'O') <> w.label""")


ORACLE: dict[str, str] = {
    "corpus_load": with_chain([("sc", """SELECT document, count(*) AS n,
                                   count(*) FILTER (WHERE label <> 'O') AS t FROM silver GROUP BY document""")],
        """SELECT d.document, CAST(length(d.text) AS BIGINT) AS n_chars, CAST(coalesce(sc.n, 0) AS BIGINT) AS n_tokens,
                  CAST(coalesce(sc.n, 0) AS BIGINT) AS n_labels, CAST(coalesce(sc.t, 0) AS BIGINT) AS n_target
           FROM docs d LEFT JOIN sc ON sc.document = d.document"""),
    "corpus_project": with_chain([("sc", "SELECT document, count(*) AS n FROM words GROUP BY document")],
        """SELECT d.document, d.text AS full_text, CAST(coalesce(sc.n, 0) AS BIGINT) AS n_tokens
           FROM docs d LEFT JOIN sc ON sc.document = d.document"""),
    "corpus_renumber": with_chain(WHOLE_CORPORA, "SELECT corpus, source_document, document FROM renum"),
    "next_offset": with_chain(CORPORA, """SELECT corpus, CAST(n AS BIGINT) AS n, CAST("offset" AS BIGINT) AS "offset",
        CAST(CASE WHEN corpus = 0 THEN max_id + 1 ELSE "offset" + n END AS BIGINT) AS next_offset FROM offs"""),
    "head_fraction": with_chain(CORPORA, """SELECT corpus, document FROM (
        SELECT corpus, document, row_number() OVER (PARTITION BY corpus ORDER BY document) - 1 AS pos,
               count(*) OVER (PARTITION BY corpus) AS n FROM src) WHERE pos < n // 10"""),
    "corpus_union": with_chain(WHOLE_CORPORA, "SELECT corpus, document, CAST(length(text) AS BIGINT) AS n_chars FROM renum"),
    "kfold_split": with_chain(SPLITS, f"""SELECT document, CAST(ntile(5) OVER (ORDER BY {_pos(42)}) - 1 AS INTEGER) AS fold
                                          FROM all_docs"""),
    "nested_split": with_chain(SPLITS, """SELECT document, 'test' AS split FROM outer_f WHERE fold = 9
        UNION ALL SELECT document, CASE WHEN fold = 5 THEN 'val' ELSE 'train' END FROM inner_f"""),
    "holdout_split": with_chain(SPLITS, f"""SELECT document, CASE WHEN pos < ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT document, row_number() OVER (ORDER BY {_pos(42)}) - 1 AS pos, count(*) OVER () AS n FROM all_docs)"""),
    "seeded_shuffle": with_chain(SPLITS, f"""SELECT document, CAST(row_number() OVER (ORDER BY {_pos(42)}) - 1 AS BIGINT) AS position
                                             FROM all_docs"""),
    "token_explode": with_chain([], """SELECT document, word AS token_value, label, token FROM silver
        UNION ALL SELECT d.document, NULL, NULL, 0 FROM docs d WHERE NOT EXISTS (
          SELECT 1 FROM words w WHERE w.document = d.document)"""),
    "detokenize": with_chain([("dt", """SELECT document, string_agg(word || CASE WHEN trailing_whitespace THEN ' ' ELSE '' END, ''
                                        ORDER BY token) AS t FROM words GROUP BY document""")],
        """SELECT d.document, CAST(length(coalesce(dt.t, '')) AS BIGINT) AS n_chars, coalesce(dt.t, '') = d.text AS lossless
           FROM docs d LEFT JOIN dt ON dt.document = d.document"""),
    "char_spans": with_chain([], "SELECT document, token, word, char_start, char_end FROM words"),
    "label_vocab": with_chain([], """SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, label
                                     FROM (SELECT DISTINCT label FROM silver)"""),
    "label_encode": with_chain([("voc", """SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, label
                                           FROM (SELECT DISTINCT label FROM silver)""")],
        "SELECT s.document, s.token, s.label, v.label_id FROM silver s JOIN voc v ON v.label = s.label"),
    "class_encode": with_chain([("cnt", COUNTS.format(src="silver"))],
        """SELECT document, "group", CAST(dense_rank() OVER (ORDER BY "group") - 1 AS INTEGER) AS group_code FROM cnt"""),
    "doc_target_counts": with_chain([], COUNTS.format(src="silver")),
    "doc_piece_length": with_chain([], f"""SELECT document, CAST(count(*) AS BIGINT) AS n_pieces,
        CAST(least(count(*), {TRAIN_MAX_PIECES}) AS BIGINT) AS length FROM pieces GROUP BY document"""),
    "filter_positive_docs": with_chain([("cnt", COUNTS.format(src="silver"))], 'SELECT * FROM cnt WHERE "group" = 1'),
    "truncate_left": with_chain([], f"""SELECT document, CAST(token - greatest(n_words - {TRUNCATE_LEFT_WORDS}, 0) AS INTEGER) AS token,
        word AS token_value, label, CAST(least(n_words, {TRUNCATE_LEFT_WORDS}) AS INTEGER) AS n_words
        FROM silver WHERE token >= greatest(n_words - {TRUNCATE_LEFT_WORDS}, 0)"""),
    "truncate_right": with_chain([], f"""SELECT document, CAST(CASE WHEN piece > {TEST_MAX_PIECES - 2} THEN {TEST_MAX_PIECES - 1}
        ELSE piece END AS INTEGER) AS piece, start, "end" FROM pieces
        WHERE piece <= {TEST_MAX_PIECES - 2} OR start + "end" = 0"""),
    "document_shift": with_chain([], """SELECT document AS source_document,
        CAST(document + (SELECT max(document) + 1 FROM docs) AS BIGINT) AS document FROM docs"""),
    "double_truncate": with_chain([
        ("off", "SELECT max(document) + 1 AS o FROM silver"),
        ("cutw", f"""SELECT document + (SELECT o FROM off) AS document, label FROM silver
                     WHERE token >= greatest(n_words - {TRUNCATE_LEFT_WORDS}, 0)"""),
        ("full_c", COUNTS.format(src="silver")),
        ("cut_c", COUNTS.format(src="cutw")),
    ], "SELECT 'full' AS copy, * FROM full_c UNION ALL SELECT 'cut', * FROM cut_c"),
    "prepare_training_set": _prepare(),
    "training_examples": _examples(),
    "training_set": _training_set(),
    "training_set_all_corpora": _training_set(extras=(1, 2, 3), double=False, positives_only=False),
    "positive_rows": with_chain([], """SELECT document, token, word AS token_value, label FROM silver
        WHERE document IN (SELECT document FROM silver WHERE label <> 'O')"""),
    "detect_emails": with_chain([], f"""SELECT document, token, 'B-EMAIL' AS label, word AS token_str, 1.0 AS score
        FROM words WHERE regexp_full_match(word, {q(EMAIL_PATTERN)})"""),
    "detect_phones": with_chain([], """SELECT p.document, p.token, p.label, w.word AS token_str, 1.0 AS score
        FROM phones p JOIN words w ON w.document = p.document AND w.token = p.token"""),
    "detect_rules": with_chain(GATE_RULES, "SELECT document, token, label, token_str, score FROM rule_hits"),
    "find_span": with_chain([], 'SELECT DISTINCT document, s AS start, e AS "end" FROM spans'),
    "score_pieces": with_chain([], f"SELECT document, piece, {Z} FROM logits"),
    "softmax_scores": with_chain([], f"SELECT document, piece, {RP} FROM scores"),
    "argmax_label": with_chain([], f"""SELECT document, piece, l_all, l_no, {LABEL_LIST}[l_all + 1] AS label_all,
        {LABEL_LIST}[l_no + 1] AS label_no FROM am"""),
    "ensemble_scores": with_chain([("py", f"""SELECT document, token, piece, concat_ws(':', document, token, piece) AS k,
                                                 list_position({LABEL_LIST}, word_label) - 1 AS y FROM pieces""")]
                                  + _member_sql("a", "k") + _member_sql("b", "'b:' || k"),
                                  "SELECT a.document, a.piece, "
                                  + ", ".join(f"round((a.e[{i + 1}] / a.s * 1.0 + b.e[{i + 1}] / b.s * 2.0) / 3.0, 6) AS p{i}" for i in range(NUM_LABELS))
                                  + " FROM ap a JOIN bp b ON a.document = b.document AND a.piece = b.piece"),
    "focal_loss": _focal(),
    "threshold_pick": with_chain([], "SELECT document, piece, CASE WHEN p_o < 0.25 THEN l_no ELSE l_all END AS label_id FROM am"),
    "align_pieces": with_chain([], "SELECT document, piece, token, token_str FROM aligned"),
    "piece_labels": with_chain(PIECE_LABELS, "SELECT document, piece, label FROM piece_labels"),
    "decode_no_rewrite": decode_sql(0, 0.25),
    "decode_rewrite_i": decode_sql(1, 0.25),
    "decode_rewrite_both": decode_sql(2, 0.25),
    "decode_ignored": decode_sql(1, 0.25, RULE_LABELS),
    "decode_first_piece": with_chain(GATE, """SELECT threshold, document, token, raw_label AS label, token_str,
                                              round(score, 6) AS score FROM first_piece"""),
    "rules_plus_model": with_chain(GATE_RULES, "SELECT document, token, label, token_str, round(score, 6) AS score FROM preds WHERE threshold = 0.25"),
    "entity_spans": with_chain(ENT, """SELECT 'pred' AS source, * FROM pe UNION ALL SELECT 'true', * FROM true_ents"""),
    "entity_match": with_chain(ENT, "SELECT * FROM em"),
    "entity_f5_micro": with_chain(ENT + [("c", """SELECT CAST(count(*) FILTER (WHERE is_pred AND is_true) AS BIGINT) AS tp,
        CAST(count(*) FILTER (WHERE is_pred) AS BIGINT) AS n_pred, CAST(count(*) FILTER (WHERE is_true) AS BIGINT) AS n_true
        FROM em""")], _metrics_sql("c")),
    "entity_f5_by_type": with_chain(ENT + [("c0", """SELECT entity_type, count(*) FILTER (WHERE is_pred AND is_true) AS tp,
        count(*) FILTER (WHERE is_pred) AS n_pred, count(*) FILTER (WHERE is_true) AS n_true FROM em GROUP BY entity_type"""),
        ("types", f"SELECT entity_type FROM {VOCAB_TYPES} UNION SELECT entity_type FROM c0"),
        ("c", """SELECT t.entity_type, CAST(coalesce(c0.tp, 0) AS BIGINT) AS tp, CAST(coalesce(c0.n_pred, 0) AS BIGINT) AS n_pred,
                 CAST(coalesce(c0.n_true, 0) AS BIGINT) AS n_true FROM types t LEFT JOIN c0 ON c0.entity_type = t.entity_type""")],
        _metrics_sql("c", "entity_type")),
    "label_sequences": with_chain(ENT, """SELECT document, CAST(count(*) AS BIGINT) AS n_tokens,
        string_agg(label_real, ' ' ORDER BY token) AS labels_real, string_agg(label_pred, ' ' ORDER BY token) AS labels_pred
        FROM aligned_rp GROUP BY document"""),
    "label_sequences_sweep": _sequences_sweep(),
    "align_real_pred": with_chain(GATE_025, "SELECT * FROM aligned_rp"),
    "error_report": with_chain(GATE_025, "SELECT * FROM aligned_rp WHERE label_pred <> label_real AND label_real <> 'O'"),
    "error_report_sweep": _report_sweep(),
    "piece_metrics": _piece_metrics(),
    "semi_join_test_docs": with_chain(SPLITS, """SELECT document, token, word AS token_value, label FROM silver
        WHERE document IN (SELECT document FROM test_fold)"""),
    "calibrate_no_rewrite": calibrate_sql(0),
    "calibrate_rewrite_i": calibrate_sql(1),
    "calibrate_rewrite_both": calibrate_sql(2),
    "calibrate_with_rules": calibrate_sql(1, rules=True),
    "best_threshold": calibrate_sql(1).replace(
        "FROM cal_f5", "FROM cal_f5 WHERE f5 IS NOT NULL ORDER BY f5 DESC, threshold ASC LIMIT 1"),
    "quality_gate": calibrate_sql(1).replace(
        "round(f5, 6) AS f5 FROM cal_f5",
        f"round(f5, 6) AS f5, f5 < {F5_GATE!r} AS bad_run FROM cal_f5 WHERE f5 IS NOT NULL "
        "ORDER BY f5 DESC, threshold ASC LIMIT 1"),
}

