"""The SQL oracle: each query restated as plain SQL (DuckDB dialect) over the raw tables.

Deliberately formulated differently from the Spark operators where it matters: the
tokeniser uses the two capture groups, alignment is an ``ASOF`` join, decoding is dense
(every piece x threshold, ``row_number`` for the first piece), and chunking runs over the
dense word sequence like the original list-based scorer. Only the fixed definitions
(patterns, label set, hash scorer, grid) are shared.
"""

from __future__ import annotations

from ..functions.text import (EMAIL_PATTERN, ID_NUM_PATTERN, PHONE_PATTERN_EXTENDED, WHITESPACE_CLASS,
                              WORD_PATTERN)
from ..schema import LABELS, NUM_LABELS, O_ID, RULE_LABELS, THRESHOLDS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


LABEL_LIST = "[" + ", ".join(q(x) for x in LABELS) + "]"
GRID_VALUES = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in THRESHOLDS)
RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _argmax_sql(cols: list[str], ids: list[int]) -> str:
    mx = "greatest(" + ", ".join(cols) + ")"
    whens = " ".join(f"WHEN {c} = {mx} THEN {i}" for c, i in zip(cols, ids))
    return f"CASE {whens} END"


_P = [f"p{i}" for i in range(NUM_LABELS)]
_Z = [f"z{i}" for i in range(NUM_LABELS)]
_NON_O = [i for i in range(NUM_LABELS) if i != O_ID]


def _z(i: int) -> str:
    extra = " + 2.0" if i == O_ID else ""
    return (f"CAST(('0x' || substr(h, {2 * i + 1}, 2)) AS INTEGER) / 32.0"
            f" + CASE WHEN y = {i} THEN 4.0 ELSE 0.0 END{extra} AS z{i}")


# Ordered CTE chain; a query includes the chain and selects from the steps it needs
# (DuckDB skips steps nobody references).
CTES: list[tuple[str, str]] = [
    ("docs", "SELECT doc_id AS document, text FROM documents"),
    ("wm", f"""SELECT document, regexp_extract_all(text, {q(WORD_PATTERN)}, 1) AS toks,
                      regexp_extract_all(text, {q(WORD_PATTERN)}, 2) AS sps FROM docs"""),
    ("w0", """SELECT document, CAST(unnest(range(len(toks))) AS INTEGER) AS token, unnest(toks) AS word,
                     unnest(sps) = ' ' AS trailing_whitespace, CAST(len(toks) AS INTEGER) AS n_words FROM wm"""),
    ("w1", f"""SELECT *, regexp_full_match(word, {q(WHITESPACE_CLASS + '+')}) AS blank,
                      length(word) + CASE WHEN trailing_whitespace THEN 1 ELSE 0 END AS mlen FROM w0"""),
    ("words", f"""SELECT document, token, word, trailing_whitespace, n_words, blank,
                 COALESCE(lag(trailing_whitespace) OVER (PARTITION BY document ORDER BY token)
                          OR lag(blank) OVER (PARTITION BY document ORDER BY token), false) AS prev_space,
                 CAST(sum(mlen) OVER (PARTITION BY document ORDER BY token {RUNNING}) - mlen AS INTEGER) AS char_start,
                 CAST(sum(mlen) OVER (PARTITION BY document ORDER BY token {RUNNING}) - mlen + length(word) AS INTEGER) AS char_end
                 FROM w1"""),
    # Phone hits, re-tokenised, searched among the document's words (every start tried).
    ("hits", f"""SELECT document, unnest(regexp_extract_all(text, {q(PHONE_PATTERN_EXTENDED)}, 1)) AS hit FROM docs"""),
    ("targets", f"""SELECT document, row_number() OVER () AS hit_id,
                    regexp_extract_all(hit, {q(WORD_PATTERN)}, 1) AS target FROM hits"""),
    ("cand", """SELECT t.document, t.hit_id, t.target, m.toks,
                       unnest(range(len(m.toks) - len(t.target) + 1)) AS i
                FROM targets t JOIN wm m ON m.document = t.document
                WHERE len(t.target) > 0 AND len(m.toks) >= len(t.target)"""),
    ("spans", """SELECT document, hit_id, CAST(i AS INTEGER) AS s, CAST(i + len(target) - 1 AS INTEGER) AS e
                 FROM cand WHERE list_slice(toks, i + 1, i + len(target)) = target"""),
    ("phone_words", "SELECT document, s, unnest(range(s, e + 1)) AS tok FROM spans"),
    ("phones", """SELECT document, CAST(tok AS INTEGER) AS token,
                  min(CASE WHEN tok = s THEN 'B-PHONE_NUM' ELSE 'I-PHONE_NUM' END) AS label
                  FROM phone_words GROUP BY document, tok"""),
    ("silver", f"""SELECT w.*, CASE WHEN w.blank THEN 'O'
                        WHEN regexp_full_match(w.word, {q(EMAIL_PATTERN)}) THEN 'B-EMAIL'
                        WHEN p.label IS NOT NULL THEN p.label
                        WHEN regexp_full_match(w.word, {q(ID_NUM_PATTERN)}) THEN 'B-ID_NUM'
                        WHEN w.token % 40 = 7 THEN 'B-NAME_STUDENT'
                        WHEN w.token % 40 = 8 THEN 'I-NAME_STUDENT'
                        ELSE 'O' END AS label
                  FROM words w LEFT JOIN phones p ON p.document = w.document AND p.token = w.token"""),
    # Pieces of four characters, specials at head and tail.
    ("wk", """SELECT *, CASE WHEN blank THEN 0 ELSE CAST(ceil(length(word) / 4.0) AS INTEGER) END AS k FROM silver"""),
    ("wc", f"""SELECT *, CAST(sum(k) OVER (PARTITION BY document ORDER BY token {RUNNING}) AS INTEGER) - k AS before
               FROM wk"""),
    ("rp", """SELECT document, token, label AS word_label, before, char_start, char_end, prev_space,
                     unnest(range(k)) AS j FROM wc WHERE k > 0"""),
    ("pieces", """SELECT document, CAST(before + j + 1 AS INTEGER) AS piece, token,
                         CAST(char_start + 4 * j - CASE WHEN j = 0 AND prev_space THEN 1 ELSE 0 END AS INTEGER) AS start,
                         CAST(least(char_start + 4 * j + 4, char_end) AS INTEGER) AS "end", word_label FROM rp
                  UNION ALL SELECT document, 0, -1, 0, 0, 'O' FROM wc WHERE token = 0
                  UNION ALL SELECT document, CAST(before + k + 1 AS INTEGER), -1, 0, 0, 'O' FROM wc
                            WHERE token = n_words - 1"""),
    ("hashed", f"""SELECT document, piece, start, "end", md5(concat_ws(':', document, token, piece)) AS h,
                          list_position({LABEL_LIST}, word_label) - 1 AS y FROM pieces"""),
    ("hashed_b", f"""SELECT document, piece, start, "end", md5('b:' || concat_ws(':', document, token, piece)) AS h,
                          list_position({LABEL_LIST}, word_label) - 1 AS y FROM pieces"""),
    ("logits", "SELECT document, piece, start, \"end\", " + ", ".join(_z(i) for i in range(NUM_LABELS)) + " FROM hashed"),
    ("logits_b", "SELECT document, piece, start, \"end\", " + ", ".join(_z(i) for i in range(NUM_LABELS)) + " FROM hashed_b"),
    ("ex", "SELECT document, piece, start, \"end\", "
           + ", ".join(f"exp(z{i} - greatest({', '.join(_Z)})) AS e{i}" for i in range(NUM_LABELS))
           + " FROM logits"),
    ("scores", "SELECT document, piece, start, \"end\", "
               + ", ".join(f"e{i} / ({' + '.join(f'e{k}' for k in range(NUM_LABELS))}) AS p{i}" for i in range(NUM_LABELS))
               + " FROM ex"),
    ("ex_b", "SELECT document, piece, start, \"end\", "
             + ", ".join(f"exp(z{i} - greatest({', '.join(_Z)})) AS e{i}" for i in range(NUM_LABELS))
             + " FROM logits_b"),
    ("scores_b", "SELECT document, piece, start, \"end\", "
                 + ", ".join(f"e{i} / ({' + '.join(f'e{k}' for k in range(NUM_LABELS))}) AS p{i}" for i in range(NUM_LABELS))
                 + " FROM ex_b"),
    ("am", "SELECT *, " + _argmax_sql(_P, list(range(NUM_LABELS))) + " AS l_all, "
           + _argmax_sql([f"p{i}" for i in _NON_O], _NON_O) + f" AS l_no, p{O_ID} AS p_o FROM scores"),
    ("aligned", """SELECT a.*, w.token, w.word AS token_str
                   FROM (SELECT * FROM am WHERE start + "end" > 0) a
                   ASOF JOIN (SELECT document, token, word, char_end FROM silver WHERE NOT blank) w
                   ON a.document = w.document AND a.start < w.char_end"""),
    ("grid", f"SELECT * FROM (VALUES {GRID_VALUES}) g(threshold)"),
    ("true_ents_src", """SELECT document, token, label AS lab,
                         lag(label) OVER (PARTITION BY document ORDER BY token) AS prev FROM silver"""),
    ("true_st", """SELECT *, CASE WHEN lab = 'O' THEN 0 WHEN substr(lab, 1, 1) = 'B' THEN 1
                   WHEN prev IS NULL OR prev = 'O' THEN 1 WHEN substr(prev, 3) <> substr(lab, 3) THEN 1 ELSE 0 END AS st
                   FROM true_ents_src"""),
    ("true_grp", f"""SELECT *, sum(st) OVER (PARTITION BY document ORDER BY token {RUNNING}) AS grp FROM true_st"""),
    ("true_ents", """SELECT document, substr(min(lab), 3) AS entity_type, CAST(min(token) AS INTEGER) AS start,
                     CAST(max(token) AS INTEGER) AS "end" FROM true_grp WHERE lab <> 'O' GROUP BY document, grp"""),
]


def _decode_ctes(mode: int, ignored: tuple[str, ...] = (), rules: bool = False) -> list[tuple[str, str]]:
    ign = ""
    if ignored:
        ids = ", ".join(str(LABELS.index(x)) for x in ignored)
        ign = f" AND lid NOT IN ({ids})"
    pick_score = "CASE lid " + " ".join(f"WHEN {i} THEN p{i}" for i in range(NUM_LABELS)) + " END"
    ctes = [
        ("picked0", """SELECT g.threshold, a.*, CASE WHEN a.p_o < g.threshold THEN a.l_no ELSE a.l_all END AS lid
                        FROM aligned a CROSS JOIN grid g"""),
        ("picked", f"""SELECT threshold, document, token, token_str, piece, lid, {pick_score} AS score
                       FROM picked0"""),
        ("emitted", f"""SELECT *, row_number() OVER (PARTITION BY threshold, document, token ORDER BY piece) AS rn
                        FROM picked WHERE lid <> {O_ID}{ign}"""),
        ("first_piece", f"""SELECT threshold, document, token, token_str, {LABEL_LIST}[lid + 1] AS raw_label, score
                            FROM emitted WHERE rn = 1"""),
        ("cont", """SELECT *, COALESCE(lag(token) OVER (PARTITION BY threshold, document ORDER BY token) = token - 1
                     AND substr(lag(raw_label) OVER (PARTITION BY threshold, document ORDER BY token), 3)
                         = substr(raw_label, 3), false) AS cont FROM first_piece"""),
    ]
    if mode == 0:
        lab = "raw_label"
    elif mode == 1:
        lab = "CASE WHEN substr(raw_label, 1, 1) = 'I' AND NOT cont THEN 'B-' || substr(raw_label, 3) ELSE raw_label END"
    else:
        lab = ("CASE WHEN substr(raw_label, 1, 1) = 'I' AND NOT cont THEN 'B-' || substr(raw_label, 3)"
               " WHEN substr(raw_label, 1, 1) = 'B' AND cont THEN 'I-' || substr(raw_label, 3) ELSE raw_label END")
    ctes.append(("model_preds", f"SELECT threshold, document, token, {lab} AS label, token_str, score FROM cont"))
    if rules:
        ctes += [
            ("rule_hits", f"""SELECT document, token, 'B-EMAIL' AS label, word AS token_str, 1.0 AS score FROM words
                              WHERE regexp_full_match(word, {q(EMAIL_PATTERN)})
                              UNION ALL
                              SELECT p.document, p.token, p.label, w.word, 1.0 FROM phones p
                              JOIN words w ON w.document = p.document AND w.token = p.token"""),
            ("preds", """SELECT g.threshold, r.document, r.token, r.label, r.token_str, r.score
                         FROM rule_hits r, grid g
                         UNION ALL
                         SELECT m.* FROM model_preds m WHERE NOT EXISTS (
                           SELECT 1 FROM rule_hits r WHERE r.document = m.document AND r.token = m.token)"""),
        ]
    else:
        ctes.append(("preds", "SELECT * FROM model_preds"))
    ctes += [
        ("seq", """SELECT g.threshold, s.document, s.token, COALESCE(p.label, 'O') AS lab
                   FROM silver s CROSS JOIN grid g
                   LEFT JOIN preds p ON p.threshold = g.threshold AND p.document = s.document AND p.token = s.token"""),
        ("seq_prev", """SELECT *, lag(lab) OVER (PARTITION BY threshold, document ORDER BY token) AS prev FROM seq"""),
        ("seq_st", """SELECT *, CASE WHEN lab = 'O' THEN 0 WHEN substr(lab, 1, 1) = 'B' THEN 1
                      WHEN prev IS NULL OR prev = 'O' THEN 1 WHEN substr(prev, 3) <> substr(lab, 3) THEN 1 ELSE 0 END AS st
                      FROM seq_prev"""),
        ("seq_grp", f"""SELECT *, sum(st) OVER (PARTITION BY threshold, document ORDER BY token {RUNNING}) AS grp
                        FROM seq_st"""),
        ("pred_ents", """SELECT threshold, document, substr(min(lab), 3) AS entity_type, CAST(min(token) AS INTEGER) AS start,
                         CAST(max(token) AS INTEGER) AS "end" FROM seq_grp WHERE lab <> 'O'
                         GROUP BY threshold, document, grp"""),
        ("cal_counts", """SELECT g.threshold,
                 (SELECT count(*) FROM pred_ents p JOIN true_ents t ON p.document = t.document
                    AND p.entity_type = t.entity_type AND p.start = t.start AND p."end" = t."end"
                    WHERE p.threshold = g.threshold) AS tp,
                 (SELECT count(*) FROM pred_ents p WHERE p.threshold = g.threshold) AS n_pred,
                 (SELECT count(*) FROM true_ents) AS n_true
               FROM grid g"""),
        ("cal", """SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(n_pred AS BIGINT) AS n_pred,
                          CAST(n_true AS BIGINT) AS n_true,
                          CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                          CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall FROM cal_counts"""),
        ("cal_f5", """SELECT *, CASE WHEN 25.0 * precision + recall > 0
                        THEN 26.0 * precision * recall / (25.0 * precision + recall) END AS f5 FROM cal"""),
    ]
    return ctes


def with_chain(extra: list[tuple[str, str]], final: str) -> str:
    chain = CTES + extra
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in chain)
    return f"WITH {body}\n{final}"


ROUND_CAL = ("SELECT threshold, tp, n_pred, n_true, round(precision, 6) AS precision, "
             "round(recall, 6) AS recall, round(f5, 6) AS f5 FROM cal_f5")


def calibrate_sql(mode: int, rules: bool = False) -> str:
    ignored = RULE_LABELS if rules else ()
    return with_chain(_decode_ctes(mode, ignored, rules), ROUND_CAL)


def decode_sql(mode: int, threshold: float, ignored: tuple[str, ...] = ()) -> str:
    final = (f"SELECT document, token, label, token_str, round(score, 6) AS score FROM preds "
             f"WHERE threshold = CAST({threshold!r} AS DOUBLE)")
    return with_chain(_decode_ctes(mode, ignored), final)
