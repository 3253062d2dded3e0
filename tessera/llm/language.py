"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tessera.llm.common import checkpoint

#: Labelled texts of a language that are learned from at most, and bytes of folded text that they give in all.
SNIPPETS = 48
BUDGET = 48 * 1024
#: Texts are parsed in blocks of so many bytes side by side, then joined: phrases run across the borders.
BLOCK = 512
#: Bytes parsed in one go.
GO = 1 << 20


def folded(text: str | None) -> bytes:
    """Lower-cased UTF-8 of a whole text; runs of ASCII other than a-z become one space."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    return b" ".join(raw.split(b" ")) if b"  " not in raw else b" ".join(raw.split())


_LETTERS = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass
class Automaton:
    """The smallest automaton that reads every substring of a text, and a last state that reads nothing.

    Nearly all states have one transition at most: those are two arrays (class, target). Only the others have
    a dense row, so 48 KB of text take about 5 MB.
    """

    only: np.ndarray
    target: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    classes: int

    def step(self, states: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where each state goes by its byte class; -1: nowhere."""
        to = self.dense[self.row[states] * self.classes + c]
        return np.where(self.only[states] == c, self.target[states], to)


def suffix_automaton(text: np.ndarray, classes: int) -> Automaton:
    """Built a byte at a time from the text's byte classes."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    wide = [state for state, edges in enumerate(nxt) if len(edges) > 1]
    only, target = np.full(len(nxt) + 1, -1, np.int16), np.full(len(nxt) + 1, -1, np.int32)
    row, dense = np.zeros(len(nxt) + 1, np.int64), np.full((len(wide) + 1, classes), -1, np.int32)
    row[wide] = np.arange(1, len(wide) + 1)
    for state, edges in enumerate(nxt):
        if len(edges) > 1:
            dense[row[state], list(edges)] = list(edges.values())
        for c, to in edges.items() if len(edges) == 1 else ():
            only[state], target[state] = c, to
    return Automaton(only, target, row, dense.ravel(), classes)


@lru_cache(maxsize=1)
def parsers(corpus: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, list[Automaton]]:
    """Class of each byte (0: in no language's text) and one automaton per language.

    Built once per Python worker, from the bounded text that the task carries.
    """
    known = sorted(set(b"".join(t for _, t in corpus)))
    cls = np.zeros(256, np.int32)
    cls[known] = np.arange(1, len(known) + 1)
    width = len(known) + 1
    return cls, [suffix_automaton(cls[np.frombuffer(t, np.uint8)], width) for _, t in corpus]


def phrases(blocks: np.ndarray, lengths: np.ndarray, before: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Phrases that begin in each row in the longest-match parse of whole texts.

    Rows are blocks of texts by falling length; ``before`` is the row that a row follows in its text, -1 for a
    text's first. All rows are first parsed as if a phrase began with them, one step for all. Then each
    row is read again from the state in which the row before it ended, until a phrase begins at one
    byte in both readings: from there on they agree. A row whose end state changes has its follower read
    again.
    """
    n = len(blocks)
    reach = automaton.step(np.zeros(automaton.classes, np.int64), np.arange(automaton.classes))
    # After a byte that the language doesn't know, in a state without transitions, any byte is new.
    first = np.where(reach < 0, len(automaton.row) - 1, reach).astype(np.int64)
    begins = np.zeros((n, blocks.shape[1]), bool)
    begins[:, 0] = True
    state = first[blocks[:, 0]]
    for i in range(1, int(lengths[0]) if n else 0):
        live = int(np.searchsorted(-lengths, -i, side="left"))
        c = blocks[:live, i]
        to = automaton.step(state[:live], c)
        stop = to < 0
        begins[:live, i] = stop
        state[:live] = np.where(stop, first[c], to)
    count, change = begins.sum(axis=1), np.zeros(n, np.int64)
    after = np.full(n, -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    end, todo = state.copy(), np.flatnonzero(before >= 0)
    while len(todo):
        change[todo] = 0
        rows, now, ended = todo, end[before[todo]], state[todo]
        where = np.arange(len(todo))
        i = 0
        while len(rows):
            c = blocks[rows, i]
            to = automaton.step(now, c)
            stop = to < 0
            now = np.where(stop, first[c], to)
            change[rows] += stop.astype(np.int64) - begins[rows, i]
            i += 1
            apart = ~(stop & begins[rows, i - 1])
            over = apart & (lengths[rows] <= i)
            ended[where[over]] = now[over]
            more = apart & ~over
            rows, now, where = rows[more], now[more], where[more]
        moved = todo[ended != end[todo]]
        end[todo] = ended
        todo = after[moved]
        todo = np.sort(todo[todo >= 0])
    return count + change


def cross_parse(texts: list[bytes], corpus: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """Phrases per byte of every text (row) by every language (column)."""
    cls, tables = parsers(corpus)
    sizes = np.array([len(t) for t in texts])
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), per)
    blocks = np.zeros((len(owner), BLOCK), np.int32)
    blocks_flat, at = blocks.reshape(-1), 0
    for t, n in zip(texts, per):
        blocks_flat[at:at + len(t)] = cls[np.frombuffer(t, np.uint8)]
        at += int(n) * BLOCK
    lengths = np.full(len(owner), BLOCK)
    ends = np.cumsum(per) - 1
    lengths[ends[per > 0]] = (sizes - (per - 1) * BLOCK)[per > 0]
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    follows = np.zeros(len(owner), bool)
    follows[1:] = owner[1:] == owner[:-1]
    before = np.where(follows, np.append(-1, place[:-1])[:len(place)], -1)[order]
    out = np.zeros((len(texts), len(tables)))
    for k, table in enumerate(tables):
        n = phrases(blocks[order], lengths[order], before, table)
        out[:, k] = np.bincount(owner[order], n, len(texts))
    return out / np.maximum(sizes, 1)[:, None]


def shares(sizes: list[int], budget: int) -> list[int]:
    """How much of each text goes into a budget: all alike, but what short texts leave goes to longer ones."""
    out, left = [0] * len(sizes), budget
    for k, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[i] = min(sizes[i], left // (len(sizes) - k))
        left -= out[i]
    return out


def _sample(rows: pd.DataFrame) -> pd.DataFrame:
    """One language's training text, from its sampled texts (SNIPPETS at most, of BUDGET characters at most)."""
    rows = rows.sort_values("b")
    texts = [folded(t).strip() for t in rows["t"]]
    parts = []
    for t, h, n in zip(texts, rows["h"], shares([len(t) for t in texts], BUDGET)):
        start = h % (len(t) - n + 1)
        parts.append(t[start:start + n])
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "text": [b" ".join(parts)]})


def training_text(df: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column) -> tuple:
    """((language, folded text), ...): BUDGET bytes per language, from SNIPPETS texts at most.

    Of each hash class of the labelled rows, the text with the smallest hash; a grouped minimum,
    so a language that holds most rows is folded in the map tasks. The budget is in bytes of folded text, so
    every script gets as much, and a language with few or short texts takes more of each. Where in a
    longer text its part begins is drawn by the same hash. The driver gets BUDGET bytes per language.
    """
    h = F.xxhash64(id_col, text_col)
    rows = df.where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    start = F.pmod(F.hash(h), F.greatest(F.char_length(text_col) - BUDGET, F.lit(0)) + 1) + 1
    rows = rows.select(F.col(lang_col).alias("lang"), F.pmod(h, F.lit(SNIPPETS)).alias("b"), h.alias("h"),
                       F.substr(F.col(text_col), start, F.lit(BUDGET)).alias("t"))
    best = rows.groupBy("lang", "b").agg(F.min(F.struct("h", "t")).alias("x")).select("lang", "b", "x.h", "x.t")
    text = checkpoint(best.groupBy("lang").applyInPandas(_sample, "lang string, text binary"))
    return tuple(sorted((r.lang, bytes(r.text)) for r in text.collect()))


GUESS = StructType().add("lang", StringType()).add("score", DoubleType())


def identify(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` for every row.

    Each whole text is parsed into the longest phrases that occur in a language's training text; the
    language with the fewest phrases per byte wins, the first by name in a tie.
    ``score`` is the winner's share of the inverse phrase rates. ``und`` with score 0 if the text
    is null or has no letter, or if no row teaches a language. Languages are learned from
    BUDGET bytes each (less if their texts have less); the automata are built in the workers from these, some
    5 MB a language.

    Repeated rows are judged alike; repeated training rows are one text. An empty table gives an
    empty result. Columns named lang_pred and score are replaced, others are kept.
    """
    corpus = training_text(df, id_col, text_col, lang_col, train)

    @F.pandas_udf(GUESS)
    def guess(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        todo: list[int] = []
        held: list[bytes] = []

        def flush():
            rate = 1 / cross_parse(held, corpus)
            best = rate.argmax(axis=1)
            for i, k, r in zip(todo, best, rate):
                lang[i], score[i] = corpus[k][0], r[k] / r.sum()
            todo.clear()
            held.clear()

        for i, (t, has) in enumerate(zip(texts, letters)):
            if has and corpus:
                todo.append(i)
                held.append(folded(t).strip() or b" ")
                if sum(map(len, held[-64:])) > GO or len(held) % 64 == 0 and sum(map(len, held)) > GO:
                    flush()
        if held:
            flush()
        return pd.DataFrame({"lang": lang, "score": score})

    text = F.col(text_col)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    guessed = df.withColumn("_tessera_guess", guess(text, letters))
    return guessed.withColumns({"lang_pred": F.col("_tessera_guess.lang"), "score": F.col("_tessera_guess.score")}).drop("_tessera_guess")
