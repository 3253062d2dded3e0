"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios, over windows of each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from tessera.llm.common import bitmap, checkpoint, in_bitmap
from tessera.llm.shingles import mix64

NGRAMS = (3, 4, 5)
#: The classifier is fitted on so many labelled rows at most, and keeps so many features.
FIT_ROWS = 20_000
FEATURES = 20_000
#: Texts that every n-gram counts as seen in besides, toxic and not in the proportion of the sample.
SMOOTHING = 2.0
#: A window is two neighbouring halves of so many bytes; windows overlap by one half.
HALF = 2048
#: One in so many rows of the fit is a passage amid clean text.
FILLED = 4
#: Bytes looked at in one go: whole halves.
_WIDE = 16 * HALF
#: Distinct n-grams of longer texts are gathered in several rounds, each of a share of the n-grams.
_ROUND = 1 << 22
#: N-grams counted in a task before their sums are handed on.
_HELD = 1 << 21
SLOT_BITS = 18


def raw_bytes(text: str | None) -> np.ndarray:
    """Lower-cased UTF-8 of a whole text with a space at each end."""
    return np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8)


def grams(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, n-grams that begin from there on, one for each byte), ``_WIDE`` bytes in one go.

    An n-gram is named by its length and bytes, so no two share a name.
    """
    for at in range(0, len(raw), _WIDE):
        for n in NGRAMS:
            b = raw[at:at + _WIDE + n - 1].astype(np.int64)
            if len(b) >= n:
                h = np.full(len(b) - n + 1, n, np.int64)
                for j in range(n):
                    h = (h << 8) | b[j:len(b) - n + 1 + j]
                yield at, h


def distinct_grams(text: str | None) -> Iterator[np.ndarray]:
    """The distinct n-grams of a whole text, in arrays without common members."""
    raw = raw_bytes(text)
    rounds = len(raw) // _ROUND + 1
    for r in range(rounds):
        got = [np.unique(h if rounds == 1 else h[mix64(h.view(np.uint64)) % np.uint64(rounds) == r]) for _, h in grams(raw)]
        yield np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)


class Vocabulary:
    """Places of the kept n-grams. Any other n-gram has none, so it adds nothing to a score."""

    def __init__(self, names: np.ndarray):
        self.names = names

    def __len__(self) -> int:
        return len(self.names)

    def __reduce__(self):
        return Vocabulary, (self.names,)

    @staticmethod
    def slot(names: np.ndarray, level: int) -> np.ndarray:
        return (mix64(names.view(np.uint64) + np.uint64(level)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """Tables of places by slot; what finds its slot taken goes to the next table."""
        out, rest = [], np.arange(len(self.names))
        while len(rest):
            slots, first = np.unique(self.slot(self.names[rest], len(out)), return_index=True)
            table = np.full(1 << SLOT_BITS, -1, np.int32)
            table[slots] = rest[first]
            out.append(table)
            rest = np.delete(rest, first)
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` are kept, their places)."""
        which, places, open_ = [], [], np.arange(len(h))
        for level, table in enumerate(self.levels):
            place = table[self.slot(h[open_], level)]
            open_, place = open_[place >= 0], place[place >= 0]
            same = self.names[place] == h[open_]
            which.append(open_[same])
            places.append(place[same])
            open_ = open_[~same]
        return (np.concatenate(which), np.concatenate(places)) if which else (open_[:0], open_[:0])

    def windows(self, text: str | None) -> Iterator[np.ndarray]:
        """Places of the kept n-grams that begin in each window; the windows cover every byte."""
        raw = raw_bytes(text)
        marks, at = None, 0
        for start, h in [*grams(raw), (len(raw), None)]:
            if marks is None or start != at:
                if marks is not None:
                    for k in range(len(marks) - 1):
                        yield np.flatnonzero(marks[k] | marks[k + 1])
                if h is None:
                    break
                size = -(-min(_WIDE, len(raw) - start) // HALF)
                last = marks[-1:] if marks is not None else np.zeros((0, len(self)), bool)
                marks, at = np.concatenate([last, np.zeros((size, len(self)), bool)]), start
            which, places = self.find(h)
            marks[which // HALF + len(last), places] = True
        if marks is not None and len(raw) <= HALF:
            yield np.flatnonzero(marks[0])

    def top(self, text: str | None, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Largest sum of weights that a window of the text has, and the places in that window."""
        best, of = -np.inf, np.zeros(0, np.int64)
        for places in self.windows(text):
            z = float(weights[places].sum())
            if z > best:
                best, of = z, places
        return (best if np.isfinite(best) else 0.0), of


@dataclass
class Model:
    """The kept n-grams, a weight for each (classifier weight times log-count ratio) and an intercept."""

    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """That of the most toxic window: neither more of the same text nor clean text around it counts."""
        z = self.vocabulary.top(text, self.weights)[0] + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratios(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``FEATURES`` n-grams that tell most, and the log of their smoothed odds of toxic texts over
    that of the sample. Those in fewer than three texts are left out. Counted in the tasks, summed by
    n-gram. None without texts of both kinds."""
    def tally(batches):
        held, n = [], 0

        def counted():
            names, inverse = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            toxic = np.concatenate([np.full(len(g), bool(y)) for g, y in held])
            pos = np.bincount(inverse[toxic], minlength=len(names))
            return pd.DataFrame({"gram": names, "pos": pos, "neg": np.bincount(inverse, minlength=len(names)) - pos})

        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                for g in distinct_grams(text):
                    held.append((g, y))
                    n += len(g)
                    if n > _HELD:
                        yield counted()
                        held.clear()
                        n = 0
        if held:
            yield counted()

    n = {y: c for y, c in sample.groupBy("y").count().collect()}
    if not (n.get(0) and n.get(1)):
        return np.zeros(0, np.int64), np.zeros(0)
    share = n[1] / (n[0] + n[1])
    parts = sample.mapInPandas(tally, "gram long, pos long, neg long")
    each = parts.groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    ratio = F.log((F.col("pos") + SMOOTHING * share) / (F.col("neg") + SMOOTHING * (1 - share))) - float(
        np.log(share / (1 - share)))
    got = each.select("gram", ratio.alias("ratio")).orderBy(F.abs("ratio").desc(), "gram").limit(FEATURES).toPandas()
    return got.gram.to_numpy(np.int64), got.ratio.to_numpy(float)


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, steps: int = 500, ridge: float = 0.005):
    """Weights of an L2-regularised logistic regression on scaled 0/1 features (accelerated descent)."""
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    val = scale[col]
    w, b = np.zeros(len(scale)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    norm = np.bincount(row, val * val, len(rows)).max(initial=1.0) + 1
    step = 4.0 / (norm + 4 * ridge)
    pw, pb = w.copy(), b
    for k in range(1, steps + 1):
        m = (k - 1) / (k + 2)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        z = np.bincount(row, val * vw[col], len(rows)) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(len(y), 1)
        pw, pb = w, b
        w = vw - step * (np.bincount(col, val * g[row], len(scale)) + ridge / max(len(y), 1) * vw)
        b = vb - step * float(g.sum())
    return w, b


def amid_clean(rows: list[np.ndarray], y: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The rows, one in ``FILLED`` of them filled up to a window's size with clean ones in turn.

    So the classifier learns that clean text around a passage tells nothing, also if the labelled
    texts are shorter than a window.
    """
    clean, k, out = np.flatnonzero(y == 0), 0, list(rows)
    for i in range(0, len(rows) if len(clean) else 0, FILLED):
        size, parts = int(sizes[i]), [rows[i]]
        while size < 2 * HALF:
            j = clean[k % len(clean)]
            parts.append(rows[j])
            size, k = size + int(sizes[j]) + 1, k + 1
        out[i] = np.unique(np.concatenate(parts)) if len(parts) > 1 else rows[i]
    return out


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column) -> DataFrame:
    """(text, y): at most FIT_ROWS labelled texts, the first in the order of a hash of the id."""
    y = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = checkpoint(y.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(FIT_ROWS))
    near = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    near = near.where(in_bitmap(bitmap(picked, "_h"), F.xxhash64("_id")))
    one = near.join(picked, "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))
    return checkpoint(one.where("text is not null").select("text", "y").repartition(12))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """A model from the labelled texts for which ``train`` (a condition on the label row) holds.

    A text teaches by its most toxic window, as the log-count ratios have it; its score is its most
    toxic window's too, so texts of any length are held to the same measure.
    Of a document's repeated labels the largest counts; null labels, ids and texts teach nothing. A
    document's repeated rows teach once. Without both labels, as with empty tables, the model scores every
    text alike, by the share of toxic rows. Only the named columns are read, so others may have any name.
    """
    sample = sampled(docs, labels, id_col, text_col, label_col, train)
    names, ratio = log_count_ratios(sample)
    vocabulary = Vocabulary(names)

    @F.pandas_udf(ArrayType(IntegerType()))
    def chosen(texts: pd.Series) -> pd.Series:
        return pd.Series([vocabulary.top(t, ratio)[1].astype(np.int32) for t in texts], dtype=object)

    got = sample.select("y", chosen("text").alias("f"), F.octet_length("text").alias("size"),
                        F.xxhash64("text").alias("h")).toPandas().sort_values(["h", "y"])
    y = got.y.to_numpy(float)
    rows = amid_clean([np.asarray(f, np.int64) for f in got.f], y, got["size"].to_numpy())
    w, bias = logistic(rows, y, ratio)
    return Model(vocabulary, w * ratio, bias)


def score(model: Model, text: Column) -> Column:
    """Probability that a whole text is toxic; null counts as empty. Of any length: a text is read window by window."""
    @F.pandas_udf(DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return of(text)


def in_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds
