"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint
from tessera.llm.shingles import mix64

#: Words of a class of the most frequent words, and the number of such classes.
WIDTH, CLASSES = 64, 32
HEAD = WIDTH * CLASSES
#: All other words, seen or not, belong to one of so many classes by their spelling.
TAILS = 32
#: Words whose counts travel with the model, at most. All others meet their counts in a join.
TABLE = 1 << 18
#: Rows of weights of each layer: features are hashed to them.
ROW_BITS = 14
#: The training documents are dealt over so many rounds of gradient updates.
ROUNDS = 2
BATCH = 4096
#: Training tokens for each task of a round at least: a task hands on 8.6 MB, however little it read.
TOKENS_A_TASK = 1 << 19
#: Tasks' updates that one task of the summing tree adds up.
FAN_IN = 16
RATE = 0.5
#: Logits are cut there, so that their powers stay finite.
TOP = 60.0
#: Bytes looked at in one go, except for a longer word.
CHUNK = 1 << 20
#: Distinct words counted in a task before their sums are handed on.
_HELD = 1 << 21
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: No UTF-8 text holds this byte, so no word is equal to the end.
_END = b" \xff "
_BASE = 0x9E3779B97F4A7C15
_LOG10 = float(np.log(10))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.uint64(1)
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(1 << bits, np.uint64(base))
        p[0] = one
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, spelling class by the last two bytes) of every word of lower-cased bytes, in order."""
    b = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _powers(max(21, len(b).bit_length()))
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:len(b)], out=upto[1:])
    h = mix64((upto[end] - upto[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    last = b[end - 1].astype(np.uint64) << np.uint64(8) | b[np.maximum(end - 2, start)]
    return h, (mix64(last) >> np.uint64(32)).astype(np.int64) % TAILS


END = int(hashed_words(_END)[0][0])


def stream(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of the tokens of all texts: (text number, word, spelling class, word before, its class,
    word before that, its class), whole texts in turn, each closed by one end.

    Before the first word of a text stand ends. A long text is cut at white space; the next chunk knows
    the two words before it.
    """
    held, size, first = [], 0, 0
    before = (np.array([END, END], np.uint64), np.zeros(2, np.int64))

    def flush():
        nonlocal before, first
        h, tail = hashed_words(b"".join(held).lower())
        h, tail = np.concatenate([before[0], h]), np.concatenate([before[1], tail])
        ends = h == np.uint64(END)
        number = first + np.cumsum(ends[2:]) - ends[2:]
        first = int(number[-1] + ends[-1]) if len(number) else first
        before = (h[-2:], tail[-2:])
        fresh = ends[1:-1]
        return (number, h[2:], tail[2:], h[1:-1], tail[1:-1], np.where(fresh, np.uint64(END), h[:-2]),
                np.where(fresh, 0, tail[:-2]))

    for text in texts:
        raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
        while at is not None:
            cut = _GAP.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
            held.append(raw[at:cut.start() + 1] if cut else raw[at:] + _END)
            size += len(held[-1])
            at = cut.start() + 1 if cut else None
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


@dataclass
class Vocabulary:
    """Counts of the most frequent words and sums over all words: of fixed size, however many words there are."""

    words: np.ndarray
    counts: np.ndarray
    #: Training tokens and distinct words in all, and of each spelling class without the words of the head.
    tokens: int
    distinct: int
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """Tables of places by slot, the most frequent words first; what finds its slot taken goes to the next."""
        out, rest = [], np.arange(len(self.words))
        while len(rest):
            slots, at = np.unique(self._slot(self.words[rest], len(out)), return_index=True)
            table = np.full(1 << 20, -1, np.int32)
            table[slots] = rest[at]
            out.append(table)
            rest = np.delete(rest, at)
        return out

    @staticmethod
    def _slot(h: np.ndarray, level: int) -> np.ndarray:
        return ((h * np.uint64(2 * level + 1)) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word by falling count, -1 if it isn't in the table."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, table in enumerate(self.levels):
            at = table[self._slot(h[left], level)]
            left, at = left[at >= 0], at[at >= 0]
            same = self.words[at] == h[left]
            out[left[same]] = at[same]
            left = left[~same]
        return out

    @cached_property
    def base(self) -> np.ndarray:
        """log10 of the add-one probability of each word of the table; the last is that of an unseen word."""
        return np.log10((np.append(self.counts, 0) + 1.0) / (self.tokens + self.distinct + 1.0))

    @cached_property
    def class_prior(self) -> np.ndarray:
        """Log of the smoothed share of each class: head classes, then spelling classes with one unseen word each."""
        head = np.zeros(HEAD)
        head[:len(self.counts[:HEAD])] = self.counts[:HEAD] + 1.0
        mass = np.concatenate([head.reshape(CLASSES, WIDTH).sum(axis=1), self.tail_tokens + self.tail_distinct + 1.0])
        with np.errstate(divide="ignore"):
            return np.log(mass / mass.sum()).astype(np.float32)

    @cached_property
    def word_prior(self) -> np.ndarray:
        """Log of the smoothed share of each word in its class of the head; minus infinity where there is no word."""
        head = np.zeros(HEAD)
        head[:len(self.counts[:HEAD])] = self.counts[:HEAD] + 1.0
        head = head.reshape(CLASSES, WIDTH)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.log(head / head.sum(axis=1, keepdims=True)), nan=-np.inf, neginf=-np.inf).astype(np.float32)

    def tail(self, tails: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the share of a word of so many occurrences in its spelling class."""
        return np.log10((counts + 1.0) / (self.tail_tokens[tails] + self.tail_distinct[tails] + 1.0))


def _rows(kind: int, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = a.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.asarray(b).astype(np.uint64) * np.uint64(_BASE)
        return (mix64(key + np.uint64(kind) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - ROW_BITS)).astype(np.int64)


@dataclass
class Layer:
    """Hashed weights: a row of logits for each hashed feature, and the squared gradients it has seen."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << ROW_BITS, WIDTH), np.float32))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1 << ROW_BITS, np.float32))

    def powers(self, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
        """exp of a batch's logits: the prior and the rows of its features."""
        n = len(rows[0])
        if len(_room) < 2 or len(_room[0]) < n:
            _room[:] = [np.empty((max(n, BATCH), WIDTH), np.float32) for _ in range(2)]
        z, more = _room[0][:n], _room[1][:n]
        np.take(self.weights, rows[0], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            z += np.take(self.weights, r, axis=0, out=more, mode="clip")
        z += prior
        return np.exp(np.minimum(z, TOP, out=z), out=z)

    def log_share(self, rows: list[np.ndarray], prior: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log of the softmax of a batch at the targets."""
        z = self.powers(rows, prior)
        return np.log(z[np.arange(len(z)), target].astype(np.float64) / (z @ np.ones(WIDTH, np.float32)))

    def update(self, rows: list[np.ndarray], prior: np.ndarray, target: np.ndarray) -> None:
        """One gradient step on a batch; steps shrink with the squared gradients of a row (AdaGrad)."""
        z = self.powers(rows, prior)
        z /= (z @ np.ones(WIDTH, np.float32))[:, None]
        z[np.arange(len(z)), target] -= 1
        at = np.concatenate(rows).astype(np.uint16)
        order = np.argsort(at, kind="stable")
        at = at[order]
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        step, of = _sums(z[order % len(z)], new), at[new]
        self.seen[of] += np.einsum("ij,ij->i", step, step)
        step *= RATE / np.sqrt(self.seen[of] + 1e-6)[:, None]
        self.weights[of] -= step


_room: list[np.ndarray] = []


def _sums(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``rows`` that begin at ``new``."""
    times = np.diff(np.append(new, len(rows)))
    out, k, left = rows[new], 1, np.flatnonzero(times > 1)
    while len(left) and k < 8:
        out[left] += rows[new[left] + k]
        k += 1
        left = left[times[left] > k]
    for i in left.tolist():
        out[i] += rows[new[i] + k:new[i] + times[i]].sum(axis=0)
    return out


@dataclass
class Model:
    """P(word | history) = P(class | history) * P(word | class, history).

    Classes are those of the head (``WIDTH`` words of like frequency each) and the spelling classes.
    Both factors are softmaxes over a smoothed prior and hashed features: the word before, the word
    two before (skip), and both together. In a spelling class a word's share is its add-one share.
    """

    vocabulary: Vocabulary
    classes: Layer = field(default_factory=Layer)
    words: Layer = field(default_factory=Layer)

    def features(self, chunk: tuple[np.ndarray, ...]):
        """(place, class, rows of the class layer, rows of the word layer) of the tokens of a chunk."""
        _, h, tail, h1, t1, h2, t2 = chunk
        v = self.vocabulary
        # The word before a token is the token before, except where a chunk or a text begins.
        known = lambda w, t: np.where((p := v.find(w)) >= 0, np.where(p < HEAD, p, HEAD + t), HEAD + t)
        place = v.find(h)
        me = np.where((place >= 0) & (place < HEAD), place, HEAD + tail)
        one, two = np.empty_like(me), np.empty_like(me)
        one[1:], two[2:] = me[:-1], me[:-2]
        one[:1], two[:2] = known(h1[:1], t1[:1]), known(h2[:2], t2[:2])
        fresh = np.flatnonzero(h1 == np.uint64(END))
        if len(fresh):
            two[fresh] = known(h2[fresh[:1]], t2[fresh[:1]])[0]
        cls = np.where(me < HEAD, me // WIDTH, CLASSES + me - HEAD)
        rows = [_rows(1, one), _rows(2, two), _rows(3, one, two)]
        inner = [_rows(4 + k, r, cls) for k, r in enumerate(rows)]
        return place, me, cls, rows, inner

    def learn(self, texts: Iterable[str | None]) -> None:
        v = self.vocabulary
        for chunk in stream(texts):
            _, me, cls, rows, inner = self.features(chunk)
            head = np.flatnonzero(me < HEAD)
            for at in range(0, len(me), BATCH):
                part = slice(at, at + BATCH)
                self.classes.update([r[part] for r in rows], v.class_prior, cls[part])
            for at in range(0, len(head), BATCH):
                part = head[at:at + BATCH]
                self.words.update([r[part] for r in inner], v.word_prior[cls[part]], me[part] % WIDTH)

    def log10(self, chunk: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(place, log10 probability) of the tokens of a chunk; without the share in a spelling class
        where the word isn't in the table."""
        place, me, cls, rows, inner = self.features(chunk)
        out = np.empty(len(me))
        v = self.vocabulary
        for at in range(0, len(me), BATCH):
            part = slice(at, at + BATCH)
            out[part] = self.classes.log_share([r[part] for r in rows], v.class_prior, cls[part])
        head = np.flatnonzero(me < HEAD)
        for at in range(0, len(head), BATCH):
            part = head[at:at + BATCH]
            out[part] += self.words.log_share([r[part] for r in inner], v.word_prior[cls[part]], me[part] % WIDTH)
        out /= _LOG10
        listed = np.flatnonzero(place >= HEAD)
        out[listed] += v.tail(chunk[2][listed], v.counts[place[listed]])
        return place, out


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0

    def summed() -> pd.DataFrame:
        words, at, inverse = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
        n = np.zeros(len(words), np.int64)
        np.add.at(n, inverse, np.concatenate([x[2] for x in held]))
        return pd.DataFrame({"word": words.view(np.int64), "tail": np.concatenate([x[1] for x in held])[at], "n": n})

    for batch in batches:
        for _, h, tail, *_ in stream(batch["text"]):
            words, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((words, tail[at], n))
            size += len(words)
            if size > _HELD:
                got = summed()
                held, size = [(got["word"].to_numpy().view(np.uint64), got["tail"].to_numpy(), got["n"].to_numpy())], len(got)
                if size > _HELD // 2:
                    yield got
                    held, size = [], 0
    if held:
        yield summed()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, tail, n): occurrences of each distinct word (by its 64-bit hash) in ``texts(text)``, ends included.

    Counted in the tasks, summed by word. Two words of one hash would count as one word.
    """
    each = texts.select("text").mapInPandas(_tally, "word long, tail int, n long")
    return each.groupBy("word").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The fixed-size part of the counts: the most frequent words, ``TABLE`` at most, and sums.

    Words are taken by a bound on their count, found from a histogram of counts (some hundred rows),
    so no task sorts or gathers the words.
    """
    grade = F.floor(F.log2("n") * 8).cast("int")
    graded = counts.groupBy(grade.alias("grade"), "tail").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).toPandas()
    by = graded.groupby("grade").words.sum().sort_index(ascending=False).cumsum()
    enough = by[by <= TABLE]
    if len(enough):
        top = counts.where(grade >= int(enough.index.min())).select("word", "tail", "n").toPandas()
    else:
        top = pd.DataFrame({"word": np.zeros(0, np.int64), "tail": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    top = top.sort_values(["n", "word"], ascending=[False, True])
    head = top.iloc[:HEAD]
    sums = lambda frame, what: np.bincount(frame["tail"].to_numpy(np.int64), what, minlength=TAILS)
    return Vocabulary(
        top["word"].to_numpy(np.int64).view(np.uint64).copy(), top["n"].to_numpy(np.int64).copy(),
        int(graded["n"].sum()), int(graded["words"].sum()),
        sums(graded, graded["n"].to_numpy(float)) - sums(head, head["n"].to_numpy(float)),
        sums(graded, graded["words"].to_numpy(float)) - sums(head, np.ones(len(head))))


def _merged(model: Model, sums: list[np.ndarray] | None) -> Model:
    """The model moved by the tasks' updates: rows move by the mean of the tasks that saw them, weighted by
    the squared gradients that each of them saw."""
    if sums is None:
        return model
    out = []
    for layer, (moved, weight, energy) in zip((model.classes, model.words), (sums[:3], sums[3:])):
        by = np.maximum(weight, 1e-12)
        out.append(Layer(layer.weights + moved / by[:, None], layer.seen + energy / by))
    return Model(model.vocabulary, *out)


def tree_sum(parts: RDD) -> list[np.ndarray] | None:
    """Sum of an RDD of lists of arrays, by a tree over the executors: a task sums ``FAN_IN`` of them at most,
    and one reaches the driver, however many tasks there were."""
    add = lambda a, b: [x + y for x, y in zip(a, b)]
    n = parts.getNumPartitions()
    while n > 1:
        n = -(-n // FAN_IN)
        parts = parts.mapPartitionsWithIndex(lambda i, it, n=n: ((i % n, x) for x in it)).reduceByKey(add, n).values()
    got = parts.collect()
    return functools.reduce(add, got) if got else None


def train(texts: DataFrame, vocabulary_: Vocabulary, rounds: int = ROUNDS) -> Model:
    """A model that has seen every row of ``texts(deal, text)`` once: ``deal`` says in which round.

    In a round each task takes gradient steps over its rows from the shared weights and hands on what
    it changed; the changes are summed in a tree over the executors. What a task hands on has a fixed
    size, so the number of tasks follows the training tokens, however finely the input is cut.
    """
    model = Model(vocabulary_)
    texts = texts.coalesce(max(1, -(-vocabulary_.tokens // (rounds * TOKENS_A_TASK))))
    for turn in range(rounds):
        start = model

        def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Model(start.vocabulary, *[Layer(x.weights.copy(), x.seen.copy()) for x in (start.classes, start.words)])
            own.learn(t for batch in batches for t in batch["text"])
            out = []
            for old, new in ((start.classes, own.classes), (start.words, own.words)):
                energy = new.seen - old.seen
                out += [(new.weights - old.weights) * energy[:, None], energy, energy * energy]
            yield pd.DataFrame({"sums": [pickle.dumps(out, 5)]})

        mine = texts.where(F.col("deal") == turn).select("text").mapInPandas(steps, "sums binary").rdd
        model = _merged(start, tree_sum(mine.map(lambda r: pickle.loads(r.sums))))
    return model


def scored(model: Model, text: Column) -> Column:
    """Struct of a whole text's ``n_tokens``; ``n_known``, ``base`` and ``score`` without what depends on the
    counts of words outside the table; and the distinct words outside it with their spelling classes and times."""
    @F.pandas_udf("n_tokens long, n_known long, base double, score double, "
                  "words array<long>, tails array<int>, times array<int>")
    def score(texts: pd.Series) -> pd.DataFrame:
        n, v = len(texts), model.vocabulary
        sums = {"n_tokens": np.zeros(n, np.int64), "n_known": np.zeros(n, np.int64), "base": np.zeros(n), "score": np.zeros(n)}
        outside = []
        for chunk in stream(texts):
            number = chunk[0]
            if not len(number):
                continue
            place, logs = model.log10(chunk)
            listed = place >= 0
            some = slice(int(number[0]), int(number[-1]) + 1)
            for name, each in (("n_tokens", None), ("n_known", listed), ("base", np.where(listed, v.base[place], 0)), ("score", logs)):
                sums[name][some] += np.bincount(number - number[0], each).astype(sums[name].dtype)
            outside.append((number[~listed], chunk[1][~listed].view(np.int64), chunk[2][~listed]))
        number, words, tails = (np.concatenate(x) for x in zip(*outside)) if outside else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((words, number))
        number, words, tails = number[order], words[order], tails[order]
        new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (words[1:] != words[:-1])])[:len(number)])
        times = np.diff(np.append(new, len(number))).astype(np.int32)
        cuts = np.searchsorted(number[new], np.arange(1, n))
        split = lambda x: list(np.split(x, cuts)) if n else []
        return pd.DataFrame(sums | {"words": split(words[new]), "tails": split(tails[new].astype(np.int32)), "times": split(times)})

    return score(text)


def language_model_scores(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``; the rows where
    ``learn`` is true are learnt from, all of them.

    Tokens are the words between ASCII white space with A-Z lower-cased, then one end. ``base_score``
    sums log10((c + 1) / (N + V + 1)) over a text's tokens: c is the token's count, N and V all and
    distinct training tokens; ``n_known`` counts the tokens with c > 0, ``train_tokens`` is N.
    ``score`` is log10 of the text's probability under :class:`Model`, a distribution over all
    training words and one unseen word for each spelling class.

    The counts of all words are summed by a shuffle and written down. The ``TABLE`` most frequent
    words travel with the model (a fixed size); every other word of a text meets its count in a join
    by word. Training passes over every training row once, in ``ROUNDS`` rounds of gradient updates.

    Null and empty texts have one token, the end. Repeated rows are rows of their own, also in
    training. Without training rows N is 0, ``base_score`` 0 and the model uniform. An empty table
    gives an empty result. Only the two columns (and those of ``learn``) are read; words are named by a
    64-bit hash, so two words of one hash share a count.
    """
    text = F.col(text_col).alias("text")
    taught = df.where(F.coalesce(learn, F.lit(False)))
    counts = checkpoint(word_counts(taught.select(text)))
    v = vocabulary(counts)
    model = train(taught.select(F.pmod(F.xxhash64(id_col), F.lit(ROUNDS)).alias("deal"), text), v)
    seen = df.select(F.col(id_col).alias("id"), scored(model, text).alias("s"))
    seen = checkpoint(seen.select(F.monotonically_increasing_id().alias("row"), "id", "s.*"))
    rare = seen.select("row", F.inline(F.arrays_zip("words", "tails", "times"))).withColumnsRenamed({"words": "word", "tails": "tail"})
    # Words of the table are never asked for.
    rest = counts.where(F.col("n") < int(v.counts.min(initial=1 << 62))).select("word", "n")
    n = F.coalesce("n", F.lit(0))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(v.tail_tokens + v.tail_distinct + 1.0)]), F.col("tail") + 1)
    late = rare.join(rest, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(n + 1) - float(np.log10(v.tokens + v.distinct + 1.0)))).alias("more_base"),
        F.sum(F.col("times") * (F.log10(n + 1) - share)).alias("more_score"))
    both = seen.drop("words", "tails", "times").join(late, "row", "left")
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.select("id", "n_tokens", total("n_known", "more_known").alias("n_known"),
                       F.lit(v.tokens).cast("long").alias("train_tokens"), total("base", "more_base").alias("base_score"),
                       total("score", "more_score").alias("score"))
