"""Piece scores: scorers, softmax, arg-max, ensembles and the focal loss as a metric.

Score table layout (wide): ``(document, piece, p0 .. p12)`` with ``p<i>`` the probability of
label id ``i`` (``O`` is id 12). Wide columns keep every step a plain codegen'd projection.
"""

from __future__ import annotations

import binascii
import hashlib
import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bio import label_id
from ..functions.probs import pick
from ..schema import FOCAL_ALPHA_O, FOCAL_GAMMA, LOGIT_COLS, NUM_LABELS, O_ID, PROB_COLS


def hash_words(digits: pa.StringArray) -> pa.StructArray:
    """Bytes 0-6 and 7-12 of md5 hashes (32 hex digits each) as two integers ``a, b``."""
    n = len(digits)
    _, at, data = digits.buffers()
    first = np.frombuffer(at, np.int32, n + 1, 4 * digits.offset)[0] if n else 0
    raw = np.frombuffer(binascii.unhexlify(memoryview(data)[first:first + 32 * n] if n else b""), np.uint8).reshape(n, 16)
    out = np.zeros((2, n, 8), np.uint8)
    out[0, :, 1:], out[1, :, 2:] = raw[:, :7], raw[:, 7:13]
    a, b = out.view(">i8").astype(np.int64).reshape(2, n)
    return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: MD5: the constant and the rotation of each step.
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Keys hashed side by side: their sixteen words and what is made of them stay in a core's cache.
HASHED_AT_ONCE = 1 << 13


def _md5(words: np.ndarray) -> np.ndarray:
    """MD5 of ``n`` padded messages of one block each, given as ``[16, n]`` words: ``[4, n]``."""
    start = [np.full(words.shape[1], x, np.uint32) for x in _START]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += words[g]
        f += np.uint32(_SINES[i])
        left = f << np.uint32(_TURNS[i])
        f >>= np.uint32(32 - _TURNS[i])
        f |= left
        f += b
        a, d, c, b = d, c, b, f
    return np.stack([x + y for x, y in zip(start, (a, b, c, d))])


def hash_keys(keys: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes 0-6 and 7-12 of the keys' md5 hashes as two integers, as :func:`hash_words` reads them; keys of one block at once."""
    n = len(keys)
    _, at, data = keys.buffers()
    at = np.frombuffer(at, np.int32, n + 1, 4 * keys.offset).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if n and data is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    out = np.zeros((n, 4), np.uint32)
    for lo in range(0, n, HASHED_AT_ONCE):
        hi = min(lo + HASHED_AT_ONCE, n)
        held = size[lo:hi]
        if held.max() > 55:
            raw = [hashlib.md5(data[at[i]:at[i + 1]].tobytes(), usedforsecurity=False).digest() for i in range(lo, hi)]
            out[lo:hi] = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 4)
            continue
        block = np.zeros((hi - lo) * 64, np.uint8)
        heads = 64 * np.arange(hi - lo)
        block[np.arange(at[hi] - at[lo]) + np.repeat(heads - (at[lo:hi] - at[lo]), held)] = data[at[lo]:at[hi]]
        block[heads + held] = 128
        words = np.ascontiguousarray(block.view("<u4").reshape(-1, 16).T)
        words[14] = 8 * held
        out[lo:hi] = _md5(words).T
    raw = out.astype("<u4").view(np.uint8).reshape(n, 16)
    two = np.zeros((2, n, 8), np.uint8)
    two[0, :, 1:], two[1, :, 2:] = raw[:, :7], raw[:, 7:13]
    a, b = two.view(">i8").astype(np.int64).reshape(2, n)
    return a, b


def hash_columns(salt: str | None = None) -> tuple[str, str]:
    """Names of the columns in which pieces bring the two integers of their hash along."""
    return f"_a{salt or ''}", f"_b{salt or ''}"


def hash_logits(pieces: DataFrame, label_col: str = "word_label", salt: str | None = None,
                names: Sequence[str] = LOGIT_COLS, keep: Sequence[str] = ()) -> DataFrame:
    """The deterministic test scorer: logits from an md5 of ``doc:token:piece``.

    ``z_i = byte_i(md5) / 32 + 4 * [i is the piece's word label] + 2 * [i is O]``; every
    logit is a multiple of 1/32, so ties between labels are exact in any engine.
    ``label_col`` holds labels or label ids. ``salt`` prefixes the key (``'b'`` gives the second ensemble member). ``names`` are those of the logit
    columns, ``keep`` further columns to carry along. Pieces cut inside the documents' rows may bring the hash along
    (:func:`hash_columns`).
    """
    key = F.concat_ws(":", F.col("document").cast("string"), F.col("token").cast("string"),
                      F.col("piece").cast("string"))
    if salt is not None:
        key = F.concat(F.lit(f"{salt}:"), key)
    named = pieces.schema[label_col].dataType.typeName() == "string"
    lid = F.coalesce(label_id(F.coalesce(F.col(label_col), F.lit("O"))) if named else F.col(label_col), F.lit(O_ID))
    carried = [c for c in ("start", "end") if c in pieces.columns] + list(keep)
    # Bytes 0-6 and 7-12 of the hash as two integers, so each byte is a shift and a mask; a batch of hashes is read as
    # digits at once, as a conversion of two strings for each piece costs more than all the rest.
    a, b = hash_columns(salt)
    if a in pieces.columns:
        h = pieces.select("document", "piece", *carried, lid.alias("_y"), F.col(a).alias("_wa"), F.col(b).alias("_wb"))
    else:
        @F.arrow_udf("struct<a:bigint,b:bigint>")
        def words(digits: pa.Array) -> pa.Array:
            return hash_words(digits)

        h = pieces.select("document", "piece", *carried, F.md5(key).alias("_h"), lid.alias("_y"))
        h = h.select("document", "piece", *carried, "_y", words("_h").alias("_w"))
        h = h.select("*", F.col("_w.a").alias("_wa"), F.col("_w.b").alias("_wb"))
    zs = []
    for i in range(NUM_LABELS):
        word, shift = ("_wa", 8 * (6 - i)) if i < 7 else ("_wb", 8 * (12 - i))
        byte = F.shiftright(F.col(word), shift).bitwiseAND(F.lit(255))
        z = byte / F.lit(32.0) + F.when(F.col("_y") == i, 4.0).otherwise(0.0)
        if i == O_ID:
            z = z + F.lit(2.0)
        zs.append(z.alias(names[i]))
    # As from a generator, the logits are values to whatever comes next: no later filter or projection is
    # rewritten in terms of the hash. The generator reads a stored column (an expression would be interpreted)
    # and is the outer one (of the plain one, Spark asks below whether the array is empty, and hashes again).
    h = h.select("document", "piece", *carried, F.array(F.struct(*zs)).alias("_zs"))
    return h.select("document", "piece", *carried, F.inline_outer("_zs"))


def softmax_scores(logits: DataFrame, names: Sequence[str] = LOGIT_COLS, out: Sequence[str] = PROB_COLS) -> DataFrame:
    """Logit columns ``z0..z12`` -> probability columns ``p0..p12``; all other columns are carried.

    Staged as small projections (max, exps, sum, ratios) so each generated expression stays
    small and every intermediate is computed once per row.
    """
    keys = [c for c in logits.columns if c not in names]
    exps = [f"_e{i}" for i in range(NUM_LABELS)]
    x = logits.select(*keys, *names, F.greatest(*[F.col(c) for c in names]).alias("_m"))
    x = x.select(*keys, *[F.exp(F.col(z) - F.col("_m")).alias(e) for z, e in zip(names, exps)])
    total = F.col(exps[0])
    for e in exps[1:]:
        total = total + F.col(e)
    x = x.select(*keys, *exps, total.alias("_s"))
    return x.select(*keys, *[(F.col(e) / F.col("_s")).alias(p) for e, p in zip(exps, out)])


def live_logits(logits: DataFrame, threshold: float, names: Sequence[str] = LOGIT_COLS, besides: Column | None = None) -> DataFrame:
    """The pieces that can carry a label other than ``O`` at a threshold up to ``threshold``, and those ``besides`` holds for.

    A piece fires if its best label isn't ``O`` or ``p_O < t``, and ``p_O < t`` is the same as
    ``sum(exp(z_i - z_O)) > 1 / t - 1`` over the other labels: a test on the logits alone, before any softmax, alignment
    or sort. It keeps a hair more than fires (a rounding error's worth); the decoder's own test on
    probabilities stays the judge. Where even twelve times the largest term is too small, no power is taken.
    """
    others = [F.col(c) for i, c in enumerate(names) if i != O_ID]
    best, o = F.greatest(*others), F.col(names[O_ID])
    fires = best >= o
    if threshold > 0:
        need = (1.0 / threshold - 1.0) * (1 - 1e-9)
        total = F.exp(others[0] - o)
        for z in others[1:]:
            total = total + F.exp(z - o)
        if need <= 0:
            return logits
        fires = fires | ((best - o >= math.log(need / len(others)) - 1e-9) & (total >= need))
    return logits.where(fires if besides is None else fires | besides)


def may_beat_o(names: Sequence[str] = LOGIT_COLS) -> Column:
    """Whether a piece's arg-max can be another label than ``O``, told by its logits; a hair more than is."""
    others = [F.col(c) for i, c in enumerate(names) if i != O_ID]
    return F.greatest(*others) >= F.col(names[O_ID]) - 1e-9


def score_pieces(pieces: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Score pieces with a logit scorer (column-expression job) and softmax the result."""
    scorer = scorer or hash_logits
    return softmax_scores(scorer(pieces))


def score_with_model(pieces: DataFrame, load: Callable[[], Callable], feature_cols: Sequence[str],
                     outputs_logits: bool = True, streaming: bool = False) -> DataFrame:
    """Pluggable scorer of whole documents: ``load()`` gives ``predict``, run in ``mapInPandas``.

    ``load`` is called once per task, so a model travels as the recipe to load it. Pieces are dealt by
    document and sorted inside a task; the batches of a document follow one another, and no row holds a
    document. ``predict(frame)`` sees a whole document, in piece order, with the columns ``piece, start, end,
    *feature_cols``, and gives ``[pieces, 13]``. With ``streaming`` it is ``predict(frames)`` instead: an iterator
    of the document's frames in, an iterator of their scores out, so a document of any length passes in
    bounded memory. Returns ``(document, piece, start, end, p0..p12)``; logits are softmaxed.
    """
    names = LOGIT_COLS if outputs_logits else PROB_COLS
    given = ["piece", "start", "end", *[c for c in feature_cols if c not in ("piece", "start", "end")]]
    schema = T.StructType([pieces.schema[c] for c in ("document", "piece", "start", "end")]
                          + [T.StructField(n, T.DoubleType()) for n in names])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
        for batch in batches:
            ids = batch["document"].to_numpy()
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1 if len(ids) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if hi > lo:
                    yield ids[lo], batch[given].iloc[lo:hi].reset_index(drop=True)

    def labelled(document: object, frame: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        out = np.asarray(scores, dtype="float64")
        if out.shape != (len(frame), len(names)):
            raise ValueError(f"the model gave {out.shape} scores for {len(frame)} pieces")
        scored = frame[["piece", "start", "end"]].assign(document=document)
        return scored.assign(**{n: out[:, i] for i, n in enumerate(names)})[schema.fieldNames()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for document, group in itertools.groupby(parts(batches), key=lambda x: x[0]):
            frames = (frame for _, frame in group)
            if not streaming:
                whole = pd.concat(list(frames), ignore_index=True)
                yield labelled(document, whole, predict(whole))
                continue
            fed: list[pd.DataFrame] = []

            def feed() -> Iterator[pd.DataFrame]:
                for frame in frames:
                    fed.append(frame)
                    yield frame

            for scores in predict(feed()):
                yield labelled(document, fed.pop(0), scores)
            if fed or next(frames, None) is not None:
                raise ValueError(f"the model left pieces of document {document} without scores")

    dealt = pieces.select("document", *given).repartition("document").sortWithinPartitions("document", "piece")
    scored = dealt.mapInPandas(run, schema)
    return softmax_scores(scored) if outputs_logits else scored


def with_argmax(scores: DataFrame) -> DataFrame:
    """Add ``l_all`` (arg-max over all labels), ``l_no`` (over non-O labels), ``p_o``,
    ``p_all`` and ``p_no`` (probabilities of those labels). Ties -> lowest id."""
    non_o_ids = [i for i in range(NUM_LABELS) if i != O_ID]
    # One array and its maximum: a comparison chain over twelve columns is more code than is compiled.
    x = scores.withColumn("_no", F.array(*[F.col(PROB_COLS[i]) for i in non_o_ids]))
    x = x.withColumn("p_no", F.array_max("_no"))
    place = F.array_position("_no", F.col("p_no")).cast("int") - 1
    below = F.lit(0) if O_ID == NUM_LABELS - 1 else F.when(place >= O_ID, 1).otherwise(0)
    x = x.withColumn("l_no", (place + below).cast("int")).drop("_no")
    p_o, p_no = F.col(PROB_COLS[O_ID]), F.col("p_no")
    l_all = F.when(p_no > p_o, F.col("l_no")).when(p_no == p_o, F.least(F.col("l_no"), F.lit(O_ID))).otherwise(F.lit(O_ID))
    return x.select(*scores.columns, l_all.cast("int").alias("l_all"), "l_no", p_o.alias("p_o"),
                    F.greatest(p_no, p_o).alias("p_all"), "p_no")


def ensemble_scores(members: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean of several models' probabilities per ``(document, piece)``.

    ``sum(w * p) / sum(w)``; all members must cover the same pieces (checked: a piece that
    is not in each member exactly once raises). One aggregate keyed by document first, partial on the map
    side, so it reuses the corpus layout.
    """
    parts = [df.select("document", "piece", *PROB_COLS, F.lit(float(w)).alias("_w"),
                       F.lit(1 << i).cast("long").alias("_m")) for i, (df, w) in enumerate(members)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    agg = u.groupBy("document", "piece").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_or("_m").alias("_seen"), F.sum("_w").alias("_sw"),
        *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in PROB_COLS],
    )
    checked = agg.withColumn(
        "_sw",
        F.when((F.col("_n") == len(members)) & (F.col("_seen") == (1 << len(members)) - 1), F.col("_sw")).otherwise(
            F.raise_error(F.lit("ensemble members disagree on piece boundaries"))),
    )
    return checked.select("document", "piece", *[(F.col(c) / F.col("_sw")).alias(c) for c in PROB_COLS])


def ensemble_columns(scores: DataFrame, members: Mapping[str, float]) -> DataFrame:
    """Weighted mean of several models whose probabilities stand side by side on one piece row.

    ``members`` maps a column to a weight: the column holds a model's probabilities as an array (:func:`side_by_side`).
    The terms are added in the order of the column names, so the result doesn't depend on the order of
    the members, and no row is shuffled. Output ``(document, piece, p0..p12)``.
    """
    if not members:
        raise ValueError("an ensemble needs a member")
    order = sorted(members)
    total = float(sum(members[m] for m in order))

    def mean(i: int) -> Column:
        out = F.col(order[0])[i] * F.lit(float(members[order[0]]))
        for m in order[1:]:
            out = out + F.col(m)[i] * F.lit(float(members[m]))
        return out / F.lit(total)

    return scores.select("document", "piece", *[mean(i).alias(c) for i, c in enumerate(PROB_COLS)])


def side_by_side(scores: DataFrame, member: str) -> DataFrame:
    """``scores`` with the columns ``p0..p12`` folded into one array column ``member``.

    The array comes from a generator, so that a member's softmax is done before the next one's begins and
    isn't merged with what reads it.
    """
    rest = [c for c in scores.columns if c not in PROB_COLS]
    return scores.select(*rest, F.array(F.array(*PROB_COLS)).alias("_ps")).select(*rest, F.explode_outer("_ps").alias(member))


def _focal(p_y: Column, log_p_y: Column, miss: Column, y: Column, gamma: float, alpha: Sequence[float] | None) -> Column:
    if alpha is None:
        alpha = [1.0] * NUM_LABELS
        alpha[O_ID] = FOCAL_ALPHA_O
    a_y = F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), y + 1)
    return a_y * F.pow(miss, F.lit(float(gamma))) * -log_p_y


def _reduced(rows: DataFrame, reduction: str) -> DataFrame:
    if reduction not in ("mean", "sum", "none"):
        raise ValueError(f"unknown reduction {reduction!r}: give mean, sum or none")
    if reduction == "none":
        return rows
    agg = F.sum("loss") if reduction == "sum" else F.avg("loss")
    return rows.agg(F.coalesce(agg, F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("n_rows"))


def focal_loss_logits(logits: DataFrame, labels: DataFrame, gamma: float = FOCAL_GAMMA,
                      alpha: Sequence[float] | None = None, reduction: str = "mean",
                      ignore_index: int = -100) -> DataFrame:
    """:func:`focal_loss` from logits ``z0..z12``, by log-sum-exp: finite however unlikely the true label is.

    ``ln p_y = z_y - max - ln(sum(exp(z_i - max)))``; ``1 - p_y`` is taken as ``-expm1(ln p_y)``, so it keeps its digits
    where ``p_y`` is nearly 1.
    """
    rows = logits.join(labels.where(F.col("label_id") != ignore_index), ["document", "piece"], "inner")
    return focal_loss_labelled(rows, gamma, alpha, reduction, ignore_index)


def focal_loss_labelled(rows: DataFrame, gamma: float = FOCAL_GAMMA, alpha: Sequence[float] | None = None,
                        reduction: str = "mean", ignore_index: int = -100) -> DataFrame:
    """:func:`focal_loss_logits` of pieces that carry their ``label_id`` next to the logits: no join."""
    rows = rows.where(F.col("label_id") != ignore_index)
    zs = [F.col(c) for c in LOGIT_COLS]
    rows = rows.select("document", "piece", "label_id", *zs, F.greatest(*zs).alias("_m"))
    total = F.exp(zs[0] - F.col("_m"))
    for z in zs[1:]:
        total = total + F.exp(z - F.col("_m"))
    log_p = pick(zs, F.col("label_id")) - F.col("_m") - F.log(total)
    rows = rows.select("document", "piece", "label_id", log_p.alias("_log_p"))
    log_p = F.col("_log_p")
    loss = _focal(F.exp(log_p), log_p, -F.expm1(log_p), F.col("label_id"), gamma, alpha)
    return _reduced(rows.select("document", "piece", "label_id", loss.alias("loss")), reduction)


def focal_loss(scores: DataFrame, labels: DataFrame, gamma: float = FOCAL_GAMMA,
               alpha: Sequence[float] | None = None, reduction: str = "mean",
               ignore_index: int = -100) -> DataFrame:
    """Focal loss ``alpha[y] * (1 - p_y)^gamma * -ln(p_y)`` of scored pieces.

    ``labels``: ``(document, piece, label_id)``; rows labelled ``ignore_index`` are dropped.
    ``mean`` divides by the row count (0 when no row), ``sum`` adds, ``none`` returns rows. Where a probability
    may have been rounded to 0, take :func:`focal_loss_logits`.
    """
    p_y = pick([F.col(c) for c in PROB_COLS], F.col("label_id"))
    # ln(0) is null in SQL; a true class of probability 0 is an infinite loss, not a dropped row.
    log_p = F.when(p_y > 0, F.log(p_y)).otherwise(F.lit(float("-inf")))
    rows = scores.join(labels.where(F.col("label_id") != ignore_index), ["document", "piece"], "inner")
    loss = _focal(p_y, log_p, 1.0 - p_y, F.col("label_id"), gamma, alpha)
    return _reduced(rows.select("document", "piece", "label_id", loss.alias("loss")), reduction)
