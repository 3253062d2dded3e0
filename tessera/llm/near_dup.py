"""Near duplicates by an inverted join over MinHash coordinates."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType

from tessera.llm.common import bitmap, checkpoint, in_bitmap, row_key
from tessera.llm.components import connected_components
from tessera.llm.shingles import WIDTH, mix64, shingle_set

#: Signature coordinates, and collisions that a pair needs to be checked in full. At similarity
#: 0.75 a pair has 48 collisions on average and misses 32 once in some 200,000 pairs.
COORDS = 64
MATCHES = 32
PREFIX = COORDS - MATCHES + 1
THRESHOLD = 75
#: Keys with more cross pairs than this for each member are joined by shingles instead.
PAIRS_PER_POSTING = 4
#: Counters of the value frequencies that order coordinates by rarity: a fixed 256 KB.
COUNTERS = 1 << 16

_A = mix64(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, 1001 + COORDS, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of ``COORDS`` hash functions over a shingle set (32-bit values)."""
    out = np.full(COORDS, np.uint64(0xFFFFFFFF), np.uint64)
    for at in range(0, len(shingles), 2048):
        part = (shingles[at:at + 2048, None] * _A + _B) >> np.uint64(32)
        out = np.minimum(out, part.min(axis=0))
    return out.astype(np.uint32)


def counter_of(signatures: np.ndarray) -> np.ndarray:
    """Frequency counter of every (coordinate, value) of a matrix of signatures."""
    keyed = signatures.astype(np.uint64) + (np.arange(COORDS, dtype=np.uint64) << np.uint64(32))
    return (mix64(keyed) % np.uint64(COUNTERS)).astype(np.int64)


SKETCH = StructType().add("n_shingles", LongType()).add("fp", BinaryType()).add("sig", BinaryType())


@F.pandas_udf(SKETCH)
def sketch(texts: pd.Series) -> pd.DataFrame:
    """Set size, 128-bit fingerprint of the shingle set and signature of each whole text."""
    rows = []
    for text in texts:
        s = shingle_set(text)
        rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (0, None, None))
    return pd.DataFrame(rows, columns=["n_shingles", "fp", "sig"])


def matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDS)


def value_counts(classes: DataFrame) -> np.ndarray:
    """Rows per frequency counter, summed on the executors; ``COUNTERS`` numbers reach the driver."""
    def tally(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            if len(b):
                total += np.bincount(counter_of(matrix(b["sig"])).ravel(), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"counter": at, "n": total[at]})

    rows = classes.select("sig").mapInPandas(tally, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    for counter, n in rows.collect():
        out[counter] = n
    return out


def prefix_keys(counts: np.ndarray):
    """UDF: the ``PREFIX`` rarest (coordinate, value) pairs of a signature, as longs.

    Two signatures with MATCHES common coordinates share one of these, whatever the total order;
    rarity keeps values of widely shared passages out of the prefix.
    """
    seen = counts

    @F.pandas_udf(ArrayType(LongType()))
    def keys(sigs: pd.Series) -> pd.Series:
        if not len(sigs):
            return pd.Series([], dtype=object)
        m = matrix(sigs)
        at = counter_of(m)
        order = np.lexsort((m, at, seen[at]), axis=-1)[:, :PREFIX]
        keyed = m.astype(np.int64) + (np.arange(COORDS, dtype=np.int64) << 32)
        return pd.Series(list(np.take_along_axis(keyed, order, axis=1)), dtype=object)

    return keys


@F.pandas_udf(ArrayType(LongType()))
def shingles_of(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts], dtype=object)


@F.pandas_udf(BooleanType())
def enough_collisions(a: pd.Series, b: pd.Series) -> pd.Series:
    """At least MATCHES equal coordinates, by the low byte of each: it may count one too many."""
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, COORDS) for s in (a, b))
    return pd.Series((x == y).sum(axis=1) >= MATCHES)


@F.pandas_udf(BinaryType())
def low_bytes(sigs: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in sigs], dtype=object)


@lru_cache(maxsize=64)
def _cached_set(text: str) -> np.ndarray:
    return shingle_set(text)


@F.pandas_udf(BooleanType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact test on the full shingle sets: 100 * common >= THRESHOLD * union."""
    out = []
    for x, y in zip(a, b):
        p, q = _cached_set(x), _cached_set(y)
        common = np.intersect1d(p, q, assume_unique=True).size
        out.append(100 * common >= THRESHOLD * (len(p) + len(q) - common))
    return pd.Series(out, dtype=bool)


def postings(classes: DataFrame) -> DataFrame:
    """(key, node, n, shared): the prefix coordinates that at least two classes share, and how many of them a class has."""
    keys = prefix_keys(value_counts(classes))
    posts = classes.select("node", F.col("n_shingles").cast("int").alias("n"), F.explode(keys("sig")).alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    held = F.count(F.lit(1)).over(Window.partitionBy("node")).cast("int")
    return checkpoint(posts.join(shared, "key").withColumn("shared", held))


def may_link(n: Column, m: Column, common: Column) -> Column:
    """Whether sets of sizes n and m with at most ``common`` common members can be similar."""
    return (100 + THRESHOLD) * common >= THRESHOLD * (n + m)


def star_pairs(posts: DataFrame, hubs: list[Column]) -> DataFrame:
    """Each class of a key paired with the key's classes of smallest value of each of ``hubs``: at most as
    many pairs as postings, for each."""
    least = [F.min(F.struct(hub.alias("o"), "node", "n")) for hub in hubs]
    of_key = posts.groupBy("key").agg(F.array(*least).alias("hubs"))
    met = posts.join(of_key, "key").select("node", "n", F.explode("hubs").alias("h"))
    pairs = met.where("node <> h.node").where(may_link(F.col("n"), F.col("h.n"), F.least("n", "h.n")))
    return pairs.select(F.least("h.node", "node").alias("a"), F.greatest("h.node", "node").alias("b")).distinct()


def hub_orders(shared: Column | None = None) -> list[Column]:
    """By which a key's two hubs are the smallest. Neither looks at the key, so that the keys which a group of copies
    shares have the same hubs, and a copy is paired with two classes instead of one for each key.

    With ``shared``, how many coordinates a class shares, the first hub is the class with most of them. What near copies were
    made from shares all of its own, while a copy has some from its own edits: it is more similar to each copy than
    they are to one another, so fewer are left for the comparison of all pairs.
    """
    return [F.col("node") if shared is None else -shared.cast("long"), F.xxhash64("node")]


def shingle_pairs(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of ``nodes(node, comp, n)`` in different components that pass the exact prefix filter.

    A class's shingles stand in order of rarity among these classes, those of its own first. A
    similar pair shares one of the first n - ceil(0.75 n) + 1, and its first common shingle leaves
    enough after it on both sides (position and length bounds). One row per shingle of these
    classes is shuffled; counts are folded before the shuffle.
    """
    at = nodes.join(classes.select("node", "tk"), "node")
    asked = texts.where(in_bitmap(bitmap(at, "tk.a"), F.col("tk.a")))
    full = asked.groupBy("tk").agg(F.first("text").alias("text")).join(at, "tk")
    each = full.select("node", "comp", "n", F.explode(shingles_of("text")).alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    shared = F.count(F.lit(1)).over(own)
    rank = F.row_number().over(own.orderBy("df", "key"))
    posts = each.join(often, "key").withColumn("pos", F.col("n") - shared + rank - 1)
    posts = checkpoint(posts.where(100 * (F.col("n") - F.col("pos")) >= THRESHOLD * F.col("n")).drop("df"))
    met = posts.groupBy("key").agg(F.min("n").alias("n_min"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    p = posts.join(met.where("lo < hi").select("key", "n_min"), "key").where(
        may_link(F.col("n"), F.col("n_min"), F.col("n") - F.col("pos"))).drop("n_min")
    x, y = p.alias("x"), p.alias("y")
    fits = may_link(F.col("x.n"), F.col("y.n"), F.least(F.expr("x.n - x.pos"), F.expr("y.n - y.pos")))
    pairs = x.join(y, F.expr("x.key = y.key and x.node < y.node and x.comp <> y.comp") & fits)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def cross_pairs(posts: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs of classes in different components that share a key and could be similar.

    Keys with many cross pairs hold texts that share a passage or a template. All pairs of such
    crowded classes come from the exact shingle join, so no other key pairs two of them.
    """
    work = posts.groupBy("key", "comp").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key").agg(
        F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).where("s * s > q")
    heavy = F.expr(f"(s * s - q) / 2 > {PAIRS_PER_POSTING} * s")
    p = checkpoint(posts.join(work.select("key", heavy.alias("heavy")), "key"))
    crowded = checkpoint(p.where("heavy").select("node", "comp", "n").distinct())
    light = p.where("not heavy").join(crowded.select("node", F.lit(True).alias("by_shingles")), "node", "left")
    x, y = light.alias("x"), light.alias("y")
    fits = may_link(F.col("x.n"), F.col("y.n"), F.least("x.n", "y.n"))
    met = x.join(y, F.expr("x.key = y.key and x.node < y.node and x.comp <> y.comp "
                           "and (x.by_shingles is null or y.by_shingles is null)") & fits)
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    # Pairs of the shingle join are exact candidates: their signatures have no say.
    return colliding(met, classes).unionByName(shingle_pairs(crowded, classes, texts)).distinct()


def colliding(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs with MATCHES collisions over all coordinates."""
    def with_side(p: DataFrame, side: str) -> DataFrame:
        return p.join(classes.select(F.col("node").alias(side), F.col("low").alias(f"low_{side}")), side)

    return with_side(with_side(pairs, "a"), "b").where(enough_collisions("low_a", "low_b")).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar.

    ``texts(tk, text)`` is the whole input; a bitmap of the text keys in question keeps the other
    texts out of the shuffle.
    """
    def with_key(p: DataFrame, side: str) -> DataFrame:
        return p.join(classes.select(F.col("node").alias(side), F.col("tk").alias(f"tk_{side}")), side)

    met = checkpoint(with_key(with_key(pairs, "a"), "b").select("a", "b", "tk_a", "tk_b"))
    near = texts.where(in_bitmap(bitmap(met, "tk_a.a") | bitmap(met, "tk_b.a"), F.col("tk.a")))
    b = met.join(near.select(F.col("tk").alias("tk_b"), F.col("text").alias("text_b")), "tk_b")
    both = b.join(near.select(F.col("tk").alias("tk_a"), F.col("text").alias("text_a")), "tk_a")
    return both.where(similar("text_a", "text_b")).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_shingles, component_id, kept) for every row of ``df``.

    Texts are linked when the sets of their distinct five-word shingles have a Jaccard similarity
    of 0.75 or more; ``component_id`` is the smallest id reachable. Texts of equal sets form one
    class. Each class posts the rarest ``PREFIX`` of its ``COORDS`` MinHash coordinates, which any
    pair with ``MATCHES`` collisions must share one of; collisions over the whole signature are
    counted for the pairs found, and the full sets decide. The classes of a posting are first
    linked with two of them, its hubs; then all pairs of a posting that lie in different
    components are compared, so a group of copies costs about as many pairs as it has members.

    Null and empty texts have no shingles and are linked with nothing. A null id never becomes
    ``component_id`` unless the component has no other. Repeated rows of one id are kept or dropped
    alike. An empty table gives an empty result. Only the two columns are read.
    """
    tk = row_key(id_col, text_col)
    rows = df.select(F.col(id_col).alias("id"), tk.alias("tk"), sketch(F.col(text_col)).alias("s"))
    rows = checkpoint(rows.select("id", "tk", "s.*"))
    grouped = rows.where("fp is not null").groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tk")).alias("first"),
        F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = checkpoint(grouped.select(
        F.monotonically_increasing_id().alias("node"), "fp", "n_shingles", "sig", low_bytes("sig").alias("low"),
        F.col("first.id").alias("id"), F.col("first.tk").alias("tk")))
    texts = df.select(tk.alias("tk"), F.col(text_col).alias("text"))
    posts = postings(classes)
    hubs = star_pairs(posts, hub_orders(F.col("shared")))
    stars = connected_components(checkpoint(verified(colliding(hubs, classes), classes, texts)))
    left = checkpoint(posts.join(stars, "node", "left").select(
        "key", "node", "n", F.coalesce("component", "node").alias("comp")))
    linked = stars.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = connected_components(linked.unionByName(verified(cross_pairs(left, classes, texts), classes, texts)))
    named = classes.join(labels, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("comp"), "id")
    lowest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = named.select("fp", "comp").join(lowest, "comp").select("fp", "component_id")
    linked = rows.where("fp is not null").select("id", F.col("tk").alias("key"), "n_shingles", "fp").join(of_class, "fp").drop("fp")
    alone = rows.where("fp is null").select("id", F.col("tk").alias("key"), "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
