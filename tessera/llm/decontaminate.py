"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tessera.llm.common import bitmap, bitmap_hits, checkpoint, row_key
from tessera.llm.shingles import rolled, word_hashes

WINDOW = 10
#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 3

#: Bytes of words: digits, a-z and all of UTF-8 beyond ASCII. A-Z are lower-cased, the rest parts words.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def tokens_of(words: list[bytes], width: int) -> np.ndarray:
    """Hash of every shingle of exactly ``width`` words, in order; none if there are fewer words."""
    return rolled(word_hashes(words), width) if len(words) >= width else np.zeros(0, np.uint64)


TOKENS = StructType().add("token", ArrayType(LongType())).add("off", ArrayType(IntegerType()))


def item_windows(bench: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(window, item): each distinct run of ``size`` words of each item; a shorter item is one run."""
    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = words_of(t)
            n = min(size, len(w))
            out.append([b" ".join(w[i:i + n]).decode("utf-8", "surrogatepass") for i in range(len(w) - n + 1)] if n else [])
        return pd.Series(out, dtype=object)

    items = bench.select(F.col(id_col).cast("string").alias("item"), F.explode(cut(F.col(text_col))).alias("window"))
    return items.distinct()


@F.pandas_udf(TOKENS)
def window_tokens(windows: pd.Series) -> pd.DataFrame:
    """Distinct shingles of each window with the first place of each."""
    tokens, offs = [], []
    for text in windows:
        words = text.encode("utf-8", "surrogatepass").split(b" ")
        t, at = np.unique(tokens_of(words, min(SHINGLE, len(words))), return_index=True)
        tokens.append(t.view(np.int64))
        offs.append(at.astype(np.int32))
    return pd.DataFrame({"token": tokens, "off": offs})


FOUND = (StructType().add("n_words", LongType()).add("pos", ArrayType(IntegerType()))
         .add("token", ArrayType(LongType())).add("lead", ArrayType(IntegerType())).add("ctx", ArrayType(StringType())))


def find_tokens(maybe: np.ndarray, widths: list[int], size: int):
    """UDF over whole texts: word count, and each shingle that the bitmap of item shingles lets
    through, with its place and the words around it that any window over it could cover."""
    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            pos, token = [], []
            for width in widths:
                h = tokens_of(words, width)
                at = np.flatnonzero(bitmap_hits(maybe, h))
                pos.append(at)
                token.append(h[at].view(np.int64))
            p = np.concatenate(pos) if pos else np.zeros(0, np.int64)
            lead = np.minimum(p, size - 1)
            ctx = [b" ".join(words[i - k:i + size]).decode("utf-8", "surrogatepass") for i, k in zip(p, lead)]
            rows.append((len(words), p.astype(np.int32), np.concatenate(token) if token else [], lead.astype(np.int32), ctx))
        return pd.DataFrame(rows, columns=FOUND.names)

    return find


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, key, n_words, n_hit, items, spans) for every row of ``docs``.

    ``items`` are the ids (as strings, sorted) of the benchmark items of which a window of ``size``
    consecutive words occurs in the document, ``spans`` the (start, end) word runs where one does,
    and ``n_hit`` counts the document words inside any. An item with fewer words is one window.

    A window is a set of shingles to be contained whole, so its necessary prefix is one shingle:
    the one with the fewest occurrences in the documents. A document's occurrences of it are
    joined with the windows, must leave room for the window on both sides (position and length
    bounds), and the words around it are compared in full. A fixed-size bitmap of the item shingles
    keeps other shingles of the documents out of the shuffle, at any size of the benchmark.

    Null and empty texts have no words and no windows; a null item id is the id "". Repeated rows
    get equal results. Empty tables give no hits or no rows. Only the named columns are read.
    """
    spread = item_windows(bench, item_col, item_text, size).withColumn("item", F.coalesce("item", F.lit("")))
    items = checkpoint(spread)
    windows = items.select("window").distinct().withColumn("t", window_tokens("window")).withColumn(
        "len", F.size(F.split("window", " ")))
    shingles = checkpoint(windows.select("window", "len", F.explode(F.arrays_zip("t.token", "t.off")).alias("z")).select(
        "window", "len", "z.token", "z.off"))
    widths = sorted(r[0] for r in shingles.select(F.least("len", F.lit(SHINGLE))).distinct().collect())
    find = find_tokens(bitmap(shingles, "token"), widths, size)

    key = [row_key(id_col, text_col)["a"].alias("k1"), row_key(id_col, text_col)["b"].alias("k2")]
    found = docs.select(F.col(id_col).alias("id"), *key, find(F.col(text_col)).alias("f"))
    found = checkpoint(found.select("id", "k1", "k2", "f.*"))
    hits = found.select("k1", "k2", "n_words", F.explode(F.arrays_zip("pos", "token", "lead", "ctx")).alias("z")).select(
        "k1", "k2", "n_words", "z.pos", "z.token", "z.lead", "z.ctx")

    seen = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # A shingle that no document has rules its windows out.
    rarest = shingles.join(seen, "token", "left").groupBy("window", "len").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "off")).alias("r")).where("r.df > 0").select(
        "window", "len", "r.token", "r.off")
    at = F.expr("slice(split(ctx, ' '), lead - off + 1, len)")
    met = hits.join(rarest, "token").where("lead >= off and pos - off + len <= n_words").where(
        F.array_join(at, " ") == F.col("window"))
    met = checkpoint(met.select("k1", "k2", (F.col("pos") - F.col("off")).alias("start"), "len", "window").distinct())

    before = Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = met.select("k1", "k2", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    runs = runs.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    new = F.greatest(F.col("end") - F.greatest("start", "covered"), F.lit(0))
    words = runs.groupBy("k1", "k2").agg(F.sum(new).alias("n_hit"),
                                         F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    of = met.select("k1", "k2", "window").distinct().join(items, "window").groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    out = found.select("id", "k1", "k2", "n_words").join(words.join(of, ["k1", "k2"]), ["k1", "k2"], "left")
    none = F.array().cast("array<string>")
    return out.select("id", F.struct(F.col("k1").alias("a"), F.col("k2").alias("b")).alias("key"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("items", none).alias("items"), "spans")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
