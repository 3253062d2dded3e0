"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bucket_offsets, checkpoint, hash60, row_key

#: Words of a block at least; a block holds fewer than twice as many. The number of slots follows from the mix.
BLOCK = 512
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Products of words and slots don't fit a long.
WIDE = "cast({} as decimal(20, 0))".format
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string key without nulls that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words per source: ``sizes(g, source_size)`` plus ``target``, ``goal`` and the source's ``slots``.

    Sources in order of ``g`` take the weights in turn and share all words; none gets over
    ``repeats`` times its size, the excess goes to the others by weight until none is above. The
    fixed point is a water level: with sources by rising cap/weight, the level after the first k
    stopped is (total - their caps) / (weight left), and the first level that stays below the next
    source's cap/weight holds. ``goal`` is the target in whole words: rounded down, and the words
    left over go one each to the largest fractions, so the goals sum to what the targets sum to.
    One row per source, so the windows see the source table only.

    The mix has ``n`` = 2**``bits`` grid points; ``first`` is the first that lies in the source's
    span of the cumulative goals, ``slots`` how many do. A source whose span is between two points
    has one slot, at the point before it, which it shares.
    """
    everyone = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy("g")) - 1
    t = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    t = t.withColumns({"cap": repeats * F.col("source_size"), "total": F.sum("source_size").over(everyone),
                       "all_w": F.sum("w").over(everyone)})
    rising = Window.orderBy(F.col("cap") / F.col("w"), "g")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
                       "w_left": F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))})
    level = (F.col("total") - F.col("cap_before")) / F.col("w_left")
    fits = level * F.col("w") <= F.col("cap")
    t = t.withColumn("level", F.max(F.when(fits, level)).over(everyone))
    share = F.coalesce(F.least(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).cast("double")
    t = t.select("g", "source_size", "total", share.alias("target"))
    part = F.col("target") - F.floor("target")
    t = t.withColumns({"left": F.round(F.sum(part).over(everyone)),
                       "turn": F.row_number().over(Window.orderBy(part.desc(), "g"))})
    t = t.withColumn("goal", (F.floor("target") + (F.col("turn") <= F.col("left")).cast("int")).cast("long"))
    bits = F.length(F.bin(F.greatest(F.expr(f"total div {BLOCK}"), F.lit(1)))) - 1
    t = t.withColumn("bits", bits.cast("int")).withColumns({
        "n": F.expr("shiftleft(1L, bits)"),
        "upto": F.sum("goal").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)),
        "goals": F.greatest(F.sum("goal").over(everyone), F.lit(1))})
    t = t.withColumns({"k0": F.expr(f"({WIDE('upto - goal')} * n + goals - 1) div goals"),
                       "k1": F.expr(f"({WIDE('upto')} * n + goals - 1) div goals")})
    return t.select("g", "source_size", "target", "goal", "bits",
                    F.expr("if(k1 > k0, k0, k0 - 1)").alias("first"), F.expr("greatest(k1 - k0, 1)").alias("slots"))


def schedule(goals: DataFrame) -> DataFrame:
    """(g, slot, rank): which sources fill each slot of the mix, and the how-manieth of its slots it is.

    Slot i stands at van der Corput's point i (its bits in reverse); the point picks the source in
    whose span of the cumulative goals it lies. The points of 2**m slots are the grid
    k / 2**m, so each source yields its own grid points and reverses their bits: no range join.
    Any aligned run of 2**j slots holds each source's share of slots within one. One row for every
    ``BLOCK`` to 2 * ``BLOCK`` words of the mix and one for each source.
    """
    t = goals.where("goal > 0")
    run = t.select("g", "bits", "first", "slots", F.explode(F.expr("sequence(0L, shiftright(slots - 1, 16))")).alias("run"))
    some = "sequence(first + run * 65536, first + least(slots, (run + 1) * 65536) - 1)"
    k = run.select("g", "bits", F.explode(F.expr(some)).alias("k"))
    slot = F.conv(F.reverse(F.lpad(F.bin("k"), F.col("bits"), "0")), 2, 10).cast("long")
    slots = k.select("g", "bits", F.when(F.col("bits") == 0, 0).otherwise(slot).alias("slot"))
    # 2**16 runs of slots at most, of 256 slots at least.
    slots = slots.withColumn("_b", F.expr("shiftright(slot, greatest(8, bits - 16))").cast("int")).drop("bits")
    before = bucket_offsets(slots, ["g"], "_b", {"_before": F.count(F.lit(1))})
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("g", "_b").orderBy("slot")) - 1
    return slots.join(before, ["g", "_b"]).select("g", "slot", rank.alias("rank"))


def placed(df: DataFrame, id_col: str, source: Column, text_col: str, weights: tuple[int, ...],
           repeats: int) -> tuple[DataFrame, DataFrame]:
    """The shuffled documents with their word spans ``at``.. in their source, and the table of targets.

    Documents of a source stand one after another in the order of a hash of id and size. Running
    sums are two-level: 4096 hash runs per source, then rows inside a run, so no task holds a source.
    """
    slim = df.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"),
                     source_key(source).alias("g"), word_count(F.col(text_col)).alias("size"))
    order = hash60(F.concat_ws(":", F.col("id").cast("string"), F.col("size").cast("string")))
    slim = checkpoint(slim.withColumn("o", order).withColumn("b", F.shiftright("o", 48).cast("int")))
    goals = checkpoint(targets(slim.groupBy("g").agg(F.sum("size").alias("source_size")), weights, repeats))
    offsets = bucket_offsets(slim, ["g"], "b", {"words_before": F.sum("size")})
    run = Window.partitionBy("g", "b").orderBy("o", "id", "size", "key")
    upto = F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))
    docs = slim.join(offsets.join(goals, "g"), ["g", "b"]).withColumn("at", F.col("words_before") + upto - F.col("size"))
    return docs.select("id", "key", "g", "size", "source_size", "target", "goal", "slots", "at"), goals


def pieces(docs: DataFrame) -> DataFrame:
    """Documents cut at the borders of their source's slots: one row per document, pass and slot.

    A source gives its first ``goal`` words, read round and round: whole passes and a leading part
    of one more. Its slot of rank r holds words ceil(r * goal / slots) .. of these; ``lo``..``hi``-1
    are those of the document. At most documents times passes plus slots rows. A document of which the
    mix takes nothing has one row, without a rank.
    """
    passes = F.expr("if(size > 0 and goal > at, sequence(0L, (goal - at - 1) div source_size), null)")
    t = docs.withColumn("pass", F.explode_outer(passes))
    t = t.withColumn("start", F.expr("pass * source_size + at")).withColumn("end", F.expr("least(start + size, goal)"))
    ranks = F.expr(f"sequence(({WIDE('start')} * slots) div goal, ({WIDE('end - 1')} * slots) div goal)")
    t = t.withColumn("rank", F.explode_outer(F.when(F.col("pass").isNotNull(), ranks)))
    return t.withColumns({"lo": F.expr(f"greatest(start, ({WIDE('rank')} * goal + slots - 1) div slots)"),
                          "hi": F.expr(f"least(end, ({WIDE('rank + 1')} * goal + slots - 1) div slots)")})


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed stream: (slot, source key ``g``, pass, id, key, from_word, to_word), to be read by slot.

    Word spans are inside the document, ``to_word`` exclusive. Every source gives its goal to the
    word, however small it is beside a slot. Null texts have no words; a null
    source is a source of its own, last in order; an empty table gives an empty stream. Repeated
    rows are documents of their own. Only the three columns are read.
    """
    docs, goals = placed(df, id_col, F.col(source_col), text_col, weights, repeats)
    return schedule(goals).join(pieces(docs), ["g", "rank"]).select(
        "slot", "g", "pass", "id", "key", (F.col("lo") - F.col("start")).alias("from_word"),
        (F.col("hi") - F.col("start")).alias("to_word"))


def taken_words(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(id, key, g, size, source_size, target, taken) for every row: the words of it in the mixed stream.

    The spans of the mixed stream summed by document: every span lies in a slot of the schedule. Documents
    that the mix leaves out have ``taken`` 0. Rows are told apart by where they stand in their source,
    so repeated rows keep counts of their own; the words of a row don't leave its task.
    """
    docs, goals = placed(df, id_col, F.col(source_col), text_col, weights, repeats)
    spans = pieces(docs).join(schedule(goals).withColumn("filled", F.lit(True)), ["g", "rank"], "left")
    words = F.when(F.col("filled"), F.col("hi") - F.col("lo")).otherwise(0)
    own = ["id", "key", "g", "at", "size", "source_size", "target"]
    # Documents without words may stand at one place; each of their rows counts.
    with_words = spans.where("size > 0").groupBy(*own).agg(F.sum(words).alias("taken"))
    without = docs.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return with_words.unionByName(without).drop("at")
