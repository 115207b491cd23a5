"""Mixing sources to target weights (operator 1) by Pareto order sampling, with DataFrame functions only.

Every document of a source is wanted m = target / source size times (or, with an importance column, in proportion to
it). It gets floor(m) certain copies. The rest of the source's target, in words, is filled by a Pareto order
sample: documents are ranked by their random odds divided by the odds of their inclusion (the fraction of m), and
taken in that order until the words are there. The sample's size is thus fixed and the chances unequal.

No source is sorted in one task: ranks fall into BUCKETS buckets, whose word counts are summed first (twice, the
bucket on which the end falls being divided again); only documents of the last bucket are ordered among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import WORD_SQL, settle

#: The weights that sources get in turn, in order of their names.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKETS = 1024


def count_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    """A random whole number below 2^52 for a row, by its id and text: the same in every run, and in SQL."""
    parts = (F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def weigh(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with weight: the weights in turn, sources by code point, null last.

    Sources are numbered without bringing them into one task: ranges first, then places in the range."""
    parts = settle(sources.withColumn("_last", F.col("source").isNull()).repartitionByRange("_last", "source").withColumn("_part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_last", "source")) - 1
    ranked = parts.withColumn("_place", place).join(before, F.col("_part") == F.col("_p"))
    turn = F.pmod(F.col("_before") + F.col("_place"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)
    return ranked.select("source", "source_size", weight.alias("weight"))


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, weight) with target: share of all sizes by weight; none above most times its
    own size, what is over being shared again by weight until none is above."""
    sources = settle(sources, "sources")
    cap = F.col("source_size") * F.lit(most)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, full = 0.0, -1
    while True:
        # those at their cap at this rate; the rest share what remains. One row comes back each time.
        at_cap = F.col("weight") * F.lit(rate) >= cap if full >= 0 else F.lit(False)
        row = sources.agg(F.count_if(at_cap).alias("n"), F.sum(F.when(at_cap, cap).otherwise(0.0)).alias("c"), F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if row["n"] == full or not row["w"]:
            break
        rate, full = (total - row["c"]) / row["w"], row["n"]
    every = not row["w"]
    return sources.withColumn("target", cap if every else F.least(cap, F.col("weight") * F.lit(rate)))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, importance: str | None = None, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row of docs: id_col, size (words), source_size, target (both of its source), copies, taken (size x copies).

    importance names a column of positive numbers that multiply a document's chances within its source (null or
    below zero: none; where `most` binds for many, a source may stay below its target); without it all words of a source have equal chances. A null text has size 0 and is taken
    with its certain copies only. A null source is a source like any other. Rows of equal id, source and size are
    ranked alike; which of them is taken makes no difference to the result. Reruns over the same rows agree. An
    empty table gives no rows. At most `most` copies are taken of a row.
    """
    weight = F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(0.0)), F.lit(0.0)) if importance else F.lit(1.0)
    rows = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(text_col).alias("size"), weight.alias("chance"), _draw(id_col, text_col, seed).alias("hash")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("chance")).alias("pull"))
    per_source = settle(per_source, "per-source")
    goals = settle(targets(weigh(per_source.select("source", "source_size"), weights), share, most), "targets")
    goals = goals.join(per_source.select(F.col("source").alias("s"), "pull"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight")
    return _sample(rows, goals, most).withColumnRenamed("id", id_col)


def _sample(rows: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """Certain copies, then the Pareto order sample of what remains."""
    named = goals.withColumnRenamed("source", "s")
    # the sources' table is small where sources are few; Spark sends it along or joins by shuffle as its size has it
    wanted = F.least(F.lit(most), F.when(F.col("pull") > 0, F.col("chance") * F.col("target") / F.col("pull")).otherwise(0.0))
    held = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).withColumn("m", wanted).drop("s", "pull")
    # guards a whole number against the last bit of a division
    held = held.withColumn("certain", F.floor(F.col("m") + 1e-9)).withColumn("part", F.greatest(F.col("m") - F.col("certain"), F.lit(0.0)))
    u = (F.col("hash") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) * ((1 - F.col("part")) / F.col("part"))
    # a document at `most` copies, or without words, isn't in the order; the rank lies from 0 to 1
    ranked = held.withColumn("rank", F.when((F.col("certain") + 1 <= most) & (F.col("size") > 0) & (F.col("part") > 0), odds / (1 + odds)))
    ranked = ranked.withColumn("b1", F.floor(F.col("rank") * BUCKETS)).withColumn("b2", F.floor(F.col("rank") * BUCKETS * BUCKETS) - F.col("b1") * BUCKETS)
    ranked = settle(ranked, "ranks")
    key = F.col("source").eqNullSafe(F.col("s"))
    left = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("certain"))).alias("left"))

    def cut(words: DataFrame, bucket: str) -> DataFrame:
        """Per source the bucket on which its end falls, and the words that remain for it."""
        over = Window.partitionBy("source").orderBy(bucket)
        sums = words.withColumn("before", F.sum("words").over(over) - F.col("words"))
        last = sums.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
        return last.groupBy(F.col("source").alias("s")).agg(F.min(bucket).alias(f"end_{bucket}"), F.min_by(F.col("left") - F.col("before"), bucket).alias(f"left_{bucket}"))

    words1 = ranked.where(F.col("rank").isNotNull()).groupBy("source", "b1").agg(F.sum("size").alias("words"))
    end1 = cut(words1.join(left.withColumnRenamed("source", "s"), key).drop("s"), "b1")
    in1 = ranked.join(end1, key & (F.col("b1") == F.col("end_b1"))).drop("s")
    words2 = in1.groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("left_b1").alias("left"))
    end2 = cut(words2, "b2")
    ends = settle(left.withColumnRenamed("source", "s0").join(end1.withColumnRenamed("s", "s1"), F.col("s0").eqNullSafe(F.col("s1")), "left").join(end2, F.col("s0").eqNullSafe(F.col("s")), "left").select(F.col("s0").alias("s"), "left", "end_b1", "end_b2", "left_b2"), "ends")
    with_ends = ranked.join(ends, key).drop("s")
    # a source whose order holds fewer words than remain is taken whole
    below = (F.col("left") > 0) & (F.col("end_b1").isNull() | (F.col("b1") < F.col("end_b1")) | ((F.col("b1") == F.col("end_b1")) & (F.col("end_b2").isNull() | (F.col("b2") < F.col("end_b2")))))
    on_end = F.col("rank").isNotNull() & (F.col("left") > 0) & (F.col("b1") == F.col("end_b1")) & (F.col("b2") == F.col("end_b2"))
    rest = with_ends.where(~F.coalesce(on_end, F.lit(False))).withColumn("more", F.coalesce(F.col("rank").isNotNull() & below, F.lit(False)).cast("long"))
    order = Window.partitionBy("source").orderBy("rank", "id", "size")
    last = with_ends.where(on_end).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # the document on which the end falls is taken if that comes nearer to the target
    last = last.withColumn("more", (F.col("before") + F.col("size") / 2 <= F.col("left_b2")).cast("long")).drop("before")
    both = rest.unionByName(last)
    copies = F.col("certain") + F.col("more")
    return both.select("id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "source", "hash")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    shown = [F.col(f"_c{i}").alias(n) for i, n in enumerate(docs.columns)]
    inner = docs.select(*(F.col(n).alias(f"_c{i}") for i, n in enumerate(docs.columns)), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    plan = mix(inner, id_col="_id", text_col="_text", source_col="_source", **options)
    # equal rows (id, text and source alike) have equal hashes; their copies are shared out evenly
    key = _draw("_id", "_text", options.get("seed", 1))
    per_row = plan.groupBy(F.col("_id").alias("i"), F.col("hash").alias("h"), F.col("source").alias("s")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    joined = inner.withColumn("_hash", key).join(per_row, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_hash") == F.col("h")) & F.col("_source").eqNullSafe(F.col("s")))
    number = F.row_number().over(Window.partitionBy("_id", "_hash", "_source").orderBy("_hash"))
    single = joined.where(F.col("rows") == 1).withColumn("_times", F.col("copies"))
    several = joined.where(F.col("rows") > 1).withColumn("_n", number).withColumn("_times", F.floor(F.col("copies") / F.col("rows")) + (F.col("_n") <= F.col("copies") % F.col("rows")).cast("long")).drop("_n")
    every = single.unionByName(several).where(F.col("_times") > 0)
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*shown)
