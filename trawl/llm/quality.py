"""Quality rules (operator 4): thresholds follow each (language, source) group's own distribution, read from
mergeable quantile sketches, in place of fixed cutoffs; the thresholds are joined back to the documents.

A sketch is a histogram of a measure, in thousandths, over buckets that are exact below 2 x PARTS and then PARTS to
each doubling: quantiles are within a share of 1 / PARTS, a sketch is bounded whatever the size of its group, sketches
merge by adding counts, and neither order nor number of merges changes one, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import WORD, settle, text_slices, tidy

#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per 100 words
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Each measure's upper threshold lies above the group's high decile by SPREAD times the distance from the median to
#: the high decile. Where both are (nearly) one value, as with measures that are 0 for most documents, the threshold
#: lies above the median by what is given here (thousandths of the measures' own units).
TIE = {"symbol_share": 20, "dup_line_share": 200, "repeat_share": 100, "word_length": 1000}
SPREAD = 2.0
#: Buckets to each doubling, a power of two.
PARTS = 64
#: A group's quantiles are averaged with those of its language, and these with those of all documents; the wider ones
#: weigh as much as so many documents, at every size.
PRIOR = 40


def repeated_words(words: list[list[str]]) -> np.ndarray:
    """For each text, how many of its words lie in a 3-word window that occurs twice or more in it."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if total < 3:
        return np.zeros(len(words), np.int64)
    place: dict[str, int] = {}
    codes = np.fromiter((place.setdefault(w, len(place)) for ws in words for w in ws), np.int64, total)
    doc = np.repeat(np.arange(len(words)), sizes)
    inside = doc[:-2] == doc[2:]
    _, pair = np.unique(codes[:-2] * len(place) + codes[1:-1], return_inverse=True)
    _, window = np.unique(pair * len(place) + codes[2:], return_inverse=True)
    _, own, times = np.unique(doc[:-2] * (int(window.max()) + 1) + window, return_inverse=True, return_counts=True)
    again = (times[own] > 1) & inside
    if not inside.all():  # windows across texts don't count, nor may they make others count
        keys = (doc[:-2] * (int(window.max()) + 1) + window)[inside]
        _, own, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = np.zeros(total - 2, bool)
        again[inside] = times[own] > 1
    hit = np.zeros(total, bool)
    for k in range(3):
        hit[k : total - 2 + k] |= again
    return np.bincount(doc[hit], minlength=len(words))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += WORD.search(line) is not None
        seen.add(line)
    return n


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: id_col, the group columns (_g0, ...), n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words. A null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = lambda chars: F.length(F.translate("_text", chars, ""))
    shown = [docs.schema[id_col], *(docs.schema[g] for g in groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, dup, rep, n_lines = [], [], [], []
            for _, _, texts in text_slices(batch, "_text"):
                words = [WORD.findall(t) for t in texts]
                n_words += map(len, words)
                rep.append(repeated_words(words))
                dup += map(repeated_lines, texts)
                n_lines += [t.count("\n") + 1 for t in texts]
            rep_all = np.concatenate(rep) if rep else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in (n_words, dup, rep_all, n_lines))], names=[*batch.schema.names[:-1], "n_words", "n_dup_lines", "n_repeat_words", "n_lines"])

    names = ["_id", *(f"_g{i}" for i in range(len(groups)))]
    inner = docs.select(*(F.col(f.name).alias(n) for f, n in zip(shown, names, strict=True)), text.alias("_text"))
    inner = inner.select(*names, left(SPACES).cast("long").alias("word_chars"), (F.length("_text") - left(SYMBOLS)).cast("long").alias("n_symbols"), "_text")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, shown, strict=True)) + ", word_chars long, n_symbols long, n_words long, n_dup_lines long, n_repeat_words long, n_lines long"
    return inner.mapInArrow(tidy(run), schema)


def _measures() -> dict[str, Column]:
    """The measures in whole thousandths."""
    per = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN ({a} * 1000) div {b} ELSE 0 END")
    return {"symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")}


def bucket_of(value: str) -> Column:
    """The bucket of a whole number."""
    bits = f"(length(bin({value})) - {PARTS.bit_length()})"
    return F.expr(f"CASE WHEN {value} < {2 * PARTS} THEN {value} ELSE {bits} * {PARTS} + shiftright({value}, {bits}) END").cast("long")


def largest_in(bucket: str) -> Column:
    """The largest whole number of a bucket."""
    doublings = f"CAST(greatest({bucket} div {PARTS} - 1, 0) AS int)"
    return F.expr(f"shiftleft({bucket} - {doublings} * {PARTS} + 1, {doublings}) - 1")


def _quantiles(sketch: DataFrame, names: list[str]) -> DataFrame:
    """Per group (names): n, and each measure's median and high decile (high), from sketches (names, measure, bucket,
    times). A group's buckets are few, however many its documents."""
    own = Window.partitionBy(*names, "measure")
    summed = sketch.withColumn("up_to", F.sum("times").over(own.orderBy("bucket"))).withColumn("all", F.sum("times").over(own))
    found = summed.groupBy(*names, "measure").agg(F.first("all").alias("n"), F.min(F.when(2 * F.col("up_to") >= F.col("all"), F.col("bucket"))).alias("b5"), F.min(F.when(10 * F.col("up_to") >= 9 * F.col("all"), F.col("bucket"))).alias("b9"))
    found = found.withColumn("median", largest_in("b5")).withColumn("high", largest_in("b9"))
    pick = lambda k, q: F.max(F.when(F.col("measure") == k, F.col(q))).cast("double").alias(f"{q}_{k}")
    return found.groupBy(*names).agg(F.first("n").cast("double").alias("n"), *(pick(k, q) for k in TIE for q in ("median", "high")))


def thresholds(measured: DataFrame, n_groups: int) -> DataFrame:
    """Per group (_g0, ...): the upper threshold of each measure, in thousandths. Sketches are made once for each
    group, then merged for each language and for all, so the documents are read once."""
    names = [f"_g{i}" for i in range(n_groups)]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), c.alias("value")) for k, c in _measures().items())))
    each = measured.where(F.col("n_words") > 0).select(*names, values.alias("m")).select(*names, "m.measure", "m.value")
    own = settle(each.withColumn("bucket", bucket_of("value")).groupBy(*names, "measure", "bucket").agg(F.count("*").alias("times")), "sketches")
    quantities = [f"{q}_{k}" for k in TIE for q in ("median", "high")]
    full = _quantiles(own, names)
    overall = _quantiles(own.groupBy("measure", "bucket").agg(F.sum("times").alias("times")), []).first()  # eight numbers
    for depth in range(1, n_groups):  # quantiles of the wider groups, beside each group's own
        wide = own.groupBy(*names[:depth], "measure", "bucket").agg(F.sum("times").alias("times"))
        wide = _quantiles(wide, names[:depth]).withColumnsRenamed({c: f"{c}_at{depth}" for c in ("n", *quantities)} | {g: f"r{g}" for g in names[:depth]})
        full = full.join(wide, [F.col(g).eqNullSafe(F.col(f"r{g}")) for g in names[:depth]], "left").drop(*(f"r{g}" for g in names[:depth]))
    for q in quantities:
        mean = F.lit(overall[q]).cast("double")
        for depth in range(1, n_groups):
            mean = (F.col(f"n_at{depth}") * F.col(f"{q}_at{depth}") + PRIOR * mean) / (F.col(f"n_at{depth}") + PRIOR)
        full = full.withColumn(q, (F.col("n") * F.col(q) + PRIOR * mean) / (F.col("n") + PRIOR))
    most = [F.greatest(F.col(f"median_{k}") + tie, F.col(f"high_{k}") + SPREAD * (F.col(f"high_{k}") - F.col(f"median_{k}"))).alias(f"most_{k}") for k, tie in TIE.items()]
    return full.select(*names, *most)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words, fails the base rules and isn't kept. A null language or source is a group
    like any other. Repeated rows are returned as often as they occur. An empty table gives no rows. Texts of any
    length are read whole. A measure that equals its threshold is fine. Reruns agree.
    """
    measured = settle(measure(docs, id_col, text_col, groups), "measures")
    limits = thresholds(measured, len(groups))
    cond = [F.col(f"_g{i}").eqNullSafe(F.col(f"r_g{i}")) for i in range(len(groups))]
    joined = measured.join(limits.withColumnsRenamed({f"_g{i}": f"r_g{i}" for i in range(len(groups))}), cond, "left")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fine = F.lit(True)
    for k, c in _measures().items():
        fine &= F.coalesce(c <= F.col(f"most_{k}"), F.lit(True))
    return joined.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & fine).alias("kept"))
