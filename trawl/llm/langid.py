"""Language ID (operator 8), word first: known words are scored by their log frequency in each language; an
unseen word falls back to the longest known character n-gram at each of its positions, from GRAM letters to one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import Memo, discard, free_memory, learnable, settle, text_slices, tidy

LETTERS = re.compile(r"[^\W\d_]+")
GRAM = 5
#: The model is fitted on a bounded sample of labelled rows: whole rows, drawn by a hash of the id, about SAMPLE_CHARS
#: characters of each language and SAMPLE_TOTAL of all, or SAMPLE_ROWS rows of a language of long texts; at least one
#: row of every language. Their words are counted where they are; the WORDS most frequent come to the driver.
SAMPLE_CHARS, SAMPLE_TOTAL, SAMPLE_ROWS = 1_500_000, 24_000_000, 20
WORDS = 400_000
#: Languages' shares that are broadcast at most; more are joined by shuffle.
BROADCAST_LANGUAGES = 100_000
#: A word or n-gram seen less often in the sample isn't kept.
LEAST = 3
#: What an occurrence that wasn't seen counts.
UNSEEN = 0.2
#: Words that a task keeps the scores of, and bytes of these; scores that are summed at once.
TABLE_ROWS, TABLE_BYTES, SUMMED = 150_000, 32 << 20, 2_000_000
KEPT_CHARS = 64


@dataclass
class Scores:
    """Log relative frequencies by language: `base` for what wasn't seen in it, and what is to be added where it was.
    Only what was seen is held, so the size is that of the sample, whatever the number of languages."""

    rows: dict[str, int]
    base: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    more: np.ndarray

    def sums(self, rows: list[int], owner: list[int], n: int) -> np.ndarray:
        """For each of n owners the sum of its rows' scores."""
        at, own = np.array(rows, np.int64), np.array(owner, np.int64)
        size = self.starts[at + 1] - self.starts[at]
        each = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[at], size)
        wide = len(self.base)
        found = np.bincount(np.repeat(own, size) * wide + self.language[each], weights=self.more[each], minlength=n * wide).reshape(n, wide)
        return found + np.bincount(own, minlength=n)[:, None] * self.base


@dataclass
class LanguageModel:
    languages: list[str]
    words: Scores
    grams: Scores


def _logs(counts: dict[str, Counter], languages: list[str], least: int) -> Scores:
    """Scores of what occurs `least` times or more, add-a-bit smoothed."""
    total: Counter = Counter()
    for c in counts.values():
        total.update(c)
    rows = {x: i for i, x in enumerate(x for x, n in total.items() if n >= least)}
    at, lang, times = [], [], []
    for j, name in enumerate(languages):
        for x, n in counts[name].items():
            if x in rows:
                at.append(rows[x])
                lang.append(j)
                times.append(n)
    n, at, lang = np.array(times, float), np.array(at, np.int64), np.array(lang, np.int32)
    order = np.argsort(at, kind="stable")
    sums = np.bincount(lang, weights=n, minlength=len(languages)) + UNSEEN * max(1, len(rows))
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(rows)))]).astype(np.int64)
    return Scores(rows, np.log(UNSEEN / sums).astype(np.float32), starts, lang[order], np.log((n[order] + UNSEEN) / UNSEEN).astype(np.float32))


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def fit(words: dict[str, Counter], least: int = LEAST) -> LanguageModel:
    """words: how often each word occurs, by language."""
    languages = sorted(words)
    grams: dict[str, Counter] = {lang: Counter() for lang in languages}
    for lang in languages:
        for word, n in words[lang].items():
            held = f"^{word}$"
            for size in range(1, GRAM + 1):
                for i in range(len(held) - size + 1):
                    grams[lang][held[i : i + size]] += n
    for c in grams.values():
        for mark in "^$":
            c.pop(mark, None)
    return LanguageModel(languages, _logs(words, languages, least), _logs(grams, languages, least))


def word_scores(model: LanguageModel, words: list[str]) -> np.ndarray:
    """Log evidence of words for each language: their own, or else the mean of their longest known n-grams'."""
    known, known_at, parts, parts_at = [], [], [], []
    word_row, gram_row = model.words.rows.get, model.grams.rows.get
    for k, word in enumerate(words):
        if (row := word_row(word)) is not None:
            known.append(row)
            known_at.append(k)
            continue
        held = f"^{word}$"
        for i in range(len(held)):
            for end in range(min(i + GRAM, len(held)), i, -1):
                if (row := gram_row(held[i:end])) is not None:
                    parts.append(row)
                    parts_at.append(k)
                    break
    n = len(words)
    means = model.grams.sums(parts, parts_at, n) / np.maximum(1, np.bincount(np.array(parts_at, np.int64), minlength=n))[:, None]
    return (model.words.sums(known, known_at, n) + means).astype(np.float32)


def _packed(model: LanguageModel, words: list[str]) -> list[bytes]:
    """word_scores as bytes, a bounded number of scores at once."""
    step = max(1, SUMMED // max(1, len(model.languages)))
    return [row.tobytes() for at in range(0, len(words), step) for row in word_scores(model, words[at : at + step])]


def _sums(scores: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The summed scores of each text's words, a bounded number of scores at once."""
    out = np.zeros((len(starts), scores.shape[1]))
    step = max(1, SUMMED // scores.shape[1])
    for at in range(0, len(codes), step):
        end = min(len(codes), at + step)
        first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end, "left")
        places = np.maximum(starts[first:last], at) - at
        out[first:last] += np.add.reduceat(scores[codes[at:end]], places, axis=0, dtype=np.float64)
    return out


def predict(model: LanguageModel, table: Memo, texts: list[str]) -> tuple[list[str], list[float]]:
    """Per text the language and its share of the evidence; 'und' and 0.0 where there is no letter or no model. Of
    languages with equal evidence the first by code point is taken."""
    held = [words_of(t) for t in texts]
    # what the pattern finds may be numerals without any letter, such as fractions
    distinct = {w for ws in held for w in ws}
    bare = {w for w in distinct if not w.isalpha() and not any(map(str.isalpha, w))}
    if bare:
        distinct -= bare
        held = [[w for w in ws if w not in bare] for ws in held]
    sizes = np.array([len(w) for w in held], np.int64)
    if not model.languages or not sizes.sum():
        return ["und"] * len(texts), [0.0] * len(texts)
    long = [w for w in distinct if len(w) > KEPT_CHARS]
    known = table.fill(distinct.difference(long), lambda new: _packed(model, new))
    order = list(distinct)
    extra = dict(zip(long, _packed(model, long), strict=True))
    rows = b"".join(known[w] if w in known else extra[w] for w in order) if long else b"".join(map(known.__getitem__, order))
    scores = np.frombuffer(rows, np.float32).reshape(len(order), -1)
    place = dict(zip(order, range(len(order)), strict=True))
    codes = np.fromiter((place[w] for ws in held for w in ws), np.int64, int(sizes.sum()))
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    sums = _sums(scores, codes, starts)
    best = sums.argmax(axis=1)
    # evidence grows with the root of the length: words of a text don't stand for themselves
    odds = np.exp((sums - sums.max(axis=1, keepdims=True)) / np.sqrt(sizes[full])[:, None])
    share = odds[np.arange(len(best)), best] / odds.sum(axis=1)
    langs, shares = ["und"] * len(texts), [0.0] * len(texts)
    for k, i in enumerate(full):
        langs[i], shares[i] = model.languages[best[k]], float(share[k])
    return langs, shares


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits a model on a bounded sample (see SAMPLE_CHARS) of the rows that may be learnt from; every language that
    these rows have is learnt."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("g"), F.col(text_col).alias("x")).where(F.col("g").isNotNull() & F.col("x").isNotNull() & learnable("i"))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(F.col("i"), F.lit(8)), F.lit(1 << 30)))
    sizes = settle(rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("c"), F.min("draw").alias("least")), "languages")
    languages = sizes.count()
    if not languages:
        return fit({})
    chars = min(SAMPLE_CHARS, SAMPLE_TOTAL / languages)
    share = F.greatest(chars / F.greatest(F.col("c"), F.lit(1)), SAMPLE_ROWS / F.col("n"))
    wanted = sizes.select(F.col("g").alias("l"), F.greatest(F.col("least"), share * (1 << 30)).alias("most"))
    drawn = rows.join(F.broadcast(wanted) if languages <= BROADCAST_LANGUAGES else wanted, F.col("g") == F.col("l")).where(F.col("draw") <= F.col("most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "x"):
                found: dict[str, Counter] = defaultdict(Counter)
                for lang, text in zip(batch.column(0).slice(a, b - a).to_pylist(), texts, strict=True):
                    found[lang].update(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    ([lang for lang, c in found.items() for _ in c], [w for c in found.values() for w in c], [n for c in found.values() for n in c.values()]), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["g", "w", "n"])

    counted = drawn.select("g", "x").mapInArrow(tidy(count), "g string, w string, n long").groupBy("g", "w").agg(F.sum("n").alias("n"))
    words: dict[str, Counter] = defaultdict(Counter)
    for r in counted.orderBy(F.desc("n"), "g", "w").limit(WORDS).collect():
        words[r["g"]][r["w"]] = r["n"]
    for r in sizes.select("g").limit(WORDS).collect():
        words[r["g"]]  # a language of rows without words is known all the same
    discard(sizes)
    model = fit(words)
    free_memory()
    return model


def detect(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row of docs: id_col, held_out, lang_pred, score (and, with keep, the columns of docs).

    lang_pred is 'und' with score 0.0 if the text is null or has no letter, or if nothing could be learnt. Only the
    text decides. Null ids and repeated rows are returned as they are; an empty table gives no rows. Texts of any
    length are read whole. With keep, the columns of docs stay beside _lang_pred and _lang_score.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    shown = docs.schema.fields if keep else [docs.schema[id_col]]
    text_at = F.col(text_col).alias("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Memo(min(TABLE_ROWS, TABLE_BYTES // (4 * max(1, len(shared.value.languages)))))
        for batch in batches:
            langs: list[str] = []
            shares: list[float] = []
            for _, _, texts in text_slices(batch, "_text"):
                a, b = predict(shared.value, table, texts)
                langs += a
                shares += b
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(shares, pa.float64())], names=[*(f"_c{i}" for i in range(len(shown))), "_lang_pred", "_lang_score"])

    inner = docs.select(*(F.col(f.name).alias(f"_c{i}") for i, f in enumerate(shown)), text_at)
    schema = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(shown)) + ", _lang_pred string, _lang_score double"
    found = inner.mapInArrow(tidy(run), schema)
    back = [F.col(f"_c{i}").alias(f.name) for i, f in enumerate(shown)]
    if keep:
        return found.select(*back, "_lang_pred", "_lang_score")
    return found.select(*back, (~learnable("_c0")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def confident(docs: DataFrame, model: LanguageModel, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is told with a share of `least` or more of the evidence, with the columns of
    docs, whatever their names. Rows whose text is null or has no letter go."""
    row = F.struct(*(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(docs.columns)))
    found = detect(docs.select(row.alias("row"), F.col(text_col).alias("text")), model, "row", keep=True)
    found = found.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= least))
    return found.select(*(F.col(f"row.c{i}").alias(name) for i, name in enumerate(docs.columns)))
