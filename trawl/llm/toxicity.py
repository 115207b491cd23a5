"""Toxicity (operator 3): a linear-chain conditional random field over words, two states (plain, toxic).

Only documents have labels, so words are labelled first: a word of a toxic document is toxic if one of its features
is far more frequent in toxic documents than in others. The field is then fitted to these words (forward-backward,
adaptive gradient). Its marginals give the toxic spans; a logistic curve over their sum, largest value and share
gives the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import Memo, learnable, text_slices, tidy

LETTERS = re.compile(r"[^\W\d_]+")
#: The field is fitted on at most about so many labelled documents of each class (drawn by a hash of the id), and so
#: many characters of each, in whole texts; texts of over LONG_CHARS come last.
SAMPLE_DOCS = 2500
SAMPLE_CHARS, LONG_CHARS = 4_000_000, 100_000
LOG_ODDS = 2.5
LEAST_DOCS = 3
THRESHOLD = 0.3
TABLE_ROWS = 400_000
KEPT_CHARS = 64
#: Longer texts are cut into parts of so many words, which are worked on side by side.
PART = 1024


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, in order; lower() keeps all places but for one letter's."""
    return LETTERS.findall(text.replace("\u0130", "i").lower())


@dataclass
class ToxicField:
    weights: dict[str, float] = field(default_factory=dict)  # of features, for toxic against plain
    bias: float = -6.0
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # plain-plain, plain-toxic, toxic-plain, toxic-toxic
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0, 1.0)  # of the document's score


def features(word: str) -> list[str]:
    return [f"w={word}", *(f"p={word[:k]}" for k in (4, 5, 6) if len(word) >= k), f"s={word[-4:]}"]


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order of the sequences by falling length, where each starts, and how many reach step t."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    starts = (np.cumsum(sizes) - sizes)[order]
    if not len(order):
        return order, starts, []
    reach = np.bincount(sizes[order])
    alive = len(order) - np.cumsum(reach)
    return order, starts, [len(order), *alive[1 : int(sizes.max())].tolist()]


def _products(e: np.ndarray, start: np.ndarray, size: np.ndarray, t: tuple[float, float, float, float]) -> np.ndarray:
    """For each part (start, size) the product of its moves, from a word to the next and that word's own weight, as a
    2 x 2 matrix up to a factor."""
    out = np.tile([1.0, 0.0, 0.0, 1.0], (len(start), 1))  # by rows
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        x = e[start[some] + k]
        a, b, c, d = out[some].T
        made = np.stack([a * t[0] + b * t[2], (a * t[1] + b * t[3]) * x, c * t[0] + d * t[2], (c * t[1] + d * t[3]) * x], axis=1)
        out[some] = made / made.max(axis=1, keepdims=True)
    return out


def _between(e: np.ndarray, owner: np.ndarray, start: np.ndarray, size: np.ndarray, t: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """What the parts of a text hand over to one another: the forward ratio at the word before each part (of no use for
    a first part), and the backward ratio at its last word."""
    before, after = np.ones(len(start)), np.ones(len(start))
    parts = np.flatnonzero(np.bincount(owner, minlength=1)[owner] > 1)
    if len(parts):
        first = np.ones(len(parts), bool)
        first[1:] = owner[parts[1:]] != owner[parts[:-1]]
        held = _products(e, start[parts] + first, size[parts] - first, t).tolist()
        ratio = 1.0
        for k, c in enumerate(parts.tolist()):
            if first[k]:
                ratio = float(e[start[c]])
            else:
                before[c] = ratio
            m = held[k]
            ratio = min(max((m[1] + m[3] * ratio) / (m[0] + m[2] * ratio), 1e-200), 1e200)
        for k in range(len(parts) - 1, 0, -1):
            if not first[k]:
                m, b = held[k], float(after[parts[k]])
                after[parts[k] - 1] = (m[2] + m[3] * b) / (m[0] + m[1] * b)
    return before, after


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: tuple[float, float, float, float], pairs: bool = False):
    """P(toxic) of every word; sequences lie one after the other, sizes has their lengths. With pairs, also the
    expected number of each move (4 values). Ratios of the two states stand for the forward and backward values."""
    t00, t01, t10, t11 = np.exp(np.array(moves))
    e = np.exp(np.clip(scores, -30, 30))
    times = -(-sizes // PART)
    owner = np.repeat(np.arange(len(sizes)), times)
    start = (np.cumsum(sizes) - sizes)[owner] + (np.arange(len(owner)) - (np.cumsum(times) - times)[owner]) * PART
    size = np.minimum(PART, np.cumsum(sizes)[owner] - start)
    order, starts, alive = _layout(size)
    fwd, bwd = np.empty(len(e)), np.ones(len(e))
    if not alive:
        return (fwd, np.zeros(4)) if pairs else fwd
    before, after = _between(e, owner, start, size, (t00, t01, t10, t11))
    begins = np.isin(start, (np.cumsum(sizes) - sizes)[sizes > 0])
    r = np.where(begins, e[start], e[start] * (t01 + t11 * before) / (t00 + t10 * before))[order]
    fwd[starts] = r
    for t in range(1, len(alive)):
        k = alive[t]
        at, r = starts[:k] + t, r[:k]
        r = np.clip(e[at] * (t01 + t11 * r) / (t00 + t10 * r), 1e-200, 1e200)
        fwd[at] = r
    bwd[start + size - 1] = after
    after = after[order]
    b = after[: alive[-1]]
    for t in range(len(alive) - 2, -1, -1):
        k, nxt = alive[t], alive[t + 1]
        at = starts[:nxt] + t
        x = e[at + 1] * b
        b = (t10 + t11 * x) / (t00 + t01 * x)
        bwd[at] = b
        if k > nxt:
            b = np.concatenate([b, after[nxt:k]])
    odds = fwd * bwd
    p = odds / (1 + odds)
    if not pairs:
        return p
    last = np.zeros(len(e), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    i = np.flatnonzero(~last)
    x = e[i + 1] * bwd[i + 1]
    parts = np.stack([np.full(len(i), t00), t01 * x, t10 * fwd[i], t11 * fwd[i] * x])
    return p, (parts / parts.sum(axis=0)).sum(axis=1)


def label_words(docs: list[list[str]], toxic: list[int]) -> list[np.ndarray]:
    """The labelled tokens: 1 for a word of a toxic document one of whose features tells the classes apart."""
    df = (Counter(), Counter())
    for words, y in zip(docs, toxic, strict=True):
        df[y].update({f for w in set(words) for f in features(w)})
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    strong = {f for f, n in df[1].items() if n >= LEAST_DOCS and np.log((n + 0.5) / (n1 + 1)) - np.log((df[0][f] + 0.5) / (n0 + 1)) >= LOG_ODDS}
    return [np.array([y and any(f in strong for f in features(w)) for w in words], float) for words, y in zip(docs, toxic, strict=True)]


def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: log of 1 + expected toxic words, the largest marginal, the share of toxic words."""
    out = np.zeros((len(sizes), 3))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(p, starts)
        out[full] = np.stack([np.log1p(total), np.maximum.reduceat(p, starts), np.sqrt(total / sizes[full])], axis=1)
    return out


def fit(texts: list[str], toxic: list[int], rounds: int = 12, rate: float = 0.3) -> ToxicField:
    docs = [words_of(t) for t in texts]
    model = ToxicField()
    if not any(toxic) or all(toxic):
        return model
    labels = label_words(docs, toxic)
    # a feature that never meets a toxic word can only be pushed down: the bias stands for all of those
    useful: dict[str, int] = {}
    for words, y in zip(docs, labels, strict=True):
        for w in {words[i] for i in np.flatnonzero(y)}:
            for f in features(w):
                useful.setdefault(f, len(useful))
    rows: dict[str, list[int]] = {}
    for words in docs:
        for w in words:
            if w not in rows:
                rows[w] = [useful[f] for f in features(w) if f in useful]
    sizes = np.array([len(w) for w in docs], np.int64)
    flat = [rows[w] for ws in docs for w in ws]
    word_at = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    feat_at = np.array([f for x in flat for f in x], np.int64)
    y = np.concatenate(labels) if labels else np.zeros(0)
    ends = np.cumsum(sizes)
    inner = np.ones(len(y), bool)
    inner[ends[sizes > 0] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.bincount((2 * y[i] + y[i + 1]).astype(int), minlength=4).astype(float)
    w, b, moves = np.zeros(len(useful)), -4.0, np.zeros(4)
    gw, gb, gm = np.full(len(useful), 1e-6), 1e-6, np.full(4, 1e-6)
    for _ in range(rounds):
        scores = b + np.bincount(word_at, weights=w[feat_at], minlength=len(y))
        p, expected = marginals(scores, sizes, tuple(moves), pairs=True)
        miss = y - p
        dw = np.bincount(feat_at, weights=miss[word_at], minlength=len(useful)) - 0.05 * w
        db, dm = miss.sum(), seen - expected
        gw += dw**2
        gb += db**2
        gm += dm**2
        w += rate * 3 * dw / np.sqrt(gw)
        b += rate * db / np.sqrt(gb)
        moves = moves + rate * dm / np.sqrt(gm)
    model.weights = {f: float(w[k]) for f, k in useful.items() if abs(w[k]) > 1e-3}
    model.bias, model.moves = float(b), tuple(map(float, moves))
    scores = b + np.bincount(word_at, weights=w[feat_at], minlength=len(y))
    model.curve = _logistic(summary(marginals(scores, sizes, model.moves), sizes), np.array(toxic, float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Newton steps; a small ridge keeps it finite."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return tuple(map(float, w))


def word_score(model: ToxicField, word: str) -> float:
    get = model.weights.get
    return model.bias + sum(get(f, 0.0) for f in features(word))


def tag(model: ToxicField, table: Memo, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all words, the number of words per text, and the texts' scores."""
    docs = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in docs], np.int64)
    distinct = {w for ws in docs for w in ws}
    long = {w: word_score(model, w) for w in distinct if len(w) > KEPT_CHARS}
    known = table.fill(distinct.difference(long), lambda new: [word_score(model, w) for w in new])
    if long:
        known = {w: known[w] for w in distinct.difference(long)} | long
    scores = np.fromiter((known[w] for ws in docs for w in ws), np.float64, int(sizes.sum()))
    p = marginals(scores, sizes, model.moves)
    x = np.hstack([np.ones((len(texts), 1)), summary(p, sizes)])
    return p, sizes, 1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -30, 30)))


def spans_of(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of words with a marginal of `least` or more, as code point offsets of the text."""
    found = list(LETTERS.finditer(text.replace("\u0130", "i").lower()))  # as words_of() has them
    out: list[dict] = []
    for i in np.flatnonzero(p >= least):
        if out and out[-1]["_i"] == i - 1:
            out[-1] |= {"end": found[i].end(), "_i": i, "p": max(out[-1]["p"], float(p[i]))}
        else:
            out.append({"start": found[i].start(), "end": found[i].end(), "p": float(p[i]), "_i": i})
    return [{k: v for k, v in s.items() if k != "_i"} for s in out]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicField:
    """Fits on a bounded sample (see SAMPLE_DOCS) of the labelled rows that may be learnt from. Of several labels of an
    id the largest counts, of several texts the first by code point; rows without a label, an id or a text aren't
    learnt from."""
    spark = docs.sparkSession
    pool = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & learnable("i")).groupBy("i").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in pool.groupBy("y").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("i", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, SAMPLE_DOCS / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, SAMPLE_DOCS / max(1, counts.get(0, 0)))))
    drawn = [(r["i"], r["y"]) for r in pool.where(u < share).collect()]
    if not drawn:
        return ToxicField()
    # about 2 x SAMPLE_DOCS ids at most: a broadcast of proven size
    ids = F.broadcast(spark.createDataFrame(drawn, f"i {docs.schema[id_col].dataType.simpleString()}, y int"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("x")).where(F.col("x").isNotNull()).join(ids, "i")
    rows = rows.groupBy("i", "y").agg(F.min("x").alias("x"))  # one text for each id
    order = Window.partitionBy("y").orderBy(F.length("x") > LONG_CHARS, F.xxhash64("i", F.lit(33)), "i")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("chars", F.sum(F.length("x")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = sorted(((r["i"], r["x"], r["y"]) for r in rows.where((F.col("place") == 1) | (F.col("chars") <= SAMPLE_CHARS)).select("i", "x", "y").collect()), key=lambda r: (r[0], r[1]))
    return fit([r[1] for r in got], [r[2] for r in got])


SPANS = "array<struct<start:long,end:long,p:double>>"


def score(docs: DataFrame, model: ToxicField, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Per row of docs: id_col, held_out, score, predicted (1 if score >= 0.3), and with spans the toxic spans.

    A null text counts as empty; its score is that of a document without words. Null ids and repeated rows are
    returned as they are; other columns aren't read. An empty table gives no rows. Texts of any length are read
    whole. Equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Memo(TABLE_ROWS)
        for batch in batches:
            scores, found = [], []
            for _, _, texts in text_slices(batch, "_text"):
                p, sizes, s = tag(shared.value, table, texts)
                scores += s.tolist()
                if spans:
                    at = 0
                    for t, n in zip(texts, sizes, strict=True):
                        found.append(spans_of(t, p[at : at + n]) if n and p[at : at + n].max() >= 0.5 else [])
                        at += n
            cols = [batch.column(0), pa.array(scores, pa.float64())]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "score", "spans"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), f"_id {kind}, score double" + f", spans {SPANS}" * spans)
    return found.select(F.col("_id").alias(id_col), (~learnable("_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *(["spans"] if spans else []))
