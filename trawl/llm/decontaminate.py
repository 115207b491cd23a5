"""Benchmark decontamination (operator 7) with suffix arrays of the training text.

Every shard (a slice of a task's documents) gets a suffix array over its words; every suffix of the benchmark that
starts a window is searched in it by binary search, which gives all verbatim occurrences and their places. The
array is sparse: it holds the suffixes that start with a pair of words (or, for items of one word, a word) with
which a window starts, since no other can match; words that the benchmark lacks end a match.

Windows that occur side by side, in the document and in the item, make one longer match; each item's longest is told.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words, each block a broadcast of that proven size,
of which the driver holds one at a time; a benchmark of several blocks takes as many passes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StringType, StructField, StructType

from trawl.llm.common import discard, settle, text_slices, tidy

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
BLOCK_WORDS = 250_000
SHARD_CHARS = 2_000_000


def words_of(text: str) -> list[bytes]:
    """Lower case for A-Z only, then the words, as UTF-8."""
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class Windows:
    """The distinct windows of a block of items, sorted, as rows of word numbers (0 fills short ones)."""

    vocabulary: dict[bytes, int]
    low: np.ndarray  # the windows' keys
    high: np.ndarray  # the largest key that starts with a window
    length: np.ndarray
    owner_at: np.ndarray  # where each window's owners start in the two arrays below
    owner: np.ndarray  # item number
    offset: np.ndarray  # the window's place in the item
    place: np.ndarray  # its place in the block, where no two items lie side by side
    items: list[str]
    pairs: np.ndarray  # codes of the first two words of windows
    singles: np.ndarray  # words that are windows


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as strings of bytes that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * WINDOW}").ravel() if len(rows) else np.zeros(0, f"S{4 * WINDOW}")


def windows_of(block: list[tuple[str, int, list[bytes]]]) -> Windows:
    """block: pieces of items: (id as text, where in the item the piece starts, words)."""
    names = sorted({i for i, _, _ in block})
    number = {n: k for k, n in enumerate(names)}
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], list[tuple[int, int, int]]] = defaultdict(list)
    at = 0
    for name, first, words in block:
        ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)
        for k in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
            owners[ids[k : k + WINDOW]].append((number[name], first + k, at + k))
        at += len(ids) + 1
    order = sorted(owners)
    rows = np.zeros((len(order), WINDOW), np.int64)
    length = np.array([len(w) for w in order], np.int64)
    for i, w in enumerate(order):
        rows[i, : len(w)] = w
    above = np.where(np.arange(WINDOW) < length[:, None], rows, 0xFFFFFFFF)
    held = [owners[w] for w in order]
    flat = np.array([x for h in held for x in h], np.int64).reshape(-1, 3)
    base = len(vocabulary) + 1
    many = length > 1
    return Windows(vocabulary, _keys(rows), _keys(above), length, np.cumsum([0, *map(len, held)]), flat[:, 0], flat[:, 1], flat[:, 2], names, np.unique(rows[many, 0] * base + rows[many, 1]), np.unique(rows[~many, 0]))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def search(windows: Windows, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of windows in a shard: (window, place). ids: word numbers, 0 for words that the benchmark
    lacks and between documents."""
    base = len(windows.vocabulary) + 1
    padded = np.concatenate([ids, np.zeros(WINDOW, ids.dtype)])
    start = np.zeros(len(ids), bool)
    if len(windows.pairs):
        both = np.flatnonzero((ids > 0) & (padded[1 : len(ids) + 1] > 0))
        start[both[_among(ids[both] * base + padded[both + 1], windows.pairs)]] = True
    if len(windows.singles):
        start |= (ids > 0) & _among(ids, windows.singles)
    places = np.flatnonzero(start)
    shortest = int(windows.length.min()) if len(windows.length) else WINDOW
    unknown = np.concatenate([[0], np.cumsum(padded == 0)])
    places = places[unknown[places + shortest] == unknown[places]]
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffixes = padded[places[:, None] + np.arange(WINDOW)]
    # what follows an unknown word or a document's end is no part of the suffix
    suffixes *= np.cumprod(suffixes > 0, axis=1)
    keys = _keys(suffixes)
    array = np.argsort(keys, kind="stable")
    keys, array = keys[array], places[array]
    first, last = np.searchsorted(keys, windows.low, "left"), np.searchsorted(keys, windows.high, "right")
    found = last - first
    hit = np.flatnonzero(found > 0)
    which = np.repeat(hit, found[hit])
    at = np.arange(len(which)) - np.repeat(np.cumsum(found[hit]) - found[hit], found[hit])
    return which, array[first[which] + at]


def _longest(windows: Windows, places: np.ndarray, which: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """Per item: words, start in the shard, start in the item of its longest match among a document's windows (in
    order of their places); of equal ones the first. At each place only the matches that go on there are held."""
    best: dict[int, tuple[int, int, int]] = {}
    edges = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
    now, since, last = np.zeros(0, np.int64), np.zeros(0, np.int64), -2
    for a, b in zip(edges, edges[1:], strict=False):
        at = int(places[a])
        own = np.concatenate([np.arange(windows.owner_at[w], windows.owner_at[w + 1]) for w in which[a:b].tolist()])
        size = np.repeat(windows.length[which[a:b]], windows.owner_at[which[a:b] + 1] - windows.owner_at[which[a:b]])
        order = np.argsort(windows.place[own])
        own, size = own[order], size[order]
        here, start = windows.place[own], np.full(len(own), at)
        if at == last + 1:
            i = np.minimum(np.searchsorted(now, here - 1), len(now) - 1)
            start = np.where(now[i] == here - 1, since[i], at)
        n = at - start + size
        order = np.lexsort((here, -n, windows.owner[own]))
        heads = order[np.unique(windows.owner[own][order], return_index=True)[1]]
        for k in heads.tolist():
            item = int(windows.owner[own[k]])
            if n[k] > best.get(item, (0,))[0]:
                best[item] = (int(n[k]), int(start[k]), int(windows.offset[own[k]] - (at - start[k])))
        now, since, last = here, start, at
    return best


def scan(windows: Windows, texts: list[str]) -> Iterator[tuple[np.ndarray, list[dict]]]:
    """Per text: which of its words are hit, and the items that occur, each with its longest verbatim match."""
    held = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in held], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    total = int(sizes.sum()) + len(held)
    get = windows.vocabulary.get
    ids = np.fromiter((i for ws in held for i in (*map(get, ws, repeat(0)), 0)), np.int64, total)
    which, place = search(windows, ids)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + windows.length[which], -1)
    hits = np.cumsum(edge) > 0
    order = np.argsort(place, kind="stable")
    which, place = which[order], place[order]
    bounds = np.searchsorted(place, [*starts.tolist(), total])
    for d in range(len(texts)):
        a, b = bounds[d], bounds[d + 1]
        found = _longest(windows, place[a:b], which[a:b]) if b > a else {}
        yield hits[starts[d] : starts[d] + sizes[d]], [{"item": windows.items[i], "doc_word": at - int(starts[d]), "item_word": offset, "n_words": n} for i, (n, at, offset) in sorted(found.items())]


MATCH = "struct<item:string,doc_word:long,item_word:long,n_words:long>"
MATCH_TYPE = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))


def _better(old: list[dict], new: list[dict]) -> list[dict]:
    """The matches of two blocks: an item's pieces and rows may lie in both, and the longer match counts."""
    best = {m["item"]: m for m in old}
    for m in new:
        if m["item"] not in best or (-m["n_words"], m["doc_word"]) < (-best[m["item"]]["n_words"], best[m["item"]]["doc_word"]):
            best[m["item"]] = m
    return [best[i] for i in sorted(best)]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, int, list[bytes]]]]:
    """The items, one block of at most BLOCK_WORDS words after the other; an item of more is cut into pieces that
    share WINDOW - 1 words, so that each of its windows lies in one."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    block: list[tuple[str, int, list[bytes]]] = []
    held = 0
    for row in rows.toLocalIterator():
        words = words_of(row["x"])
        for at in range(0, max(1, len(words) - WINDOW + 1), BLOCK_WORDS - WINDOW + 1):
            piece = words[at : at + BLOCK_WORDS]
            if held and held + len(piece) > BLOCK_WORDS:
                yield block
                block, held = [], 0
            block.append((row["i"], at, piece))
            held += len(piece)
    yield block


def annotate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", matches: bool = False) -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest
    verbatim match, 0 if none) and longest_at (the word of the document at which the first such match starts, from 0;
    null if none); with matches, each item's longest match (item, doc_word, item_word, n_words).

    A null text has no words and is never contaminated; an item without words has no window. Items of equal id are
    one item; a null item id counts as 'null'. Repeated rows of docs are returned as often as they occur, null ids
    too. An empty table gives no rows. Texts of any length are read whole; matches with an item of over BLOCK_WORDS
    words are measured within pieces of so many. Other columns aren't read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    now = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    middle = StructType([StructField("id", kind), StructField("text", StringType()), StructField("hits", BinaryType()), StructField("found", DataType.fromDDL(f"array<{MATCH}>"))])
    end = StructType([StructField("id", kind), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("found", DataType.fromDDL(f"array<{MATCH}>"))])
    blocks = _blocks(benchmark, item_col, item_text_col)
    block, first = next(blocks), True
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(windows_of(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=following is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, texts in text_slices(batch, "text", SHARD_CHARS):
                    part = batch.slice(a, b - a)
                    hits, found = map(list, zip(*scan(shared.value, texts), strict=True))
                    if not first:
                        hits = [h | np.unpackbits(np.frombuffer(o, np.uint8), count=len(h)).astype(bool) for h, o in zip(hits, part.column(2).to_pylist(), strict=True)]
                        found = [_better(o, f) for o, f in zip(part.column(3).to_pylist(), found, strict=True)]
                    matched = pa.array(found, MATCH_TYPE)
                    if last:
                        made = [part.column(0), pa.array([len(h) for h in hits], pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64()), matched]
                        yield pa.RecordBatch.from_arrays(made, names=end.names)
                    else:
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()), matched], names=middle.names)

        if following is None:
            now = now.mapInArrow(tidy(run), end)
        else:
            before, now = now, settle(now.mapInArrow(tidy(run), middle), "hits")
            shared.unpersist()
            if not first:
                discard(before)
        block, first = following, False
    names = F.transform("found", lambda m: m["item"])
    longest = F.coalesce(F.array_max(F.transform("found", lambda m: m["n_words"])), F.lit(0).cast("long"))
    at = F.array_min(F.transform(F.filter("found", lambda m: m["n_words"] == F.col("longest")), lambda m: m["doc_word"]))
    now = now.withColumn("longest", longest)
    return now.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest", at.alias("longest_at"), *([F.col("found").alias("matches")] if matches else []),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with the columns of docs: whatever is hit is
    affected, however long the document (the share in `contaminated` is for reports)."""
    row = F.struct(*(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(docs.columns)))
    found = annotate(docs.select(row.alias("row"), F.col(text_col).alias("text")), benchmark, id_col="row", **options)
    return found.where(F.col("n_hit") == 0).select(*(F.col(f"row.c{i}").alias(name) for i, name in enumerate(docs.columns)))
