"""Token counts (operator 2): pieces are counted once per distinct pre-token and summed over the
frequencies of each document's pre-tokens; no ids are made for whole texts.

A pre-token is a run of spaces with what follows up to the next space. The vocabulary has no piece with a
space mark behind another character (checked when the model is loaded), so no merge crosses a pre-token's
start, and the sum over pre-tokens equals the count for the whole text.

The join is done where the documents are: each task keeps a bounded table (pre-token -> pieces) and looks up
the frequencies of its documents in it. A join by shuffle would move (document, pre-token, frequency) rows,
several times the input; README has the figures.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import Memo, text_slices, tidy

MARK = "▁"
PRETOKEN = re.compile(r" +[^ ]*")
#: Distinct pre-tokens that a task's table holds at most (a generation).
TABLE_ROWS = 400_000
#: Longer pre-tokens aren't kept in the table.
KEPT_CHARS = 64


@functools.cache
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError("a piece of this vocabulary crosses the start of a word; pre-tokens can't be counted alone")
    return model


@functools.cache
def _table(path: str) -> Memo:
    return Memo(TABLE_ROWS)


def count_pretokens(model, pretokens: list[str]) -> list[int]:
    """Pieces of each pre-token. Its first space is left out: the model puts one before any text."""
    counts = [len(ids) for ids in model.encode([p[1:] for p in pretokens], num_threads=1)]
    for i, p in enumerate(pretokens):
        if p == " ":  # a last space, alone, for which the model would get an empty text
            counts[i] = len(model.encode("a ")) - len(model.encode("a"))
    return counts


def frequencies(text: str) -> Counter:
    """The pre-tokens of a text, with the space that the model adds, and how often each occurs."""
    if not text:
        return Counter()
    return Counter(PRETOKEN.findall(f" {text}".replace(MARK, " ")))


def count_texts(model, table: Memo, texts: list[str]) -> list[int]:
    freqs = [frequencies(t) for t in texts]
    distinct: set[str] = set()
    for f in freqs:
        distinct.update(f)
    long = [p for p in distinct if len(p) > KEPT_CHARS]
    pieces = table.fill(distinct.difference(long), lambda new: count_pretokens(model, new))
    if long:
        extra = dict(zip(long, count_pretokens(model, long), strict=True))
        return [sum(n * (pieces[p] if p in pieces else extra[p]) for p, n in f.items()) for f in freqs]
    return [sum(map(lambda p, n: pieces[p] * n, f.keys(), f.values())) for f in freqs]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. A null id and repeated rows are returned as they are; other
    columns of docs aren't read, whatever their names. An empty table gives no rows. No column of the result but
    id_col takes its name from docs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _model(model_path), _table(model_path)
        for batch in batches:
            counts: list[int] = []
            for _, _, texts in text_slices(batch, "_text"):
                counts += count_texts(model, table, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["_id", "_bytes", "_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("_bytes"), text.alias("_text"))
        .mapInArrow(tidy(count), f"_id {kind}, _bytes long, _tokens long")
        .select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"))
    )
