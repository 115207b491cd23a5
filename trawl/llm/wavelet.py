"""Token-ID output (operator 6): each shard of token ids is one file, a wavelet matrix: one bit-plane for each bit
of an id, the high bit first; a plane's tokens are those of the plane before, zeros first and ones after. Rank and
select on the planes give access to any token, counts and places of occurrences without unpacking the rest.

File: MAGIC; header length (4 bytes, little-endian); header (JSON); sections. The planes lie in blocks of
BLOCK_BYTES bytes, each compressed by itself; a directory has each block's place and the ones before it, which serves
rank and, by binary search, select: either unpacks the blocks that it needs.
A store that only Spark can write to gets the files as rows of a Parquet table (column `file`).
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trawl.llm.common import mix64, settle, text_slices, tidy

MAGIC = b"TRWLWM01"
BLOCK_BYTES = 8192
#: A file is ended after the document with which it holds so many tokens.
FILE_TOKENS = 1 << 19
END_ID = 0
#: Words of the table; about 30 bytes each.
TABLE_ROWS = 2_000_000
#: Longer words aren't kept.
KEPT_BYTES = 64
#: How many bytes of eight count, as masks.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A space beside other white space: where such a text is split depends on more than one word.
MIXED_SPACE = re.compile(r" \s|\s ")
ASCII_SPACE = np.isin(np.arange(256), (*range(9, 14), *range(28, 33)))


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A file over ids (unsigned integers); lengths (of the documents, in order) add up to their number."""
    ids = np.ascontiguousarray(ids)
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1).compress
    header: dict = {"n": len(ids), "bits": bits, "docs": len(doc_ids), "zeros": []}
    sections: list[bytes] = [
        press(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), press(np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()), press(np.array(lengths, "<i8").tobytes()),
    ]
    now = ids
    for b in range(bits - 1, -1, -1):
        ones = (now & (1 << b)) != 0
        packed = np.packbits(ones, bitorder="little")
        blocks = [press(packed[i : i + BLOCK_BYTES].tobytes()) for i in range(0, len(packed), BLOCK_BYTES)]
        counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BYTES), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        header["zeros"].append(int(len(now) - counts.sum()))
        ends = np.cumsum([len(x) for x in blocks], dtype=np.int64)
        sections += [(ends - [len(x) for x in blocks]).astype("<i8").tobytes() + np.array([ends[-1] if len(ends) else 0], "<i8").tobytes(), (np.cumsum(counts) - counts).astype("<i8").tobytes(), b"".join(blocks)]
        if b:
            now = np.concatenate([now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))])
    header["sections"] = [len(s) for s in sections]
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class WaveletFile:
    """Reads a file; blocks are unpacked as they are needed."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        (size,) = struct.unpack_from("<I", data, 8)
        self.header = json.loads(data[12 : 12 + size])
        self.n, self.bits, self.zeros = self.header["n"], self.header["bits"], self.header["zeros"]
        view, at, parts = memoryview(data), 12 + size, []
        for n in self.header["sections"]:
            parts.append(view[at : at + n])
            at += n
        unpress = zstandard.ZstdDecompressor().decompress
        nulls = np.unpackbits(np.frombuffer(unpress(parts[1]), np.uint8), count=self.header["docs"]).astype(bool)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(np.frombuffer(unpress(parts[0]), "<i8"), nulls, strict=True)]
        self.lengths = np.frombuffer(unpress(parts[2]), "<i8")
        self.planes = [(np.frombuffer(parts[3 + 3 * k], "<i8"), np.frombuffer(parts[4 + 3 * k], "<i8"), parts[5 + 3 * k]) for k in range(self.bits)]
        self._block = functools.lru_cache(256)(self._read_block)

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        places, _, data = self.planes[plane]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[places[block] : places[block + 1]]), np.uint8)

    def _plane(self, plane: int) -> np.ndarray:
        """All bits of a plane."""
        blocks = len(self.planes[plane][1])
        packed = np.concatenate([self._read_block(plane, b) for b in range(blocks)]) if blocks else np.zeros(0, np.uint8)
        return np.unpackbits(packed, count=self.n, bitorder="little").view(bool)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before place i."""
        byte, bit = divmod(i, 8)
        block, byte = divmod(byte, BLOCK_BYTES)
        before = self.planes[plane][1]
        if block >= len(before):
            return self.n - self.zeros[plane]
        data = self._block(plane, block)
        n = int(before[block]) + int(np.bitwise_count(data[:byte]).sum())
        return n + ((int(data[byte]) & ((1 << bit) - 1)).bit_count() if bit else 0)

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            block, byte = divmod(i // 8, BLOCK_BYTES)
            bit = self._block(k, block)[byte] >> (i % 8) & 1
            ones = self._rank1(k, i)
            value, i = value << 1 | int(bit), self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._rank1(k, start), self._rank1(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token between two places."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, plane: int, one: bool, numbers: np.ndarray) -> np.ndarray:
        """The places of the bits of a kind with these numbers (from 0)."""
        before, span = self.planes[plane][1], 8 * BLOCK_BYTES
        counts = before if one else np.arange(len(before)) * span - before
        block = np.searchsorted(counts, numbers, "right") - 1
        out = np.empty(len(numbers), np.int64)
        for k in np.unique(block).tolist():
            bits = np.unpackbits(self._block(plane, k), bitorder="little")
            mine = block == k
            out[mine] = k * span + np.flatnonzero(bits == one)[numbers[mine] - counts[k]]
        return out

    def _places(self, token: int, first: int, last: int) -> np.ndarray:
        """The places of the occurrences of a token from number first up to last, from the last plane up."""
        a, _ = self._range(token, 0, self.n)
        at = np.arange(a + first, a + last)
        for k in range(self.bits - 1, -1, -1) if len(at) else ():
            one = bool(token >> (self.bits - 1 - k) & 1)
            at = self._select(k, one, at - self.zeros[k] * one)
        return at

    def select(self, token: int, number: int) -> int:
        """The place of the occurrence of a token with this number, from 0."""
        if not 0 <= number < self.count(token):
            raise IndexError(number)
        return int(self._places(token, number, number + 1)[0])

    def locate(self, token: int) -> np.ndarray:
        """All places of a token."""
        return self._places(token, 0, self.count(token))

    def decode(self) -> np.ndarray:
        """All tokens, from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            ones = self._plane(k)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = now[: self.zeros[k]]
            out[np.flatnonzero(ones)] = now[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            now = out
        return now


class WordTable:
    """Words' ids by two hashes of the words, in arrays: sorted keys, checks, and places in a pool of ids. At most
    TABLE_ROWS words are held; then the older half goes."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.runs = [none, none]  # old and recent: keys, checks, places, lengths
        self.pool, self.used = np.zeros(1 << 16, kind), 0

    def add_ids(self, ids: np.ndarray) -> int:
        """Puts ids into the pool; where they start."""
        if self.used + len(ids) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(ids)), self.kind)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (-1 if unknown), lengths, and whether another word has the key, for sorted keys."""
        place, length, taken = np.full(len(keys), -1), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for known, second, at, n in self.runs:
            if len(known):
                i = np.searchsorted(known, keys)
                i[i == len(known)] = 0
                hit = known[i] == keys
                same = hit & (second[i] == checks)
                place[same], length[same] = at[i[same]], n[i[same]]
                taken |= hit & ~same
        return place, length, taken

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """New words with their ids, one after the other; their places."""
        ends = np.cumsum(lengths)
        at = self.add_ids(ids) + ends - lengths
        old, recent = self.runs
        recent = self._merged(recent, (keys, checks, at, lengths))
        if len(recent[0]) > max(1 << 16, len(old[0]) // 4):
            old, recent = self._merged(old, recent), tuple(x[:0] for x in recent)
        self.runs = [old, recent]
        return at

    def trim(self) -> None:
        """Drops the older half if there are too many words; before a round, as places change."""
        keys, checks, at, n = self._merged(*self.runs)
        if len(keys) <= TABLE_ROWS:
            return
        cut = int(np.median(at))
        kept = at >= cut
        self.runs = [(keys[kept], checks[kept], at[kept] - cut, n[kept]), tuple(x[:0] for x in (keys, checks, at, n))]
        self.pool, self.used = self.pool[cut : self.used].copy(), self.used - cut

    @property
    def words(self) -> int:
        return sum(len(r[0]) for r in self.runs)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


class Encoder:
    """Ids of whole texts as the tokenizers library gives them. Where its rules split texts before every space,
    texts are cut there, and each distinct word is encoded once while it stays in a bounded table."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        before = rules["pre_tokenizer"] or {}
        self.special = [t["content"] for t in rules["added_tokens"]]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.table = WordTable(self.kind)
        # drawn for each process, so that no text can be made to have two words of one key
        self.seeds = np.random.default_rng().integers(0, 2**64, 2, np.uint64)
        # ids with a space in them; the library writes it as U+0120
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.spaced[i] = "\u0120" in token
        self.by_word = rules["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it, and how many each has. They are encoded in one text: a word has
        one space, at its start, so the ids with a space are those that start words."""
        parts = [" " + " ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(words):
            raise ValueError("this vocabulary splits words in another way")
        return ids, np.diff(starts, append=len(ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, without an end, as bytes."""
        if not self.by_word:
            return [self._ids(t).tobytes() for t in texts]
        if not texts:
            return []
        if self.table.words > TABLE_ROWS:
            self.table.trim()
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join([b"\n", *parts, b""])
        buffer = np.frombuffer(data, np.uint8)
        sizes = np.array(list(map(len, parts)))
        ends = np.cumsum(sizes + 1) + 1
        spaces = np.flatnonzero(buffer == 32)
        owner = np.searchsorted(ends, spaces)
        if whole := self._whole(texts, data, buffer, spaces, owner):
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            return [self._ids(t).tobytes() if i in whole else next(rest) for i, t in enumerate(texts)]
        per_text = np.bincount(owner, minlength=len(texts))
        stops = np.minimum(np.append(spaces[1:], len(data)), ends[owner]) if len(spaces) else spaces
        # what stands before the first space of each text
        heads = np.append(spaces, 0)[np.minimum(np.cumsum(per_text) - per_text, len(spaces))]
        heads = np.where(per_text > 0, heads, ends)
        firsts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip((ends - sizes).tolist(), heads.tolist(), strict=True)]
        lead = [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False)]
        place, length, kept = self._places(data, spaces + 1, stops)
        total = np.cumsum(length)
        ids = self.table.pool.take(np.arange(int(total[-1]) if len(total) else 0) + np.repeat(place - total + length, length))
        self.table.used = kept  # what words outside the table had is given up
        body, bounds = ids.tobytes(), (np.concatenate([[0], total]) * self.width).tolist()
        last = np.cumsum(per_text)
        return [first + body[bounds[a] : bounds[b]] for first, a, b in zip(lead, (last - per_text).tolist(), last.tolist(), strict=True)]

    def _whole(self, texts: list[str], data: bytes, buffer: np.ndarray, spaces: np.ndarray, owner: np.ndarray) -> set[int]:
        """Texts that can't be cut at their spaces: one stands beside other white space or at an end, or a special
        string is in the text."""
        before, after = buffer[spaces - 1], buffer[spaces + 1]
        whole = {*np.unique(owner[ASCII_SPACE[before] | ASCII_SPACE[after]]).tolist()}
        # beside what may be white space beyond ASCII: its first byte after, its last but one before
        maybe = (before >= 0x80) & np.isin(buffer[spaces - 2], (0xC2, 0x80, 0x81, 0x9A)) | np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
        whole.update(i for i in np.unique(owner[maybe]).tolist() if MIXED_SPACE.search(texts[i]))
        for special in self.special:
            if special.encode() in data:
                whole.update(i for i, t in enumerate(texts) if special in t)
        return whole

    def _keys(self, data: bytes, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each word (its place and length), over its bytes by eights."""
        eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
        first, second = (mix64(n.astype(np.uint64) + s) for s in self.seeds)
        some, k = np.arange(len(n)), 0
        while len(some):
            part = eights[start[some] + k] & MASKS[np.minimum(n[some] - k, 8)]
            first[some], second[some] = mix64(first[some] ^ part), mix64(second[some] + part * self.seeds[1])
            k += 8
            some = some[n[some] > k]
        return first, second

    def _places(self, data: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Where in the pool the ids of each word lie, how many they are, and how much of the pool the table holds:
        words that are too long for the table, or share a key with another, lie beyond it."""
        n = stop - start
        place, length = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        short = np.flatnonzero(n <= KEPT_BYTES)
        keys, checks = self._keys(data, start[short], n[short])
        distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
        where, many, taken = self.table.find(distinct, checks[first])
        unknown = np.flatnonzero((where < 0) & ~taken)
        if len(unknown):
            at = short[first[unknown]]
            words = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
            ids, counts = self._word_ids(words)
            where[unknown], many[unknown] = self.table.add(distinct[unknown], checks[first[unknown]], ids, counts), counts
        place[short], length[short] = where[number], many[number]
        kept = self.table.used
        single = n > KEPT_BYTES
        single[short] = taken[number] | (checks != checks[first][number])
        for w in np.flatnonzero(single).tolist():
            ids, counts = self._word_ids([data[start[w] : stop[w]].decode("utf-8", "surrogatepass")])
            place[w], length[w] = self.table.add_ids(ids), counts[0]
        return place, length, kept


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs, in ascending order of id_col, to wavelet files in the shared folder; each document ends with
    END_ID. Rows of equal id are in order of a hash of their texts, so they may lie in several files. Returns the
    table of files: part, seq (their order), n_docs, n_tokens, file."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number: files are in its order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer_path)
        end = struct.pack({2: "<H", 4: "<I"}[encoder.width], END_ID)
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, doc_ids, lengths
            file = build(np.frombuffer(b"".join(held), encoder.kind), doc_ids, lengths)
            made = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([sum(lengths)], pa.int64()), "file": pa.array([file], pa.binary())})
            seq, held, doc_ids, lengths = seq + 1, [], [], []
            return made

        tokens = 0
        for batch in batches:
            for a, b, texts in text_slices(batch, "_text"):
                for i, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encoder.encode(texts), strict=True):
                    held += (ids, end)
                    doc_ids.append(i)
                    lengths.append(len(ids) // encoder.width + 1)
                    tokens += lengths[-1]
                    if tokens >= FILE_TOKENS:
                        yield flush()
                        tokens = 0
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    dealt = rows.withColumn("_hash", F.xxhash64("_text")).repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash", "_text")
    return settle(dealt.select("_id", "_text").mapInArrow(tidy(run), "part int, seq int, n_docs long, n_tokens long, file binary"), "wavelet")


def read_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id_col, start (tokens of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, file = (batch.column(c)[row].as_py() for c in range(3))
                found = WaveletFile(file)
                ids = found.decode().astype("<u4")
                ends = np.cumsum(found.lengths)
                starts = ends - found.lengths
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts, ends, strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(found.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(found.lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "_id", "at", "n_tokens", "ids_crc32"])

    read = files.select("part", "seq", "file").mapInArrow(tidy(run), "part int, seq int, _id long, at long, n_tokens long, ids_crc32 long")
    # where each part starts (a row for each task that wrote), then each file in its part
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    places = files.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("file_start"))
    places = places.join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("part_start") + F.col("file_start")).alias("first"))
    return read.join(places, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select(F.col("_id").alias(id_col), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of docs and reads them back: id_col (long), start, n_tokens (with the end), ids_crc32.

    A null text counts as empty (one token, its end). Rows of equal id lie side by side, in order of a hash of their
    texts; null ids come first; ids that aren't whole numbers are an error. Other columns aren't read. A text of any
    length is encoded whole. An empty table gives no files and no rows.
    """
    return read_files(write_files(docs, tokenizer_path, id_col, text_col), id_col)
