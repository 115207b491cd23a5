"""MinHash near-deduplication (operator 10) by a multi-index Hamming join.

1. A document's set of word shingles gives a signature of POSITIONS MinHash values, cut to 16 bits each. Documents of
   equal sets (equal 128-bit digests) are one class, and only classes go on, under whole numbers of their own.
2. Pigeonhole: of CHUNKS chunks with WIDTH positions each, two signatures that differ in at most DISTANCE positions
   have a chunk with at most one difference (2 x CHUNKS > DISTANCE). All patterns of one error in a chunk are
   enumerated: a class has a key for each chunk and each position left out. Such a pair shares a key.
3. First pass: in each bucket of a key every class is paired with the least one (buckets of many members are cut into
   parts, whose least ones are paired in turn); pairs under the distance are
   confirmed on full sets, and what is linked becomes one component. Second pass: in buckets that still hold
   several components, all pairs across them are compared by signature, in blocks; what is under the distance hangs
   together in loose groups (only enough pairs to hold them together leave a task), and the members of a loose group
   are compared by their full sets in cells of bounded size. Pairs within a component can't change the result. So no
   link between signatures under the distance is missed, and no group is expanded into rows of pairs.

At the true similarity of 0.75, 68 positions differ in 17 on average, with a deviation of 3.6; DISTANCE lies 4.6
deviations above. All pairs under the distance that sizes allow are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import HOT_ROWS, discard, mix64, settle, spread_join, text_slices, tidy
from trawl.llm.graph import components

SHINGLE = 5
#: A link: 100 x intersection >= SIMILAR x union.
SIMILAR = 75
CHUNKS, WIDTH = 17, 4
POSITIONS = CHUNKS * WIDTH
DISTANCE = 2 * CHUNKS - 1
#: Members of a bucket that a task compares at once; larger buckets are cut into blocks of about so many.
BLOCK = 1000
#: Members of a loose group, and shingles of theirs, that a task compares at once, about.
MEMBERS, SHINGLES = 1000, 4_000_000
#: Ids that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Keys of large buckets that are told apart at most, by a sketch of frequent items with room for so many.
TOP_KEYS, TRACKED = 2000, 16_384

_rng = np.random.default_rng(20240501)
_FLIP = _rng.integers(0, 2**64, POSITIONS, np.uint64)
_TIMES = _rng.integers(0, 2**64, POSITIONS, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's set of shingles, as sorted 64-bit hashes. A text of fewer words is one shingle; one without
    words has an empty set."""
    held = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for ws in held for w in ws), np.int64, sum(map(len, held)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    words = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(0, len(words) - SHINGLE + 1)
    rolled = np.full(n, np.uint64(SHINGLE))
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            rolled = rolled * _STEP + words[k : n + k]
        rolled = mix64(rolled)
        out, at = [], 0
        for ws in held:
            if len(ws) >= SHINGLE:
                out.append(np.unique(rolled[at : at + len(ws) - SHINGLE + 1]))
            elif ws:
                short = np.array([len(ws)], np.uint64)
                for k in range(len(ws)):
                    short = short * _STEP + words[at + k]
                out.append(mix64(short))
            else:
                out.append(np.zeros(0, np.uint64))
            at += len(ws)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For non-empty sets: POSITIONS values of 16 bits."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    every = np.concatenate(sets)
    values = np.empty((len(sets), POSITIONS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(POSITIONS):
            values[:, k] = np.minimum.reduceat((every ^ _FLIP[k]) * _TIMES[k], starts)
        return (mix64(values + np.arange(POSITIONS, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _features(docs: DataFrame, keep_sets: bool = False) -> DataFrame:
    """docs (id, text, others) to id, the others, n (of the set), digest (128 bits of the set; null if empty; two
    different sets of a corpus of m share one with a chance of m^2 / 2^129), then sig, or the set itself."""

    others = [c for c in docs.columns if c not in ("id", "text")]
    names = ["id", *others, "n", "digest", "set" if keep_sets else "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                sets = shingle_sets(texts)
                n = [len(s) for s in sets]
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                cols = [*(batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in ("id", *others)), pa.array(n, pa.int64()), pa.array(digest, pa.binary())]
                if keep_sets:
                    cols.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                else:
                    full = [s for s in sets if len(s)]
                    sigs = iter(signatures(full)) if full else iter(())
                    cols.append(pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("id", *others))
    return docs.mapInArrow(tidy(run), f"{kept}, n long, digest binary, " + ("set binary" if keep_sets else "sig binary"))


def _rows(col: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """All keys of signatures (rows): the chunk and the position left out, then the chunk's other values."""
    parts = sig.reshape(-1, CHUNKS, WIDTH).astype(np.int64)
    out = np.empty((len(sig), CHUNKS, WIDTH), np.int64)
    for left_out in range(WIDTH):
        key = (np.arange(CHUNKS, dtype=np.int64) * WIDTH + left_out)[None, :]
        for k in range(WIDTH):
            if k != left_out:
                key = key << 16 | parts[:, :, k]
        out[:, :, left_out] = key
    return out.reshape(len(sig), -1)


def _keys(classes: DataFrame, *others: str) -> DataFrame:
    """classes (cls, sig, others) to rows (key, cls, others); others are longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(_rows(batch.column(0), POSITIONS, np.uint16))
                beside = [pa.array(np.repeat(c.to_numpy(), keys.shape[1])) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *beside], names=["key", "cls", *others])

    return classes.select("sig", "cls", *others).mapInArrow(tidy(run), "key long, cls long" + "".join(f", {c} long" for c in others))


def _hub_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b): every class of a bucket with the least one. A bucket of many members is cut into parts of about
    BLOCK; each member is paired with its part's least one, and those with the bucket's."""
    keys = _keys(classes)
    top = keys.agg(F.expr(f"approx_top_k(key, {TOP_KEYS}, {TRACKED})").alias("top")).select(F.inline("top"))
    top = top.where(F.col("count") > HOT_ROWS).select(F.col("item").alias("hot"), F.ceil(F.col("count") / BLOCK).alias("parts"))
    held = keys.join(F.broadcast(top), F.col("key") == F.col("hot"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("cls"), F.col("parts")), F.lit(0).cast("long")))
    hub = F.min("cls").over(Window.partitionBy("key", "part"))
    held = settle(held.withColumn("hub", hub).where((F.col("cls") != F.col("hub")) | F.col("hot").isNotNull()).select("hot", "hub", "cls"), "hubs")
    hubs = held.where(F.col("cls") == F.col("hub")).withColumn("first", F.min("hub").over(Window.partitionBy("hot"))).where(F.col("first") != F.col("hub"))
    pairs = held.where(F.col("cls") != F.col("hub")).select(F.col("hub").alias("a"), F.col("cls").alias("b")).unionByName(hubs.select(F.col("first").alias("a"), F.col("hub").alias("b")))
    made = settle(pairs.distinct(), "pairs")
    discard(held)
    return made


def near_enough(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs (rows of both sides) are under the distance, of sizes that a link allows."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    fine = 100 * small >= SIMILAR * large
    fine[fine] = (sig_a[fine] != sig_b[fine]).sum(axis=1) <= DISTANCE
    return fine


def _under_distance(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near enough."""
    side = lambda x: classes.select(F.col("cls").alias(f"cls_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    joined = pairs.join(side("a"), F.col("a") == F.col("cls_a")).join(side("b"), F.col("b") == F.col("cls_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = batch.column
                fine = near_enough(_rows(c(2), POSITIONS, np.uint16), _rows(c(3), POSITIONS, np.uint16), c(4).to_numpy(), c(5).to_numpy())
                yield pa.RecordBatch.from_arrays([c(0).filter(pa.array(fine)), c(1).filter(pa.array(fine))], names=["a", "b"])

    return joined.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(tidy(run), "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """(cls, set) of the needed classes, from the text of one document of each."""
    wanted = settle(classes.join(needed, "cls", "left_semi").select("cls", "rep", "digest"), "needed")
    ids = wanted.select(F.col("rep").alias("id"))
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    made = docs.join(ids, "id", "left_semi")
    if not wanted.where(F.col("rep").isNull()).isEmpty():  # classes of null ids only
        made = made.unionByName(docs.where(F.col("id").isNull()))
    made = _features(made.select("id", "text"), keep_sets=True)
    # an id may have several rows, with other texts too
    same = (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("rep"))
    sets = settle(made.join(wanted.withColumnRenamed("digest", "d"), same).select("cls", "set").dropDuplicates(["cls"]), "sets")
    discard(wanted)
    return sets


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets."""
    joined = pairs.join(sets.select(F.col("cls").alias("ca"), F.col("set").alias("sa")), F.col("a") == F.col("ca")).join(sets.select(F.col("cls").alias("cb"), F.col("set").alias("sb")), F.col("b") == F.col("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[row].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine, pa.bool_())), batch.column(1).filter(pa.array(fine, pa.bool_()))], names=["a", "b"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def _first_shared(eq: np.ndarray) -> np.ndarray:
    """The first key (its number) that pairs share; eq: which positions agree."""
    parts = eq.reshape(-1, CHUNKS, WIDTH)
    shared = (parts.sum(axis=2, keepdims=True) - parts) == WIDTH - 1
    return shared.reshape(len(eq), -1).argmax(axis=1)


def _forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs join parts that those before them left apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    fine = np.zeros(len(left), bool)
    for k, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x], fine[k] = y, True
    return fine


def bucket_forest(key: int, split: bool, comp: np.ndarray, side: np.ndarray, cls: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that hold together what is near enough across components in a cell of a bucket; of several buckets that
    hold a pair, the first looks at it. split: only pairs of both sides."""
    number = key >> 48
    left, right = [], []
    step = max(1, 2_000_000 // max(1, len(cls)))
    for at in range(0, len(cls), step):
        rows = np.arange(at, min(len(cls), at + step))
        later = rows[:, None] < np.arange(len(cls))[None, :]
        later &= comp[rows][:, None] != comp[None, :]
        if split:
            later &= side[rows][:, None] != side[None, :]
        later &= 100 * np.minimum(n[rows][:, None], n[None, :]) >= SIMILAR * np.maximum(n[rows][:, None], n[None, :])
        i, j = np.nonzero(later)
        i = rows[i]
        for a in range(0, len(i), 20_000):
            x, y = i[a : a + 20_000], j[a : a + 20_000]
            fine = near_enough(sig[x], sig[y], n[x], n[y])
            x, y = x[fine], y[fine]
            own = _first_shared(sig[x] == sig[y]) == number if len(x) else np.zeros(0, bool)
            left.append(x[own])
            right.append(y[own])
    none = np.zeros(0, np.int64)
    x, y = (np.concatenate(left), np.concatenate(right)) if left else (none, none)
    kept = _forest(x, y)
    return cls[x[kept]], cls[y[kept]]


def cell_links(split: bool, comp: np.ndarray, side: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links across components among a cell's members, by their full sets; none between what earlier links joined.
    split: only pairs of both sides."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    label = np.unique(comp, return_inverse=True)[1]
    left, right = [], []
    for a in range(len(sets) - 1):
        other = np.arange(a + 1, len(sets))
        other = other[(label[other] != label[a]) & (100 * np.minimum(n[other], n[a]) >= SIMILAR * np.maximum(n[other], n[a]))]
        if split:
            other = other[side[other] != side[a]]
        own = ids[starts[a] : starts[a] + sizes[a]]
        mark[own] = 1
        for at in range(0, len(other), 500):  # what is gathered at once stays small
            some = other[at : at + 500]
            held = np.concatenate([ids[starts[b] : starts[b] + sizes[b]] for b in some.tolist()])
            both = np.add.reduceat(mark[held], np.cumsum(sizes[some]) - sizes[some])
            for b in some[100 * both >= SIMILAR * (sizes[a] + sizes[some] - both)].tolist():
                if label[a] != label[b]:
                    left.append(a)
                    right.append(b)
                    label[label == label[b]] = label[a]
        mark[own] = 0
    return left, right


def _by_cell(rows: DataFrame, keys: list[str], look, schema: str) -> DataFrame:
    """Rows of each cell (equal keys) to look(key values, table), a batch or None; cells are read one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(len(keys))], axis=1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                now = tuple(at[a].tolist())
                if last is not None and now != last:
                    if (made := look(last, pa.Table.from_batches(held).combine_chunks())) is not None:
                        yield made
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held and (made := look(last, pa.Table.from_batches(held).combine_chunks())) is not None:
            yield made

    return rows.repartition(*keys).sortWithinPartitions(*keys, "cls").mapInArrow(tidy(run), schema)


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]) if len(a) else None


def _cells(rows: DataFrame) -> DataFrame:
    """rows with blocks: members are dealt to as many blocks, and every pair of blocks is a cell (i, j) of its own."""
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    made = rows.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return made.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other", "blocks")


def _loose_pairs(classes: DataFrame, active: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) that hold together what is near enough across components in buckets with several of them."""
    some = settle(classes.join(active, "cls", "left_semi").join(comps.select(F.col("node").alias("c"), "component"), F.col("cls") == F.col("c"), "left").select("cls", "sig", "n", F.coalesce("component", "cls").alias("comp")), "active")
    keys = settle(_keys(some, "comp"), "keys")
    mixed = keys.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("members")).where(F.col("x") != F.col("y")).select("key", "members")
    members = spread_join(keys, mixed, "key", "members", keys.count(), "cls").where(F.col("members").isNotNull())
    members = members.select("key", "cls", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = _cells(members).join(some.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c")).select("key", "i", "j", "side", "cls", "comp", "n", "sig")

    def look(at: tuple, whole: pa.Table) -> pa.RecordBatch | None:
        if whole.num_rows < 2:
            return None
        col = lambda c: whole.column(c).to_numpy()
        return _pairs_batch(*bucket_forest(at[0], at[1] != at[2], col("comp"), col("side"), col("cls"), col("n"), np.frombuffer(b"".join(whole.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)))

    return _by_cell(rows, ["key", "i", "j"], look, "a long, b long")


def _second_pass(docs: DataFrame, classes: DataFrame, active: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (a, b) across components. What is near enough hangs together in loose groups; each group's members are
    compared by their full sets, where they are, in cells of bounded size."""
    groups = components(_loose_pairs(classes, active, comps).select(F.col("a").alias("u"), F.col("b").alias("v")))
    sets = _sets(docs, classes, groups.select(F.col("node").alias("cls")))
    rows = groups.withColumnsRenamed({"node": "cls", "component": "loose"}).join(classes.select("cls", "n"), "cls").join(comps.select(F.col("node").alias("c"), "component"), F.col("cls") == F.col("c"), "left").select("cls", "loose", "n", F.coalesce("component", "cls").alias("comp"))
    rows = settle(rows, "loose")
    sizes = rows.groupBy("loose").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks")).withColumnRenamed("loose", "l")
    cells = _cells(rows.join(sizes, F.col("loose") == F.col("l")).drop("l")).join(sets.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c")).select("loose", "i", "j", "side", "cls", "comp", "n", "set")

    def look(at: tuple, whole: pa.Table) -> pa.RecordBatch | None:
        if whole.num_rows < 2:
            return None
        col = lambda c: whole.column(c).to_numpy()
        cls = col("cls")
        left, right = cell_links(at[1] != at[2], col("comp"), col("side"), col("n"), [np.frombuffer(x, np.uint64) for x in whole.column("set").to_pylist()])
        return _pairs_batch(cls[left], cls[right])

    return _by_cell(cells, ["loose", "i", "j"], look, "a long, b long")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id (the least id that links reach, its own included) and kept
    (its id is that one).

    A null text counts as empty; an empty set is linked with nothing. A null id is never a component's least id; a
    component of null ids only has a null component_id, and its rows are kept. Rows of equal id are nodes of their
    own; if they are alike, they have one fate. Other columns aren't read. An empty table gives no rows.
    """
    found = _find(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _find(docs: DataFrame) -> DataFrame:
    """docs (id, text, others) to id, the others, n, component_id, kept."""
    others = [c for c in docs.columns if c not in ("id", "text")]
    features = settle(_features(docs), "features")
    by_class = features.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("members"))
    # numbers are given once, as the table is written
    classes = settle(by_class.withColumn("cls", F.monotonically_increasing_id()), "classes")
    pairs = _hub_pairs(classes)
    ends = lambda p: p.select(F.col("a").alias("cls")).union(p.select("b")).distinct()
    active = settle(ends(pairs), "members")
    near = settle(_under_distance(pairs, classes), "near")
    sets = _sets(docs, classes, ends(near))
    links = settle(_confirm(near, sets), "confirmed")
    discard(pairs, near, sets)
    comps = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # second pass: pairs across components
    again = settle(_second_pass(docs, classes, active, comps), "again")
    comps = components(links.unionByName(again).select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.select("digest", "cls", "rep", "members").join(comps, F.col("cls") == F.col("node"), "left").select("digest", "rep", "members", F.coalesce("component", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes"))
    ids = spread_join(named, least, "comp", "classes", classes.count(), "digest").select("digest", "component_id", "members")
    joined = spread_join(features.select("id", *others, "n", "digest"), ids, "digest", "members", features.count(), F.monotonically_increasing_id())
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select("id", *others, "n", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that find() keeps, with the columns of docs, whatever their names. Rows of one id and text have
    one fate; rows of one id, or of a null id, that differ in text are judged each by its own text."""
    text = F.col(text_col)
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))  # with the id, it stands for the row
    found = _find(docs.select(F.col(id_col).alias("id"), text.alias("text"), digest.alias("row")))
    gone = found.where(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    every = docs.select(*(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(docs.columns)), F.col(id_col).alias("own_id"), digest.alias("own_row"))
    kept = every.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_row") == F.col("gone_row")), "left_anti")
    return kept.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))
