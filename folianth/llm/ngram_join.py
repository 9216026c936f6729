"""N-gram Jaccard self-join with Bayesian pruning of candidates.

A document's shingles are its distinct runs of five words (fewer, but not none: all its words are
one shingle); words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased. Documents with equal shingle sets form a class; classes are compared:

1. each class gets MinHash values; bands of them make buckets (a pair at the threshold shares no
   bucket with probability (1 - t^ROWS)^BANDS, below 1e-5; a closer pair far less);
2. within buckets, MinHash values are compared a step at a time and a pair is dropped when the
   posterior probability that its similarity reaches the threshold falls below ``TOLERANCE``;
   what survives ties classes into candidate clusters;
3. within a cluster every pair that survives the same pruning is verified on the whole shingle
   sets. Buckets and clusters of any size are dealt out as pairs of blocks, so a task holds two
   blocks at most, and only counts and spanning edges leave it, never all pairs of a group.

Result, a row per input row: ``class_id`` (smallest id of the connected component of its links,
its own equals included), ``copy_id`` (smallest id with the same shingles), ``n_links`` (other rows
with similarity >= threshold; rows with equal shingles count), ``n_shingles``. Texts without words
and null texts have no shingles and no links; each is a class of its own. Rows of a null id are not
compared and get a null class. Repeated rows are copies of each other, whatever their ids. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianth.operators.components import components

from . import kernels as K
from .staging import staged

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
STEP = 30
#: A pair goes when its chance of reaching the threshold is below this.
TOLERANCE = 1e-7
#: Classes in a block, at least and at most; between the two, blocks grow with the root of the group, so that
#: each class of a large group is copied for fewer pairs of blocks. Bytes of shingles in a block that is verified.
BLOCK, LARGEST_BLOCK, BLOCK_GROWTH = 256, 2048, 4.0
BLOCK_BYTES = 8 << 20

_rng = np.random.default_rng(20240229)
_SEEDS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_FACTORS = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BAND_FACTORS = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, _, _, begin = K.words(data, at)
    n = len(hashes)
    runs = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        runs += hashes[k : n - SHINGLE + 1 + k] * _PLACES[k]
    runs = K.mix(runs)
    for a, b in zip(begin[:-1], begin[1:]):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        elif b > a:
            yield K.mix((hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """BANDS x ROWS values: the least of as many random functions over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        part = x[k : k + 4096][None, :] ^ _SEEDS
        part *= _FACTORS
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, th (a hash of the text), n_shingles, cls (names the shingle set; null without shingles), sig (a byte of each MinHash value), bands."""

    def make(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column(2))
            n, cls, sig, bands = [], [], [], []
            for i, j in K.slices(at):
                for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                    n.append(len(s))
                    if not len(s):
                        cls.append(None), sig.append(None), bands.append(None)
                        continue
                    least = minhash(s)
                    cls.append(set_id(s))
                    sig.append((least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
                    rows = least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
                    bands.append(K.mix((rows * _BAND_FACTORS).sum(axis=1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "n_shingles", "cls", "sig", "bands"])

    picked = docs.select(F.col(row_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(K.released(make), f"id {kind}, th bigint, n_shingles int, cls binary, sig binary, bands array<bigint>")


def least_matches(threshold: float, tolerance: float, step: int, total: int) -> list[tuple[int, int]]:
    """(values compared, matches needed) after each step.

    The similarity J has a uniform prior. Values are compared by one byte, so two differ with
    probability (1 - J) * 255/256. A count of matches is enough if P(J >= threshold | count) >= tolerance.
    """
    j = (np.arange(20000) + 0.5) / 20000
    p = j + (1 - j) / 256
    out = []
    for n in range(step, total + 1, step):
        need = n
        for m in range(n, -1, -1):
            log = m * np.log(p) + (n - m) * np.log1p(-p + 1e-300)
            weight = np.exp(log - log.max())
            if weight[j >= threshold].sum() / weight.sum() < tolerance:
                break
            need = m
        out.append((n, need))
    return out


def survivors(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, same: bool, threshold: float, needs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that the sizes and the step-wise posterior leave; of one block (same) each pair once."""
    small, large = np.minimum(n_left[:, None], n_right[None, :]), np.maximum(n_left[:, None], n_right[None, :])
    alive = small >= threshold * large - 1e-9
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    matches, done = np.zeros(len(i), np.int32), 0
    for n, need in needs:
        if not len(i):
            break
        for k in range(0, len(i), 1 << 16):
            cut = slice(k, k + (1 << 16))
            matches[cut] += (left[i[cut], done:n] == right[j[cut], done:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= need
        i, j, matches, done = i[keep], j[keep], matches[keep], n
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], pa.Table | None], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each key; the rows come sorted by key, a batch may end within one."""
    held: list[pa.Table] = []

    def key(t: pa.Table, k: int) -> tuple:
        return tuple(t.column(c)[k].as_py() for c in keys)

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            out = work(pa.concat_tables(held))
            held.clear()
            if out is not None and out.num_rows:
                yield from out.cast(schema).to_batches(max_chunksize=10_000)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for c in keys:
            column = t.column(c).combine_chunks()
            column = column.to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        borders = [0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]
        for a, b in zip(borders[:-1], borders[1:]):
            if held and key(held[-1], 0) != key(t, a):
                yield from done()
            held.append(t.slice(a, b - a))
    yield from done()


def n_blocks(n: Column) -> Column:
    """Blocks of a group of n."""
    return F.ceil(n / F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), BLOCK_GROWTH * F.sqrt(n)))).cast("int")


def block_pairs(rows: DataFrame, group: str, n_blocks: str, spread: str) -> DataFrame:
    """Deal each group out as pairs of blocks: adds bi, bj and ``side`` (0: the row is of block bi; 1: of bj)."""
    mine = F.pmod(F.xxhash64(spread, F.lit(7)), F.col(n_blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col(n_blocks) - 1), lambda o: F.struct(F.least("__b", o).cast("int").alias("bi"), F.greatest("__b", o).cast("int").alias("bj"), F.when(o < F.col("__b"), 1).otherwise(0).alias("side")))
    return rows.withColumn("__b", mine).withColumn("__p", F.explode(pairs)).select("*", "__p.*").drop("__b", "__p")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    if t.column("bi")[0] == t.column("bj")[0]:
        return t, t, True
    side = t.column("side").to_numpy()
    return t.take(np.flatnonzero(side == 0)), t.take(np.flatnonzero(side == 1)), False


def _by_name(names: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The order of class names and each one's place in it: the least of a cluster is then the same one in every bucket."""
    order = np.argsort(np.array(names.to_pylist(), object), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return order, place


def _joined(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
    return left if same else pa.concat_tables([left, right])


def candidate_clusters(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, root) of classes that a chain of unpruned pairs ties together."""
    width = BANDS * ROWS
    needs = least_matches(threshold, tolerance, STEP, width)
    banded = reps.select("cls", "n_shingles", "sig", F.posexplode("bands").alias("band", "bucket"))
    keyed = banded.select(F.xxhash64("band", "bucket").alias("bucket"), "cls")
    # Copies share many buckets: of those with the same members, which an order-free hash tells, one is enough.
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(2))).alias("y")).where("n > 1")
    crowded = crowded.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    crowded = staged(crowded.select("bucket", n_blocks(F.col("n")).alias("blocks")), "buckets")
    members = keyed.join(crowded, "bucket").join(reps.select("cls", "n_shingles", "sig"), "cls")
    dealt = block_pairs(members, "bucket", "blocks", "cls").drop("blocks")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def work(t: pa.Table) -> pa.Table | None:
        left, right, same = _sides(t)
        if not left.num_rows or not right.num_rows:
            return None
        i, j = survivors(_matrix(left["sig"], width), _matrix(right["sig"], width), left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy(), same, threshold, needs)
        if not len(i):
            return None
        names = _joined(left, right, same)["cls"]
        order, place = _by_name(names)
        root = forest(len(names), place[i], place[j if same else j + left.num_rows])
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": names.take(order[tied]), "b": names.take(order[root[tied]])})

    keys = ["bucket", "bi", "bj"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    edges = dealt.mapInArrow(K.released(lambda batches: in_groups(batches, keys, work, out)), "a binary, b binary").distinct()
    return components(edges)


def shared(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """0/1 matrices, a row per set, over pieces of the shingles that more than one set has."""
    lengths = [len(s) for s in sets]
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    keep = count[inverse] > 1
    place = np.cumsum(count > 1) - 1
    row, col = row[keep], place[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    wide = int((count > 1).sum())
    for k in range(0, wide, 4096):
        a, b = np.searchsorted(col, (k, k + 4096))
        m = np.zeros((len(sets), min(4096, wide - k)), np.float32)
        m[row[a:b], col[a:b] - k] = 1
        yield m


def verified(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, same: bool, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) reach the threshold on the whole sets."""
    n = len(left)
    common = np.zeros((n, len(right)), np.float32)
    for m in shared(left if same else left + right):
        common += m @ m.T if same else m[:n] @ m[n:].T
    size_l, size_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    both = common[i, j].astype(np.float64)
    return both >= threshold * (size_l[i] + size_r[j] - both) - 1e-9


def links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, row_id: str, text: str, threshold: float, tolerance: float) -> DataFrame:
    """cls, other (the smallest linked class in a block) and n (rows of linked classes), a row for each class and pair of blocks."""
    width = BANDS * ROWS
    needs = least_matches(threshold, tolerance, STEP, width)
    inside = staged(reps.join(clusters, reps["cls"] == clusters["node"]).select("cls", "id", "rows", "sig", "n_shingles", "root"), "clustered")
    sizes = inside.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("n_shingles").cast("long") * 8).alias("bytes"))
    # A table, as the sides of the joins below are: a cluster of a third of all classes is one key, which Spark may then split.
    sizes = staged(sizes.select("root", F.greatest(n_blocks(F.col("n")), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "cluster-sizes")
    placed = inside.join(sizes, "root").withColumnRenamed("id", "__id").withColumnRenamed("cls", "__cls")
    texts = docs.select(F.col(row_id).alias("__doc"), F.col(text).alias("text")).join(placed, F.col("__doc") == F.col("__id"))

    def shingle(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column("text"))
            want = batch.column("cls").to_pylist()
            keep, found = [], []
            for i, j in K.slices(at):
                for k, s in enumerate(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]), i):
                    if set_id(s) == want[k]:  # rows may share an id
                        keep.append(k)
                        found.append(s.tobytes())
            out = batch.drop_columns(["text"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(found, pa.binary())], [*out.schema.names, "shingles"])

    held = texts.select("root", "blocks", F.col("__cls").alias("cls"), F.col("rows"), "sig", "n_shingles", "text")
    kinds = "root binary, blocks int, cls binary, rows bigint, sig binary, n_shingles int, shingles binary"
    dealt = block_pairs(held.mapInArrow(K.released(shingle), kinds), "root", "blocks", "cls").drop("blocks")
    out = pa.schema([("cls", pa.binary()), ("other", pa.binary()), ("n", pa.int64())])

    def once(t: pa.Table) -> pa.Table:
        first = np.unique(np.array(t["cls"].to_pylist(), object), return_index=True)[1]
        return t.take(np.sort(first))

    def work(t: pa.Table) -> pa.Table | None:
        left, right, same = _sides(t)
        left = once(left) if left.num_rows else left
        right = left if same else once(right) if right.num_rows else right
        if not left.num_rows or not right.num_rows:
            return None
        i, j = survivors(_matrix(left["sig"], width), _matrix(right["sig"], width), left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy(), same, threshold, needs)
        if not len(i):
            return None
        sets = lambda side: [np.frombuffer(x, np.uint64) for x in side["shingles"].to_pylist()]
        of_left = sets(left)
        ok = verified(of_left, of_left if same else sets(right), i, j, same, threshold)
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        both = _joined(left, right, same)
        names, rows = both["cls"], both["rows"].to_numpy()
        j = j if same else j + left.num_rows
        order, place = _by_name(names)
        n = np.zeros(len(names), np.int64)
        np.add.at(n, i, rows[j])
        np.add.at(n, j, rows[i])
        root = forest(len(names), place[i], place[j])[place]
        linked = np.flatnonzero(n)
        return pa.table({"cls": names.take(linked), "other": names.take(order[root[linked]]), "n": n[linked]})

    keys = ["root", "bi", "bj"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(K.released(lambda batches: in_groups(batches, keys, work, out)), "cls binary, other binary, n bigint")


def classified(docs: DataFrame, row_id: str, text: str, threshold: float, tolerance: float) -> DataFrame:
    """id, th, class_id, copy_id, n_links, n_shingles of every row."""
    signed = staged(signatures(docs, row_id, text).withColumn("cls", F.when(F.col("id").isNotNull(), F.col("cls"))), "signatures")
    reps = signed.where(F.col("cls").isNotNull()).groupBy("cls")
    reps = staged(reps.agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    clusters = candidate_clusters(reps, threshold, tolerance)
    linked = staged(links(docs, reps, clusters, row_id, text, threshold, tolerance), "links")
    tied = components(linked.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    counts = linked.groupBy("cls").agg(F.sum("n").alias("n"))
    named = reps.select("cls", F.col("id").alias("copy_id"), "rows").join(tied.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = staged(named.join(counts, "cls", "left"), "named-classes")
    smallest = staged(named.groupBy("root").agg(F.min("copy_id").alias("class_id")), "smallest-ids")
    result = named.join(smallest, "root").select("cls", "copy_id", "class_id", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    # The rows of one class may be a third of all, and so may the classes of one component: both joins are between tables.
    result = staged(result, "class-results")
    out = signed.select("id", "th", "n_shingles", "cls").join(result, "cls", "left")
    return out.select("id", "th", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n_shingles").cast("long").alias("n_shingles"))


def similarity_classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """row_id, class_id, copy_id, n_links, n_shingles of every row; see the module."""
    return classified(docs, row_id, text, threshold, tolerance).drop("th").withColumnRenamed("id", row_id)


def one_of_each(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of each class, and every row without shingles or id; of repeated rows one."""
    gone = classified(docs, row_id, text, THRESHOLD, TOLERANCE).where(F.col("class_id") < F.col("id")).select(F.col("id").alias("__gone"), F.col("th").alias("__th")).distinct()
    left = docs.join(gone, (docs[row_id] == F.col("__gone")) & (F.xxhash64(docs[text]) == F.col("__th")), "left_anti")
    if docs.where(F.col(row_id).isNotNull()).groupBy(row_id).count().where("count > 1").isEmpty():
        return left
    return left.where(F.col(row_id).isNotNull()).dropDuplicates([row_id, text]).unionByName(left.where(F.col(row_id).isNull()))
