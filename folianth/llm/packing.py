"""Packing token sequences by cutting-stock column generation.

Documents are cut into pieces whose lengths form few classes: whole sequences of ``SEQUENCE`` tokens,
then the largest multiple of ``QUANTUM`` that is left, then the rest. The histogram of lengths (its size
is set by these two parameters) goes to the driver, where a linear program finds how often to use
which pattern of lengths: the simplex method, whose entering columns come from a knapsack solved
by dynamic programming. Full patterns are used the whole number of times that the program says;
a piece's rank within its length picks its place in them, in closed form. What rounding leaves
(less than a pattern for each length) is laid end to end, cut at sequence borders, and its last
stretch is cut into powers of two, so nothing is padded.

Null and empty texts are their closing id alone. Repeated rows are packed each. An empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import gc
import math
import os
import re
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .staging import staged

SEQUENCE = 4096
QUANTUM = 64
CLOSING_ID = 2
#: Chunks, and words, whose ids a worker remembers in a generation.
REMEMBERED = 250_000
#: Bytes of text in which repeated chunks are looked up once.
SLICE = 4 << 20
#: Pieces of one length that are ranked together, about; of many there are as many groups as pieces in a group.
RANKED = 1000

_encoders: dict[str, Encoder] = {}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Remembered:
    """Results of a function of a string, in two generations: when the young are ``limit`` they become the old, and the old go."""

    def __init__(self, make, limit: int):
        self._make, self._limit, self._young, self._old = make, limit, {}, {}

    def of(self, keys: list[str]) -> list[bytes]:
        young, old, make = self._young, self._old, self._make
        for key in set(keys).difference(young):
            value = old.get(key)
            young[key] = make(key) if value is None else value
        found = [young[k] for k in keys]
        if len(young) > self._limit:
            self._young, self._old = {}, young
        return found


class Encoder:
    """Ids of a text, as bytes of unsigned 32-bit integers.

    The tokenizer drops white space and no id spans it, so chunks between blanks are encoded apart. In a
    chunk of letters up to U+00FF and ASCII marks after them, it parts the letters from the marks and its
    normaliser only lower-cases, so there its model is asked directly, and words are remembered
    without their marks. Every other chunk takes the tokenizer's whole way. Whether the file at ``path`` is such a tokenizer is
    tried on every letter and mark first; one that isn't encodes chunks, or else texts, in its whole way.
    """

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        letters = [chr(x) for x in (*range(0xDF, 0xF7), *range(0xF8, 0x100))]
        part = self._tokenizer.pre_tokenizer.pre_tokenize_str if self._tokenizer.pre_tokenizer else lambda x: []
        self._bytes = str.maketrans({x: part(x)[0][0] if part(x) else x for x in letters})
        self._words = _Remembered(self._word, REMEMBERED)
        self._odd = _Remembered(self._whole, REMEMBERED)
        letters = "abcdefghijklmnopqrstuvwxyz" + "".join(letters)
        marks = [chr(x) for x in range(33, 127) if self._plain.fullmatch("a" + chr(x)) and not chr(x).isalpha()]
        probes = [w for x in letters for w in (x, x.upper()[:1], f"a{x}", f"{x.upper()[:1]}{x}e", f"{x}nding")] + [f"word{m}" for m in marks] + ["Hello,", "don't", "x2", "e.g.)", "(see", "№5", "日本", "wide…"]
        self._apart = all(self._whole(blank.join(probes)) == b"".join(map(self._whole, probes)) for blank in (" ", "\n", "  "))
        if not (self._apart and all(x == self._whole(p) for p, x in zip(probes, self.chunks(probes)))):
            self._plain = re.compile(r"(?!)()()")
            self._words, self._odd = _Remembered(self._word, REMEMBERED), _Remembered(self._whole, REMEMBERED)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _whole(self, chunk: str) -> bytes:
        return _pack(self._tokenizer.encode(chunk, add_special_tokens=False).ids) if chunk else b""

    def _word(self, word: str) -> bytes:
        return _pack([t.id for t in self._model.tokenize(word if word.isascii() else word.translate(self._bytes))]) if word else b""

    def chunks(self, chunks: list[str]) -> list[bytes]:
        parted = [m and m.groups() for m in map(self._plain.fullmatch, chunks)]
        words = self._words.of([p[0].lower() for p in parted if p])
        marks = self._words.of([p[1] for p in parted if p])
        odd = self._odd.of([c for c, p in zip(chunks, parted) if not p])
        word, other = map(bytes.__add__, words, marks), iter(odd)
        return [next(word) if p else next(other) for p in parted]

    def batch(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of bytes end to end, and where each row's begin. Equal chunks of the rows are encoded once."""
        if not self._apart:
            rows = [self._whole(data[i:j].tobytes().decode()) for i, j in zip(at[:-1], at[1:])]
            return np.frombuffer(b"".join(rows), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])])
        data = np.insert(data, at[1:], 10)  # every chunk ends with its blank
        at = at + np.arange(len(at))
        ends = np.flatnonzero((data == 32) | (data == 10)) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        distinct = parts.dictionary
        _, place, raw = distinct.buffers()
        last = int(np.frombuffer(place, np.int32)[len(distinct)])
        pool = self.chunks(raw[:last].to_pybytes().decode().replace("\n", " ").split(" ")[:-1])
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        flat, first = np.frombuffer(b"".join(pool), "<u4"), np.cumsum(size) - size
        code = parts.indices.to_numpy()
        n = size[code]
        up_to = np.concatenate([[0], np.cumsum(n)])
        row = up_to[np.searchsorted(ends, at, "right")]
        return flat[np.arange(up_to[-1]) + np.repeat(first[code] - up_to[:-1], n)], row

    def ids(self, text: str) -> bytes:
        return b"".join(self.chunks(text.replace("\n", " ").split(" "))) if self._apart else self._whole(text)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_CLOSE = _pack([CLOSING_ID])


def cuts(n: int, sequence: int, quantum: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    whole, left = divmod(n, sequence)
    even = left - left % quantum
    parts = [(k * sequence, sequence) for k in range(whole)]
    return parts + [(s, m) for s, m in ((whole * sequence, even), (whole * sequence + even, left - even)) if m]


def pieces(docs: DataFrame, path: str, sequence: int, quantum: int) -> DataFrame:
    """doc_id, th (a hash of the text), start, length, ids_crc32, doc_tokens."""

    def work(batches):
        encoder = Encoder.of(path)
        gc.disable()  # the remembered words are many, and no cycles are made
        try:
            for batch in batches:
                source, rows = [], []
                data, at = K.string_bytes(batch.column(2))
                for i, j in K.slices(at, SLICE):
                    found, row = encoder.batch(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    raw = memoryview(found.astype("<u4", copy=False)).cast("B")
                    for k in range(i, j):
                        ids = bytes(raw[4 * row[k - i] : 4 * row[k - i + 1]]) + _CLOSE
                        for start, length in cuts(len(ids) // 4, sequence, quantum):
                            source.append(k)
                            rows.append((start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4))
                columns = zip(*rows) if rows else [()] * 4
                take = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "th", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            gc.enable()

    picked = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return picked.mapInArrow(K.released(work), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, th long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest worth that fits ``size``: dynamic programming over its capacities."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    order = np.argsort(lengths)
    at, value = lengths[order], worth[order]
    fits = np.searchsorted(at, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c], pick[c] = best[c - 1], -1
        if k := fits[c]:
            total = best[c - at[:k]] + value[:k]
            top = int(np.argmax(total))
            if total[top] > best[c] + 1e-12:
                best[c], pick[c] = total[top], top
    pattern, c = np.zeros(len(lengths), np.int64), size
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[order[pick[c]]] += 1
            c -= at[pick[c]]
    return float(best[size]), pattern


class Plan(NamedTuple):
    lengths: np.ndarray  # of the classes
    patterns: np.ndarray  # patterns x classes, each of a whole sequence
    times: np.ndarray  # how often each pattern is used


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, size: int = SEQUENCE, gap: float = 1e-4, rounds: int = 600) -> Plan:
    """Least sequences that hold ``demand[i]`` pieces of ``lengths[i]``, as whole numbers of full patterns within the demand.

    The revised simplex method; it ends where no pattern improves or the bound of tokens / size is met to ``gap``.
    """
    n = len(lengths)
    basis = np.diag(size // lengths).astype(np.float64)  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis)) if n else basis
    times_ = lambda a, b: np.einsum("ij,j...->i...", a, b)  # noqa: E731  small, and threads of a matrix library would wait for busy cores
    amount = times_(inverse, demand)
    bound = float((lengths * demand).sum()) / size
    for k in range(rounds):
        if amount.sum() <= bound * (1 + gap):
            break
        worth = inverse.sum(axis=0)  # every pattern costs one sequence
        value, column = knapsack(lengths, worth, size)
        if value <= 1 + 1e-9:
            break
        along = times_(inverse, column)
        ratio = np.where(along > 1e-11, amount / np.where(along > 1e-11, along, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        row = inverse[out] / along[out]
        inverse -= np.outer(along, row)
        inverse[out] = row
        if k % 50 == 49:  # a Newton step against what rounding has added up
            inverse += times_(inverse, np.eye(n) - times_(basis, inverse))
        amount = np.maximum(0, times_(inverse, demand))
    patterns, times = np.rint(basis.T).astype(np.int64), np.floor(amount + 1e-7).astype(np.int64)
    full = (patterns @ lengths == size) & (times > 0)
    patterns, times = patterns[full], times[full]
    order = np.lexsort((*patterns.T, -times)) if len(times) else np.zeros(0, int)
    patterns, times = patterns[order], times[order]
    for p in range(len(times)):  # rounding of large floats must not use more than there is
        used = patterns.T @ times
        over = np.flatnonzero((used > demand) & (patterns[p] > 0))
        if len(over):
            times[p] -= min(times[p], max(-(-(used[c] - demand[c]) // patterns[p, c]) for c in over))
    return Plan(lengths, patterns[times > 0], times[times > 0])


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Layout:
    """Places by (length, rank) in closed form."""

    def __init__(self, plan: Plan, demand: np.ndarray, size: int):
        self.lengths, self.size = plan.lengths, size
        used = plan.patterns.T @ plan.times if len(plan.times) else np.zeros(len(plan.lengths), np.int64)
        first = np.concatenate([[0], np.cumsum(plan.times)])
        self.tables = []
        for c, length in enumerate(plan.lengths):
            of = np.flatnonzero(plan.patterns[:, c]) if len(plan.times) else np.zeros(0, int)
            copies = plan.patterns[of, c]
            before = (plan.patterns[of][:, :c] @ plan.lengths[:c]) if len(of) else np.zeros(0, np.int64)
            self.tables.append((np.concatenate([[0], np.cumsum(copies * plan.times[of])]), copies, first[of], before))
        self.used = used
        left = (demand - used) * plan.lengths
        self.stream = np.concatenate([[0], np.cumsum(left)])
        total = int(self.stream[-1])
        self.tail = np.concatenate([[0], np.cumsum(powers(total % size))]).astype(np.int64) + total // size * size
        self.n_whole, self.first_left = total // size, int(first[-1])

    def border(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, begin and end of the sequence that holds each position of the laid-out rest."""
        whole = position // self.size
        k = np.clip(np.searchsorted(self.tail, position, "right") - 1, 0, max(0, len(self.tail) - 2))
        late = position >= self.tail[0]
        begin = np.where(late, self.tail[k], whole * self.size)
        end = np.where(late, self.tail[np.minimum(k + 1, len(self.tail) - 1)], (whole + 1) * self.size)
        return self.first_left + np.where(late, self.n_whole + k, whole), begin, end

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start within the piece, length, sequence, offset) of the parts of each piece."""
        cls = np.searchsorted(self.lengths, length)
        seq, offset, planned = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), rank < self.used[cls]
        for c in np.unique(cls):
            at = np.flatnonzero((cls == c) & planned)
            slots, copies, first, before = self.tables[c]
            if len(at):
                p = np.searchsorted(slots, rank[at], "right") - 1
                k = rank[at] - slots[p]
                seq[at] = first[p] + k // copies[p]
                offset[at] = before[p] + k % copies[p] * self.lengths[c]
        done = [(np.flatnonzero(planned), np.zeros(int(planned.sum()), np.int64), length[planned], seq[planned], offset[planned])]
        row = np.flatnonzero(~planned)
        position = self.stream[cls[row]] + (rank[row] - self.used[cls[row]]) * length[row]
        start, left = np.zeros(len(row), np.int64), length[row].copy()
        while len(row):
            number, begin, end = self.border(position)
            part = np.minimum(left, end - position)
            done.append((row, start, part, number, position - begin))
            more = left > part
            row, position, start, left = row[more], (position + part)[more], (start + part)[more], (left - part)[more]
        return tuple(np.concatenate(x) for x in zip(*done))


def ranked(cut: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length: ranks within salted groups, plus the sizes of the groups before.

    Neither a group nor the list of a length's groups has more rows than RANKED or the root of the length's pieces, about.
    """
    largest = cut.groupBy("length").count().agg(F.max("count")).first()[0] or 1
    salts = -(-largest // max(RANKED, math.isqrt(largest)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "th"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "th")
    return salted.withColumn("__n", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("__n") - 1).drop("__n", "before", "salt")


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, quantum: int = QUANTUM) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    docs = docs.select("doc_id", "text")
    cut = staged(pieces(docs, path, sequence, quantum), "pieces")
    counted = sorted((r[0], r[1]) for r in cut.groupBy("length").count().collect())  # sequence / quantum + quantum lengths at most
    lengths, demand = (np.array(x, np.int64) for x in (zip(*counted) if counted else ((), ())))
    layout = Layout(cutting_stock(lengths, demand, sequence), demand, sequence)
    names = ["doc_id", "th", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row, skip, part, number, offset = layout.place(length, rank)
            took = batch.take(pa.array(row))
            column = lambda c: took.column(took.schema.get_field_index(c))
            whole = part == column("length").to_numpy()
            crc = pa.array(column("ids_crc32").to_numpy(), mask=~whole)
            yield pa.RecordBatch.from_arrays([column("doc_id"), column("th"), pa.array(column("start").to_numpy() + skip), pa.array(part), crc, column("doc_tokens"), pa.array(number), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    placed = staged(ranked(cut).select(*names, "rank").mapInArrow(K.released(place), f"doc_id {kind}, th long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"), "placed")
    broken = placed.where(F.col("ids_crc32").isNull()).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "length")).alias("parts"))
    # A table, whose size Spark knows when it chooses the join; there are fewer cut pieces than sequences.
    broken = staged(broken.withColumnRenamed("doc_id", "__id").withColumnRenamed("th", "__th"), "cut-documents")
    joined = docs.join(broken, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")))

    def again(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            source, rows = [], []
            for i, (text, parts) in enumerate(zip(batch.column(2), batch.column(3))):
                ids = encoder.ids(text.as_py() or "") + _CLOSE
                for x in parts.as_py():
                    source.append(i)
                    rows.append((x["start"], x["length"], zlib.crc32(ids[4 * x["start"] : 4 * (x["start"] + x["length"])])))
            take = pa.array(source, pa.int64())
            columns = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in columns)], ["__id", "__th", "__start", "__length", "__crc"])

    crcs = staged(joined.select("doc_id", "__th", "text", "parts").mapInArrow(K.released(again), f"__id {kind}, __th long, __start long, __length long, __crc long").distinct(), "cut-pieces")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")) & (F.col("start") == F.col("__start")) & (F.col("length") == F.col("__length"))
    mended = placed.where(F.col("ids_crc32").isNull()).join(crcs, same).withColumn("ids_crc32", F.col("__crc"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.where(F.col("ids_crc32").isNotNull()).select(*out).unionByName(mended.select(*out))
