"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded, hash-chosen sample of labelled rows; the matrix of log
probabilities (languages x buckets, its size set by parameters) is broadcast. Rows are scored in batches: the
n-grams of a batch are the sparse rows of a matrix, a list of buckets each, which is multiplied by the log
probabilities by gathering and adding up. Texts of any length are whole, in training and in scoring: a long one
is taken in pieces whose n-grams run on into the next piece.

Null texts and texts without a letter are ``und`` with score 0; without any training row every text is ``und``.
A text's score has the same bits whatever rows stand beside it; languages that tie go to the first by name. An
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Rows of each language that are learned from, about.
SAMPLE = 1500
#: Characters scored at a time.
PIECE = 1 << 18

_letter = re.compile(r"[^\W\d_]")
_spaces = np.array([chr(x).isspace() for x in range(0x3001)])


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a blank before and after each and runs of white space as one; and where each text begins."""
    low = [t.lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) + 2 for t in low])]).astype(np.int64)
    chars = np.frombuffer((" " + "  ".join(low) + " " if low else "").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.zeros(len(chars), bool)
    known = chars < len(_spaces)
    space[known] = _spaces[chars[known]]
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1]] = True
    chars = np.where(space, np.uint32(32), chars)[keep]
    return chars, np.concatenate([[0], np.cumsum(keep)])[at]


def hashed(chars: np.ndarray, n: int, n_buckets: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each character but the last n - 1."""
    if len(chars) < n:
        return np.zeros(0, np.int32)
    h = np.full(len(chars) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(n_buckets - 1)).astype(np.int32)


def pieces(chars: np.ndarray, at: np.ndarray, n_buckets: int, orders: tuple[int, ...] = ORDERS, piece: int | None = None) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(i, j, [(buckets, where each row's begin) of each order]) of rows i to j - 1; a row longer than ``piece`` comes alone, several times."""
    piece, most, i = piece or PIECE, max(orders), 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + piece, "right")) - 1)
        for a in range(int(at[i]), int(at[j]), piece) if j == i + 1 else (int(at[i]),):
            b = min(a + piece, int(at[j])) if j == i + 1 else int(at[j])
            some = chars[a : min(b + most - 1, int(at[j]))]
            found = []
            for n in orders:
                grams = hashed(some, n, n_buckets)
                if j == i + 1:
                    grams = grams[: b - a]
                    found.append((grams, np.array([0, len(grams)])))
                else:
                    start = np.arange(len(grams))
                    row = np.searchsorted(at[i : j + 1] - a, start, "right")
                    grams = grams[start + n <= at[i : j + 1][row] - a]  # none that runs into the next row
                    found.append((grams, np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(at[i : j + 1]) - n + 1))])))
            yield i, j, found
        i = j


def batches_of(texts: list[str], limit: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together, or of one longer text."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if texts:
        yield i, len(texts)


def buckets(text: str, n_buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The bucket of every character n-gram of a text."""
    found = [grams for _, _, of in pieces(*characters([text]), n_buckets, orders) for grams, _ in of]
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", sample: int = SAMPLE, n_buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(language) + log P(bucket | language) as a (languages, buckets + 1) matrix; the prior comes last."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((0, n_buckets + 1))
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col(lang) == name, F.lit(min(1.0, sample / counts[name]))).otherwise(share)
    # A hash of the id decides, so a re-run task sees the same sample.
    drawn = F.pmod(F.xxhash64(F.col(row_id).cast("string"), F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000
    order = {name: i for i, name in enumerate(names)}

    def count(batches):
        for batch in batches:
            table = np.zeros((len(names), n_buckets), np.int64)
            lang_of = [order[x] for x in batch.column(0).to_pylist()]
            texts = batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                for i, j, found in pieces(*characters(texts[a:b]), n_buckets):
                    for grams, begin in found:
                        cell = np.repeat(lang_of[a + i : a + j], np.diff(begin)) * n_buckets + grams
                        table += np.bincount(cell, minlength=table.size).reshape(table.shape)
            i, j = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(table[i, j])], ["l", "b", "n"])

    cells = known.where(drawn).select(lang, text).mapInArrow(K.released(count), "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(names), n_buckets), 0.1)
    table[cells["l"], cells["b"]] += cells["n"]
    prior = np.log([counts[n] / sum(counts.values()) for n in names])
    return names, np.hstack([np.log(table / table.sum(1, keepdims=True)), prior[:, None]])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred string, score double (the posterior of lang_pred)."""
    names, matrix = model
    n_buckets = matrix.shape[1] - 1
    sent = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(matrix[:, :-1]), matrix[:, -1]))
    width = len(keep)

    def score(batches):
        weights, prior = sent.value
        for batch in batches:
            texts = batch.column(width).to_pylist()
            total = np.tile(prior, (len(texts), 1))
            some = [k for k, x in enumerate(texts) if names and x is not None and _letter.search(x)]
            scored = [texts[k] for k in some]
            for a, b in batches_of(scored):
                for i, j, found in pieces(*characters(scored[a:b]), n_buckets):
                    for grams, begin in found:
                        for l in range(len(names)):
                            total[some[a + i : a + j], l] += K.segment_sum(weights[l][grams], begin)
            chosen, sure = ["und"] * len(texts), np.zeros(len(texts))
            best = total[some].argmax(axis=1) if some else np.zeros(0, np.int64)
            for k, l in zip(some, best):
                chosen[k] = names[l]
            if some:
                sure[some] = 1.0 / np.exp(total[some] - total[some, best][:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(chosen, pa.string()), pa.array(sure, pa.float64())], [*keep, "lang_pred", "score"])

    picked = docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:width])
    return picked.mapInArrow(K.released(score), f"{fields}, lang_pred string, score double")
