"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence ends at ``.``, ``!``, ``?`` or a line break. Its features are hashed words and word
beginnings of four to six bytes that are much more frequent in toxic rows; its score is logistic in them, and a
sentence without any is not toxic at all, so clean sentences don't add up, however many there are. A document is
toxic if a sentence is: P = 1 - (1 - LEAK) product(1 - p_sentence); of sentences below ``FLOOR`` only the most
toxic counts, for the same reason. The gradient of a toxic document goes to its sentences in proportion to their
share in P, which locates the offending ones. The fit is on the driver, to hash-chosen samples of labelled rows,
bounded by rows of each label (``SAMPLE``) and by bytes (``BYTES``), of which only the used features get there;
scoring takes whole texts.

A document's score has the same bits whatever rows stand beside it, so repeated rows and equal texts tie; of
sentences that tie the first is the worst. Null and empty texts have no sentence and score LEAK; without rows of
both labels every score is 0. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sampling import labelled

BUCKETS = 1 << 18
#: Labelled rows of either label that are learned from, at most, and bytes of either.
SAMPLE, BYTES = 2500, 50 << 20
#: A feature of fewer toxic rows is noise.
MIN_ROWS = 4
STEPS = 100
#: A feature speaks for toxicity if it is e^this times as frequent in toxic rows; others get no weight.
MIN_RATIO = 1.5
#: Bias that the fit begins with; it may fall, and rise again up to here.
MAX_BIAS = -9.0
#: What a document is toxic with whatever its sentences say.
LEAK = 1e-4
#: Sentences below this don't add up.
FLOOR = 0.2

_IS_END = np.zeros(256, bool)
_IS_END[[10, 33, 46, 63]] = True


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the sentences that hold more than ends, and where each row's begin."""
    starts, ends = K.runs(~_IS_END[data], at)
    return starts, ends, np.searchsorted(starts, at)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, the sentence of each, sentence starts and ends, where each row's sentences begin."""
    starts, ends, begin = sentences(data, at)
    low = K.LOWER[data]
    word_at, word_end = K.runs(K.IS_WORD[data], at)
    found, of = [], []
    sentence = np.searchsorted(starts, word_at, "right") - 1
    # A word said over and over counts once.
    whole = K.span_hashes(low, word_at, word_end)
    new = np.ones(len(word_at), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (sentence[1:] != sentence[:-1])
    for n in (0, 4, 5, 6):
        take = new & (word_end - word_at > n)
        h = whole[take] if not n else K.span_hashes(low, word_at[take], word_at[take] + n)
        found.append((h + np.uint64(n * 0x51ED2701)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46))
        of.append(sentence[take])
    return np.concatenate(found).astype(np.int32), np.concatenate(of), starts, ends, begin


def log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - p) of sentences."""
    return -np.logaddexp(0, z)


def use(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that speak for toxicity, by how many rows of either label hold them, and their log ratios."""
    ratio = np.log((toxic + 0.2) / max(1, n_toxic)) - np.log((clean + 0.2) / max(1, n_clean))
    names = np.flatnonzero((toxic >= MIN_ROWS) & (ratio > MIN_RATIO))
    return names, ratio[names]


def fit(local: np.ndarray, sentence: np.ndarray, begin: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = STEPS, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights of the features (numbers ``local`` of sentences ``sentence``) and the bias, by gradient ascent on the noisy-or likelihood of the labels.

    Only sentences with a feature are numbered; those of document i are from begin[i] to begin[i + 1].
    """
    n_sentences = int(begin[-1])
    row = np.repeat(np.arange(len(y)), np.diff(begin))
    n_toxic, n_clean = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    w, bias = start.copy(), MAX_BIAS
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share = np.where(y == 1, 0.5 / n_toxic, 0.5 / n_clean) * len(y)
    for k in range(1, steps + 1):
        z = np.bincount(sentence, w[local], minlength=n_sentences) + bias
        p = 1 / (1 + np.exp(-z))
        q = np.exp(np.minimum(K.segment_sum(log_clean(z), begin) + np.log1p(-LEAK), -1e-9))
        pull = np.where(y == 1, q / np.maximum(1e-9, 1 - q), -1.0) * share
        g = p * pull[row] / len(y)
        slope = np.append(np.bincount(local, g[sentence], minlength=len(w)) - ridge * w / len(y), g.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
        w, bias = np.maximum(0, w + step[:-1]), min(bias + step[-1], MAX_BIAS)
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, most: int = BYTES) -> tuple[np.ndarray, float] | None:
    """Weights of the buckets and the bias; None without rows of both labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    bytes_ = F.octet_length(F.coalesce("text", F.lit("")))
    clean, toxic = (labelled(docs, known.where(F.col("y") == y), "mil", sample, bytes_, most) for y in (0, 1))
    chosen = clean.union(toxic)

    def held(batches):
        """How many rows of a batch hold each bucket."""
        for batch in batches:
            y = batch.column(0).to_numpy()
            data, at = K.string_bytes(batch.column(1))
            bucket, sentence, _, _, begin = features(data, at)
            row = np.repeat(np.arange(len(y)), np.diff(begin))[sentence] if len(sentence) else np.zeros(0, np.int64)
            once = np.unique(row * BUCKETS + bucket)
            for label_ in (0, 1):
                n = np.bincount(once[y[once // BUCKETS] == label_] % BUCKETS, minlength=BUCKETS)
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), label_, np.int32)), pa.array(there, pa.int32()), pa.array(n[there], pa.int64())], ["y", "b", "n"])

    rows = {r[0]: r[1] for r in chosen.groupBy("y").count().collect()}
    if len(rows) < 2:
        return None
    counts = chosen.mapInArrow(K.released(held), "y int, b int, n long").groupBy("b").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(c) for y, c in ((0, "clean"), (1, "toxic"))))
    counts = counts.where(F.col("toxic") >= MIN_ROWS).toPandas()  # BUCKETS rows at most
    names, ratio = use(*(np.bincount(counts["b"], counts[c], minlength=BUCKETS) for c in ("toxic", "clean")), rows[1], rows[0])
    number = np.full(BUCKETS, -1, np.int32)
    number[names] = np.arange(len(names))
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def extract(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column(1))
            bucket, sentence, _, _, begin = features(data, at)
            local = sent.value[bucket]
            sentence, local = sentence[local >= 0], local[local >= 0]
            order = np.lexsort((local, sentence))
            sentence, local = sentence[order], local[order]
            cut = np.searchsorted(sentence, begin)
            numbered = [np.unique(sentence[i:j], return_inverse=True)[1].astype(np.int32) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([local[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([s.tobytes() for s in numbered], pa.binary()),
                pa.array([int(s[-1]) + 1 if len(s) else 0 for s in numbered], pa.int32()),
            ], ["y", "b", "s", "n"])

    found = chosen.mapInArrow(K.released(extract), "y int, b binary, s binary, n int").toPandas()
    found = found.sort_values(["y", "n", "b", "s"], kind="stable")  # not the order in which tasks end
    begin = np.concatenate([[0], np.cumsum(found["n"])])
    local = np.frombuffer(b"".join(found["b"]), np.int32)
    sentence = np.concatenate([np.frombuffer(x, np.int32) + k for x, k in zip(found["s"], begin[:-1])])
    w, bias = fit(local, sentence, begin, found["y"].to_numpy(), 2 * ratio)
    weights = np.zeros(BUCKETS)
    weights[names] = w
    return weights, bias


def of_documents(z: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """P of each document from its sentences' log-odds (-inf: without a feature)."""
    p = 1 / (1 + np.exp(-z))
    clean = K.segment_sum(np.where(p >= FLOOR, log_clean(z), 0.0), begin)
    full = np.flatnonzero(np.diff(begin) > 0)
    if len(full):
        clean[full] = np.minimum(clean[full], log_clean(np.maximum.reduceat(z, begin[:-1][full])))
    return -np.expm1(clean + np.log1p(-LEAK))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, predicted, and of the most toxic sentence its score (``worst``), first byte and bytes (``worst_at``, ``worst_len``)."""
    width = len(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column(width))
            n = batch.num_rows
            p, worst, place, length = np.zeros(n), np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.int64)
            if sent.value is not None:
                weights, bias = sent.value
                for i, j in K.slices(at):
                    bucket, sentence, starts, ends, begin = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    z = np.bincount(sentence, weights[bucket], minlength=len(starts))
                    z = np.where(z > 0, z + bias, -np.inf)
                    p[i:j] = of_documents(z, begin)
                    full = np.flatnonzero(np.diff(begin) > 0)
                    if len(full):
                        high = np.maximum.reduceat(z, begin[:-1][full])
                        first = np.full(len(begin) - 1, -1, np.int64)
                        row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                        tops = np.flatnonzero(z == np.repeat(high, np.diff(begin)[full]))[::-1]
                        first[row[tops]] = tops
                        worst[i + full] = 1 / (1 + np.exp(-high))
                        place[i + full] = starts[first[full]] - (at[i + full] - at[i])
                        length[i + full] = ends[first[full]] - starts[first[full]]
            p = np.clip(p, 0.0, 1.0)
            yield K.with_columns(batch, list(keep), score=p, predicted=(p >= 0.5).astype(np.int32), worst=worst, worst_at=place, worst_len=length)

    picked = docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:width])
    return picked.mapInArrow(K.released(work), f"{fields}, score double, predicted int, worst double, worst_at long, worst_len long")
