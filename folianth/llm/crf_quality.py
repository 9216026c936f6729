"""Quality: a linear-chain CRF labels every line good or bad; length-weighted marginals make the document's score.

Only documents are labelled, so in training every line carries its document's label. A line's
features are measures of itself and of its two neighbours. The model is fitted on the driver to a
hash-chosen sample of labelled rows, bounded by rows (``SAMPLE``) and by lines (``LINES``), in which documents
are whole chains as they are in scoring; scoring takes every line of every text, however long.

A document's score has the same bits whatever rows stand beside it, so repeated rows and equal texts tie.
Null and empty texts are one empty line and get a score; without labelled rows of both labels every score
is 0.5. An empty table gives an empty table; conflicting labels of one id count as the lowest; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sampling import labelled

#: Labelled rows that are learned from, at most, and lines of them.
SAMPLE, LINES = 6000, 300_000
#: Lines that messages pass one by one; longer chains pass them from piece to piece, with the same result.
PIECE = 64
STEPS = 200

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _PUNCT, _BANG, _PIPE, _OTHER, _HIGH = range(10)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
for _chars, _kind in ((b" \t\r\x0b\x0c\n", _SPACE), (b".?", _STOP), (b",;:'\"-()", _PUNCT), (b"!", _BANG), (b"|", _PIPE)):
    for _x in _chars:
        _KIND[_x] = _kind

OWN = 17
#: A weight for each feature of the line, of the line before and of the line after; then bias, first line, last line.
N_WEIGHTS = 3 * OWN + 3


def line_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and where each row's lines begin; a row has one line at least."""
    cuts = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], cuts + 1]))  # a cut belongs to one row, so per row: its begin, then its cuts
    begin = np.concatenate([[0], np.cumsum(1 + np.searchsorted(cuts, at[1:]) - np.searchsorted(cuts, at[:-1]))])
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    if len(ends):
        last = begin[1:] - 1
        ends[last] = at[1:]
    return starts, ends, begin


def _part(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return (total[ends] - total[starts]).astype(np.float64)


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line itself (OWN x lines), bytes of each line, and where each row's lines begin."""
    starts, ends, begin = line_bounds(data, at)
    kind = _KIND[data]
    size = (ends - starts).astype(np.float64)
    share = lambda k: _part(kind == k, starts, ends)
    upper, lower, digit, space, stop, punct, bang, pipe, other, high = (share(k) for k in range(10))
    solid = np.maximum(1, size - space)
    hashes, word_at, _, _ = K.words(data, at)
    line_of = np.searchsorted(starts, word_at, "right") - 1
    n_words = np.bincount(line_of, minlength=len(starts)).astype(np.float64)
    twice = np.zeros(len(hashes))
    twice[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    adjacent = np.bincount(line_of, twice, minlength=len(starts)) / np.maximum(1, n_words)
    order = np.lexsort((hashes, line_of))
    new = np.ones(len(hashes))
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order], new, minlength=len(starts))
    fresh = np.where(n_words > 0, distinct / np.maximum(1, n_words), 1.0)
    ended = np.zeros(len(starts))
    full = np.flatnonzero(size > 0)
    ended[full] = kind[ends[full] - 1] == _STOP
    own = np.stack([
        size == 0, np.minimum(1, size / 20), np.minimum(1, size / 200), np.minimum(1, n_words / 8),
        np.minimum(1, 1.25 * upper / np.maximum(1, upper + lower)), np.minimum(1, 4 * digit / solid), np.minimum(1, 10 * other / solid),
        np.minimum(1, 20 * bang / solid), np.minimum(1, 20 * pipe / solid), np.minimum(1, 10 * punct / solid), np.minimum(1, 20 * stop / solid),
        np.minimum(1, 2 * adjacent), np.where(n_words >= 12, np.maximum(0, 1 - fresh * 1.4), 0), np.where(n_words < 12, 1 - fresh, 0),
        np.minimum(1, (upper + lower + high) / np.maximum(1, n_words) / 12), ended, np.minimum(1, 2 * (other + bang + pipe) / solid),
    ]).astype(np.float32)
    return own, size, begin


def _ends(n: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[begin[:-1]], last[begin[1:] - 1] = True, True
    return first, last


def log_odds(own: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of good, for each line: added up feature by feature, so that a line's odds don't depend on other rows."""
    here, before, after = (np.zeros(own.shape[1]) for _ in range(3))
    for k in range(OWN):
        here += own[k] * weights[k]
        before += own[k] * weights[OWN + k]
        after += own[k] * weights[2 * OWN + k]
    first, last = _ends(own.shape[1], begin)
    out = here + weights[-3] + first * weights[-2] + last * weights[-1]
    out[1:] += np.where(first[1:], 0.0, before[:-1])
    out[:-1] += np.where(last[:-1], 0.0, after[1:])
    return out


def odds_slope(own: np.ndarray, begin: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Slope of the weights for slopes ``g`` of the lines' log-odds."""
    first, last = _ends(own.shape[1], begin)
    return np.concatenate([own @ g, own[:, :-1] @ np.where(first, 0.0, g)[1:], own[:, 1:] @ np.where(last, 0.0, g)[:-1], [g.sum(), g[first].sum(), g[last].sum()]])


def _step(a: tuple[np.ndarray, np.ndarray], psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row vector of each chain times the transitions, without a matrix product, whose last digits depend on the number of rows."""
    return a[0] * psi[0, 0] + a[1] * psi[1, 0], a[0] * psi[0, 1] + a[1] * psi[1, 1]


class _Pieces:
    """Chains cut into pieces of PIECE lines, which all take a step at once; the longest come first."""

    def __init__(self, begin: np.ndarray, piece: int):
        length = np.diff(begin)
        self.count = -(-length // piece)
        self.of = np.repeat(np.arange(len(length)), self.count)
        self.begin = np.cumsum(self.count) - self.count
        number = np.arange(len(self.of)) - self.begin[self.of]
        self.head, size = begin[:-1][self.of] + number * piece, np.minimum(piece, length[self.of] - number * piece)
        self.opens, self.tail = number == 0, self.head + size - 1
        self.order = np.argsort(-size, kind="stable")
        self.alive = len(size) - np.cumsum(np.bincount(size, minlength=1)) if len(size) else np.zeros(0, np.int64)
        self.steps = int(size.max()) if len(size) else 0

    def at(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of more than t lines, and that line of each."""
        p = self.order[: int(self.alive[t])]
        return p, self.head[p] + t


def _transfers(pieces: _Pieces, node: tuple[np.ndarray, np.ndarray], psi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each state before a piece the (scaled) weights of the states at its end; at a chain's start there is no state before."""
    rows = [(np.zeros(len(pieces.of)), np.zeros(len(pieces.of))) for _ in range(2)]
    for t in range(pieces.steps):
        p, line = pieces.at(t)
        moved = []
        for u, (a, b) in enumerate(rows):
            x, y = _step((a[p], b[p]), psi) if t else (np.where(pieces.opens[p], 1.0, psi[u, 0]), np.where(pieces.opens[p], 1.0, psi[u, 1]))
            moved.append((x * node[0][line], y * node[1][line]))
        scale = moved[0][0] + moved[0][1] + moved[1][0] + moved[1][1]
        for (a, b), (x, y) in zip(rows, moved):
            a[p], b[p] = x / scale, y / scale
    return rows


def marginals(score: np.ndarray, begin: np.ndarray, trans: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line by forward-backward, expected transitions (2 x 2), and the log partition of all chains.

    ``score`` is the log-odds of good from a line's features. Messages cross a long chain piece by piece: what
    each piece does to a message is worked out for all pieces at once, so the steps that must follow each other are
    ``piece`` lines and the pieces of the longest chain.
    """
    top = np.maximum(score, 0.0)
    node = np.exp(-top), np.exp(score - top)
    psi = np.exp(trans)
    p = _Pieces(begin, piece)
    into = np.ones(len(p.of)), np.ones(len(p.of))  # the states' weights before each piece
    out = np.ones(len(p.of)), np.ones(len(p.of))  # what follows each piece, by its last state
    longest = int(p.count.max()) if len(p.count) else 0
    if longest > 1:
        (r00, r01), (r10, r11) = _transfers(p, node, psi)
        for k in range(1, longest):
            here = p.begin[p.count > k] + k
            b = here - 1
            x, y = into[0][b] * r00[b] + into[1][b] * r10[b], into[0][b] * r01[b] + into[1][b] * r11[b]
            into[0][here], into[1][here] = x / (x + y), y / (x + y)
        for k in range(longest - 1, 0, -1):
            here = p.begin[p.count > k] + k
            x, y = r00[here] * out[0][here] + r01[here] * out[1][here], r10[here] * out[0][here] + r11[here] * out[1][here]
            out[0][here - 1], out[1][here - 1] = x / (x + y), y / (x + y)
    alpha, beta, scale = (np.empty(len(score)), np.empty(len(score))), (np.empty(len(score)), np.empty(len(score))), np.ones(len(score))
    for t in range(p.steps):
        which, line = p.at(t)
        if t:
            x, y = _step((alpha[0][line - 1], alpha[1][line - 1]), psi)
        else:
            x, y = _step((into[0][which], into[1][which]), psi)
            x, y = np.where(p.opens[which], 1.0, x), np.where(p.opens[which], 1.0, y)
        x, y = x * node[0][line], y * node[1][line]
        scale[line] = x + y
        alpha[0][line], alpha[1][line] = x / scale[line], y / scale[line]
    beta[0][p.tail], beta[1][p.tail] = out
    back = np.swapaxes(psi, 0, 1)
    for t in range(p.steps - 1, 0, -1):
        _, line = p.at(t)
        x, y = _step((node[0][line] * beta[0][line], node[1][line] * beta[1][line]), back)
        beta[0][line - 1], beta[1][line - 1] = x / (x + y), y / (x + y)
    good, bad = alpha[1] * beta[1], alpha[0] * beta[0]
    inner = np.ones(len(score), bool)
    inner[begin[:-1]] = False
    line = np.flatnonzero(inner)
    joint = np.stack([alpha[u][line - 1] * psi[u, v] * node[v][line] * beta[v][line] for u in (0, 1) for v in (0, 1)])
    pair = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return good / (good + bad), pair, float(np.log(scale).sum() + top.sum())


def fit(x: np.ndarray, y: np.ndarray, begin: np.ndarray, steps: int = STEPS, ridge: float = 0.5, odds=lambda x, begin, w: x @ w, slope=lambda x, begin, g: x.T @ g, n_weights: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores that maximise the conditional likelihood of the line labels ``y``.

    ``odds`` and ``slope`` say how weights make the lines' log-odds from ``x``, and the way back.
    """
    n = x.shape[1] if n_weights is None else n_weights
    theta, m, v = np.zeros(n + 4), np.zeros(n + 4), np.zeros(n + 4)
    inner = np.ones(len(y), bool)
    inner[begin[:-1]] = False
    seen = np.bincount(2 * y[np.flatnonzero(inner) - 1] + y[inner], minlength=4).reshape(2, 2)
    x = x.astype(np.float64)
    for k in range(1, steps + 1):
        p, pair, _ = marginals(odds(x, begin, theta[:-4]), begin, theta[-4:].reshape(2, 2))
        g = np.concatenate([slope(x, begin, p - y), (pair - seen).ravel()]) / len(begin) + ridge * theta / len(begin)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        theta -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on at most ``sample`` labelled rows of ``lines`` lines together; None if there are none, or of one label only."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    text = F.coalesce("text", F.lit(""))
    chosen = labelled(docs, known, "crf", sample, F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, lines)

    def features(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column(1))
            own, _, begin = line_features(data, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own[:, a:b].T.tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())], ["y", "x"])

    rows = chosen.mapInArrow(K.released(features), "y int, x binary").toPandas()
    if rows["y"].nunique() < 2:
        return None
    rows = rows.sort_values(["y", "x"], kind="stable")  # not the order in which tasks end
    begin = np.concatenate([[0], np.cumsum([len(b) // (4 * OWN) for b in rows["x"]])])
    own = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, OWN).T
    return fit(own, np.repeat(rows["y"].to_numpy(), np.diff(begin)), begin, odds=log_odds, slope=odds_slope, n_weights=N_WEIGHTS)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` (may hold the text), score double, predicted int; ``names`` names the last two."""
    width = len(keep)
    at_text = list(keep).index(text) if text in keep else width
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column(at_text))
            if sent.value is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                weights, trans = sent.value
                odds, sizes, counts = [], [], []
                for i, j in K.slices(at):
                    own, size, begin = line_features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    odds.append(log_odds(own, begin, weights))
                    sizes.append(size)
                    counts.append(np.diff(begin))
                begin = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
                good, _, _ = marginals(np.concatenate(odds), begin, trans) if odds else (np.zeros(0), None, 0.0)
                weight = (np.concatenate(sizes) if sizes else np.zeros(0)) + 1e-3  # so that empty lines alone have a mean
                p = K.segment_sum(good * weight, begin) / np.maximum(K.segment_sum(weight, begin), 1e-12)
            p = np.clip(p, 0.0, 1.0)
            yield K.with_columns(batch, list(keep), **dict(zip(names, (p, (p >= 0.5).astype(np.int32)))))

    picked = docs.select(*keep) if text in keep else docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:width])
    return picked.mapInArrow(K.released(work), f"{fields}, `{names[0]}` double, `{names[1]}` int")


def accuracy(scored: pd.DataFrame, truth: pd.DataFrame, label: str) -> dict[str, float]:
    """Share right, and of each label, on rows held out."""
    both = scored[scored["held_out"]].merge(truth[truth[label].notna()], on="doc_id")
    hit = both["predicted"] == both[label]
    return {"n": len(both), "all": hit.mean(), **{str(k): hit[both[label] == k].mean() for k in (0, 1)}}
