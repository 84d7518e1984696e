"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: an embedding of the word itself and the sum of
embeddings of its 3- and 4-character pieces, both looked up by hash. Windows of
``SPAN`` words, each starting ``STRIDE`` (``SCORE_STRIDE`` in scoring) after the
one before and the last one ending with the text, run through a GRU in both directions; attention pools the
states; a linear layer gives the window's logit. Training pools the windows of
a document by log-sum-exp, scoring takes their maximum, so one toxic sentence
in a long text is enough.

Training runs in numpy on the driver, on a bounded sample of labelled rows
(``SAMPLE``, ``SAMPLE_CHARS``). The weights, about 1.2 MB whatever the corpus,
go to the executors, which score every window of every whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import kept, sampled_ids

SPAN, STRIDE = 32, 24
#: Scored windows overlap by half, so a passage of up to 17 words stands whole in one.
SCORE_STRIDE = 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 14
#: Most rows of each label that training sees, and their longest texts.
SAMPLE, SAMPLE_CHARS = {1: 800, 0: 1600}, 4000
STEPS, DOCS_A_STEP, RATE = 350, 48, 0.01
#: Fixed value of the contract: documents at or over this score are toxic.
THRESHOLD = 0.3
#: Words that a task remembers; about 400 bytes each.
REMEMBERED = 200_000
WINDOWS = 2048
PUNCTUATION = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”‚‘’…–—¿¡"

Params = dict[str, np.ndarray]


def words_of(text: str | None) -> list[str]:
    """The folded words of a whole text; an empty one is one empty word."""
    return (text or "").lower().split() or [""]


@dataclass
class Features:
    """Hashes of a list of words: one of the word, and those of its character pieces."""

    word: np.ndarray
    piece: np.ndarray  # two rows (3- and 4-pieces) over all characters
    valid: np.ndarray  # the same shape: 1 / sqrt(pieces of the word), or 0
    starts: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Features:
        word = np.fromiter((zlib.crc32(w.strip(PUNCTUATION).encode("utf-8", "replace")) for w in words), np.int64, len(words)) % WORD_BUCKETS
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        text = "".join(f"\x02{w}\x03" for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        codes = np.concatenate((codes, np.zeros(3, np.int64)))
        n = len(codes) - 3
        three = codes[:n] * 7919 + codes[1 : n + 1] * 104_729 + codes[2 : n + 2] * 1_299_709
        four = three * 31 + codes[3 : n + 3] * 15_485_863 + 17
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(words)), lengths)
        left = ends[owner] - np.arange(n)
        weight = 1 / np.sqrt(np.maximum(1.0, 2.0 * lengths - 5))[owner]
        valid = np.stack((left >= 3, left >= 4)) * weight
        return cls(word, (np.stack((three, four)) % CHAR_BUCKETS).astype(np.int32), valid.astype(np.float32), ends - lengths, owner)

    def take(self, rows: np.ndarray) -> Features:
        """The same of some of the words."""
        lengths = np.diff(self.starts, append=len(self.owner))[rows]
        starts = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(self.starts[rows] - starts, lengths)
        return Features(self.word[rows], self.piece[:, at], self.valid[:, at], starts, np.repeat(np.arange(len(rows)), lengths))

    def vectors(self, p: Params) -> np.ndarray:
        """(words, WORD_DIM + CHAR_DIM)."""
        chars = p["char"][self.piece[0]] * self.valid[0][:, None] + p["char"][self.piece[1]] * self.valid[1][:, None]
        return np.concatenate((p["word"][self.word], np.add.reduceat(chars, self.starts, axis=0)), axis=1)

    def backward(self, d: np.ndarray, grads: Params) -> None:
        def put(name: str, at: np.ndarray, rows: np.ndarray) -> None:
            for k in range(rows.shape[1]):
                grads[name][:, k] += np.bincount(at, rows[:, k], len(grads[name]))

        put("word", self.word, d[:, :WORD_DIM])
        spread = d[:, WORD_DIM:][self.owner]
        for k in (0, 1):
            put("char", self.piece[k], spread * self.valid[k][:, None])


def initial(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    inputs, states = WORD_DIM + CHAR_DIM, 2 * HIDDEN
    shapes = {
        "word": (WORD_BUCKETS, WORD_DIM), "char": (CHAR_BUCKETS, CHAR_DIM),
        "in": (2, inputs, 3 * HIDDEN), "in_bias": (2, 1, 3 * HIDDEN), "state": (2, HIDDEN, 3 * HIDDEN),
        "attend": (states, ATTEND), "attend_bias": (ATTEND,), "attend_out": (ATTEND,), "out": (states,), "out_bias": (1,),
    }
    scale = {"word": 0.1, "char": 0.1, "in": 0.5, "state": 0.3, "attend": 0.3, "attend_out": 0.3, "out": 0.5}
    return {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shapes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gates(p: Params, vectors: np.ndarray) -> np.ndarray:
    """(2, words, 3 HIDDEN): each word's part of the gates, per direction."""
    return vectors @ p["in"] + p["in_bias"]


def forward(p: Params, table: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows. ``at`` (windows, length) are rows of ``table`` = gates(...)."""
    n, length = at.shape
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((length, n, 2 * HIDDEN), np.float32)
    trail = []
    both = 2 * HIDDEN
    for t in range(length):
        x = np.stack((table[0][at[:, t]], table[1][at[:, length - 1 - t]]))
        u = h @ p["state"]
        zr = _sigmoid(x[..., :both] + u[..., :both])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        c = np.tanh(x[..., both:] + r * u[..., both:])
        new = c + z * (h - c)
        if keep:
            trail.append((h, zr, c, u[..., both:]))
        h = new
        states[t, :, :HIDDEN] = h[0]
        states[length - 1 - t, :, HIDDEN:] = h[1]
    a = np.tanh(states @ p["attend"] + p["attend_bias"])
    e = a @ p["attend_out"]
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", alpha, states)
    return pooled @ p["out"] + p["out_bias"][0], {"trail": trail, "states": states, "a": a, "alpha": alpha, "pooled": pooled}


def backward(p: Params, at: np.ndarray, trace: dict, d: np.ndarray, grads: Params, d_table: np.ndarray) -> None:
    """Add the gradients of ``sum(d * logits)``."""
    n, length = at.shape
    states, a, alpha, pooled = trace["states"], trace["a"], trace["alpha"], trace["pooled"]
    both = 2 * HIDDEN
    grads["out"] += d @ pooled
    grads["out_bias"] += d.sum()
    d_pooled = d[:, None] * p["out"]
    d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    grads["attend_out"] += np.einsum("tn,tnk->k", d_e, a)
    d_a = d_e[..., None] * p["attend_out"] * (1 - a * a)
    grads["attend"] += states.reshape(-1, both).T @ d_a.reshape(-1, a.shape[-1])
    grads["attend_bias"] += d_a.sum((0, 1))
    d_states = alpha[..., None] * d_pooled + d_a @ p["attend"].T
    dh = np.zeros((2, n, HIDDEN), np.float32)
    flow = np.empty((2, length, n, 3 * HIDDEN), d_table.dtype)
    for t in range(length - 1, -1, -1):
        h, zr, c, uc = trace["trail"][t]
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        dh = dh + np.stack((d_states[t, :, :HIDDEN], d_states[length - 1 - t, :, HIDDEN:]))
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * uc * r * (1 - r)
        dx = np.concatenate((dz, dr, dc), axis=-1)
        du = np.concatenate((dz, dr, dc * r), axis=-1)
        grads["state"] += np.swapaxes(h, 1, 2) @ du
        dh = dh * z + du @ np.swapaxes(p["state"], 1, 2)
        flow[0, t], flow[1, length - 1 - t] = dx
    # sums per row of the table, of rows brought together by one sort
    rows = at.T.ravel()
    order = np.argsort(rows, kind="stable")
    firsts = np.flatnonzero(np.diff(rows[order], prepend=-1))
    for k in (0, 1):
        d_table[k, rows[order[firsts]]] += np.add.reduceat(flow[k].reshape(len(rows), -1)[order], firsts, axis=0)


def windows(n: int, stride: int = STRIDE) -> np.ndarray:
    """Starts of all windows of a text of ``n`` words."""
    if n <= SPAN:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - SPAN, stride), n - SPAN)


def _by_length(texts: list[np.ndarray], stride: int = STRIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, rows) of equally long windows: all full ones, then those of shorter texts."""
    groups: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for i, rows in enumerate(texts):
        starts, length = windows(len(rows), stride), min(SPAN, len(rows))
        owners, parts = groups.setdefault(length, ([], []))
        owners.append(np.full(len(starts), i))
        parts.append(rows[starts[:, None] + np.arange(length)])
    for owners, parts in groups.values():
        yield np.concatenate(owners), np.concatenate(parts)


@dataclass
class Model:
    """Weights and the logit that scores ``THRESHOLD``."""

    params: Params
    centre: float = 0.0
    scale: float = 1.0
    words: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    used: int = 0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each whole text."""
        split = [words_of(t) for t in texts]
        new = list({w for s in split for w in s} - self.words.keys())
        if self.used + len(new) > REMEMBERED:
            self.words, self.used = {}, 0
            new = list({w for s in split for w in s})
        if self.table is None or self.used + len(new) > self.table.shape[1]:
            size = max(self.used + len(new), min(2 * (self.used + len(new)), REMEMBERED))
            grown = np.empty((2, size, 3 * HIDDEN), np.float32)
            if self.used:
                grown[:, : self.used] = self.table[:, : self.used]
            self.table = grown
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.table[:, self.used : self.used + len(part)] = gates(self.params, Features.of(part).vectors(self.params))
            self.words.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)
        at = self.words.__getitem__
        out = np.full(len(texts), -np.inf, np.float32)
        for owners, rows in _by_length([np.fromiter(map(at, s), np.int64, len(s)) for s in split], SCORE_STRIDE):
            for k in range(0, len(rows), WINDOWS):
                np.maximum.at(out, owners[k : k + WINDOWS], forward(self.params, self.table, rows[k : k + WINDOWS])[0])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        shift = math.log(THRESHOLD / (1 - THRESHOLD))
        x = (self.logits(texts).astype(np.float64) - self.centre) * self.scale + shift
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(texts: list[str | None], labels: list[int], steps: int = STEPS, seed: int = 7) -> Model:
    """Fit a model to whole texts. With one label or none the scores are constant at its share."""
    truth = np.array(labels, np.float32)
    if not len(truth) or truth.min() == truth.max():
        flat = initial(seed)
        flat["out"][:] = 0
        return Model(flat, centre=-10.0 if len(truth) and truth.max() > 0 else 10.0)
    split = [words_of(t) for t in texts]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for s in split for w in s))}
    names = list(known)
    rows, every = [np.array([known[w] for w in s]) for s in split], Features.of(names)
    p, rng = initial(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    weight = np.where(truth > 0, 0.5 / truth.mean(), 0.5 / (1 - truth.mean())).astype(np.float32)
    while step < steps:
        order = rng.permutation(len(rows))
        for b in range(0, len(order), DOCS_A_STEP):
            if step == steps:
                break
            own = order[b : b + DOCS_A_STEP]
            picked, inverse = np.unique(np.concatenate([rows[i] for i in own]), return_inverse=True)
            local = np.split(inverse, np.cumsum([len(rows[i]) for i in own])[:-1])
            features = every.take(picked)
            vectors = features.vectors(p)
            table = gates(p, vectors)
            runs = [(owner, at, *forward(p, table, at, keep=True)) for owner, at in _by_length(local)]
            owner = np.concatenate([r[0] for r in runs])
            logits = np.concatenate([r[2] for r in runs])
            top = np.full(len(own), -np.inf, np.float32)
            np.maximum.at(top, owner, logits)
            share = np.exp(logits - top[owner])
            sums = np.bincount(owner, share, len(own)).astype(np.float32)
            pooled = top + np.log(sums)
            error = (_sigmoid(pooled) - truth[own]) * weight[own] / len(own)
            d = (error[owner] * share / sums[owner]).astype(np.float32)
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            d_table = np.zeros_like(table)
            at = 0
            for _, ids, out, trace in runs:
                backward(p, ids, trace, d[at : at + len(out)], grads, d_table)
                at += len(out)
            grads["in"] += np.swapaxes(np.broadcast_to(vectors, (2, *vectors.shape)), 1, 2) @ d_table
            grads["in_bias"] += d_table.sum(1, keepdims=True)
            features.backward((d_table @ np.swapaxes(p["in"], 1, 2)).sum(0), grads)
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return _calibrated(Model(p), texts, truth)


def _calibrated(model: Model, texts: list[str | None], truth: np.ndarray) -> Model:
    """Put the cut with the best F1 on the sample, midway between its neighbours, at ``THRESHOLD``."""
    x = model.logits(texts)
    order = np.argsort(-x, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(x) + 1) + truth.sum())
    k = int(np.argmax(f1))
    low = x[order[k + 1]] if k + 1 < len(x) else x[order[k]] - 1
    model.centre = float((x[order[k]] + low) / 2)
    model.words, model.table, model.used = {}, None, 0
    return model


def is_held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model:
    """Train on labelled rows outside the held-out quarter.

    Of the ids of each label with a text of up to ``SAMPLE_CHARS`` characters
    those with the least hash are used, ``sample`` rows of each, so that the
    driver holds a bounded sample. Rows with null ids, labels or texts are not
    learned from.
    """
    sample = SAMPLE if sample is None else sample
    own = docs.filter("doc_id is not null and text is not null").filter(F.length("text") <= SAMPLE_CHARS).select(F.col("doc_id").alias("id"), "text")
    known = labels.filter("doc_id is not null").filter(~is_held_out(F.col("doc_id"))).join(own.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    ids = kept(sampled_ids(known, "doc_id", "toxic", {y: 2 * n for y, n in sample.items()}), "sample")  # bounded: twice the sample
    rows = sorted((r["class"], r["mark"], r["id"], r["text"]) for r in own.join(F.broadcast(ids), "id").collect())
    picked = [[r for r in rows if r[0] == y][:n] for y, n in sample.items()]
    return train([r[3] for part in picked for r in part], [r[0] for part in picked for r in part])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per input row; null texts are scored as empty."""
    params, centre, scale = model.params, model.centre, model.scale

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(params, centre, scale)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(part.column(1).to_pylist()))], ["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = picked.mapInArrow(compute, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; columns and repeated rows stay."""
    params, centre, scale = model.params, model.centre, model.scale
    at = docs.columns.index("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(params, centre, scale)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array(own.scores(part.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(compute, docs.schema)
