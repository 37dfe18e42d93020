"""A quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages, `passage` (64) consecutive words each, of which a label is
known for the whole bag only. A passage x (the square roots of its byte shares, and how long,
how varied and how repeated its words are; standardised by the learned rows) is encoded as
h = tanh(xW + b). Its gated attention is softmax over the document's passages of
(tanh(hV + v) * sigmoid(hU + u)) . w; a document is represented by the attention-weighted sum
of its encoded passages and scored by a logistic unit on that. All weights are learned
together, from document labels, by Adam on minibatches of documents.

fit() learns from labelled rows, at most about `rows` documents (4,000) picked by a hash of
their id, and at most about `passages` (60,000) passages of them, picked by whole documents;
documents of more than a tenth of that are not learned from. These bounds are parameters; the
documents that are learned from are read whole by the tasks, and the driver gets the passages'
features only, some 500 bytes each. predict() looks at every passage of every text, in a map
without a shuffle.

Null texts and texts without words are one empty passage and get a score like any other.
With several labels for an id the mean counts, 1 from a half on; null labels and null ids
are not learned from. If all labels are alike, or there are none, every score is the share of
label 1 with one of each label added. Rows that share an id are each scored. Results are
rounded to six decimals. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .storage import kept

SLICE = 2_000_000
N_FEATURES = 256 + 4
_FEATURES = pa.schema([("id", pa.int64()), ("y", pa.float64()), ("n", pa.int64()), ("x", pa.binary())])
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features(texts: list[bytes], passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of passages of each text (one at least)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
    doc = np.repeat(np.arange(len(texts)), sizes)
    gap = hashing.SPACE[raw]
    inside = ~gap
    starts = np.flatnonzero(inside & np.append(True, gap[:-1])) if len(raw) else np.zeros(0, np.int64)
    of = doc[starts]
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    count = np.maximum(1, -(-n // passage))
    base = np.cumsum(count) - count
    # the passage of each word, then of each byte: that of the last word that began
    home = base[of] + (np.arange(len(of)) - first[of]) // passage
    total = int(count.sum())
    x = np.zeros((total, N_FEATURES), np.float32)
    if len(starts):
        place = np.cumsum(np.bincount(starts, minlength=len(raw))) - 1
        begun = (place >= 0) & (of[np.maximum(place, 0)] == doc)
        bytes_ = np.bincount(home[place[begun]] * 256 + raw[begun], minlength=total * 256).reshape(total, 256)
        each = bytes_.sum(axis=1)
        x[:, :256] = np.sqrt(bytes_ / np.maximum(each, 1)[:, None])
        words = np.bincount(home, minlength=total)
        hashed = np.concatenate(hashing.words_of(texts))
        joined = hashing.join(hashed, home.astype(np.uint64))
        distinct = np.bincount(home[np.unique(joined, return_index=True)[1]], minlength=total)
        again = np.bincount(home[1:][joined[1:] == joined[:-1]], minlength=total)
        some = np.maximum(words, 1)
        x[:, 256] = np.log1p(words)
        x[:, 257] = np.log1p(each / some)
        x[:, 258] = distinct / some
        x[:, 259] = again / some
    return x, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Standardisation, weights by name, and the score that is given where nothing could be learned."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray] | None, passage: int, prior: float):
        self.mean, self.scale, self.weights, self.passage, self.prior = mean, scale, weights, passage, prior

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        """Encoded passages, gates, attention, representations and log-odds of the documents of standardised passages."""
        p = self.weights
        begin = np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"] + p["v"]), _sigmoid(h @ p["U"] + p["u"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(h * a[:, None], begin, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": z @ p["c"] + p["c0"], "bag": bag, "begin": begin}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        x, count = features(texts, self.passage)
        return _sigmoid(self.forward(self.standard(x), count)["s"].astype(np.float64))


def _gradients(m: Model, x: np.ndarray, count: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    p, f = m.weights, m.forward(x, count)
    h, t, g, a, z, bag, begin = (f[k] for k in ("h", "t", "g", "a", "z", "bag", "begin"))
    ds = ((_sigmoid(f["s"]) - y) / len(y)).astype(np.float32)
    dz = ds[:, None] * p["c"]
    da = (h * dz[bag]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, begin)[bag])
    dtg = de[:, None] * p["w"]
    dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
    found = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "v": dt.sum(axis=0), "U": h.T @ dg, "u": dg.sum(axis=0), "w": (t * g).T @ de, "c": z.T @ ds, "c0": ds.sum(keepdims=True)}
    return {k: v + decay * p[k] if v.ndim == 2 or k in ("w", "c") else v for k, v in found.items()}


def learn(x: np.ndarray, count: np.ndarray, y: np.ndarray, passage: int, width: int = 16, gates: int = 8, epochs: int = 30, step: float = 0.01, decay: float = 1e-4, seed: int = 1) -> Model:
    """x: features of the passages, document after document; count: their number in each document; y: the label of each document."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), None, passage, prior)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02

    def start(*shape):
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    weights = {"W": start(N_FEATURES, width), "b": np.zeros(width, np.float32), "V": start(width, gates), "v": np.zeros(gates, np.float32), "U": start(width, gates), "u": np.zeros(gates, np.float32), "w": start(gates), "c": start(width), "c0": np.array([np.log(prior / (1 - prior))], np.float32)}
    m = Model(mean, scale, weights, passage, prior)
    x, begin = m.standard(x), np.cumsum(count) - count
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    batch, done = 64, 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), step * (1 - epoch / epochs)
        for i in range(0, len(order), batch):
            bags = order[i : i + batch]
            rows = np.repeat(begin[bags], count[bags]) + np.arange(count[bags].sum()) - np.repeat(np.cumsum(count[bags]) - count[bags], count[bags])
            done += 1
            for k, d in _gradients(m, x[rows], count[bags], y[bags], decay).items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                weights[k] -= (rate * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)).astype(np.float32)
    return m


def sample(docs: DataFrame, labels: DataFrame, rows: int, passage: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, y, n (passages) and x (their features, as half floats) of the labelled documents that are learned from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True))

    def run(batches):
        for batch in batches:
            for part in hashing.bounded(batch, 1, SLICE):
                x, count = features([t or b"" for t in part.column(1).to_pylist()], passage)
                half, ends = x.astype(np.float16), np.cumsum(count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(count, pa.int64()), pa.array([half[b - n : b].tobytes() for b, n in zip(ends, count, strict=True)], pa.binary())], schema=_FEATURES)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    # at most about `rows` ids and numbers
    return texts.join(F.broadcast(picked), "id").select("id", "text", "y").mapInArrow(run, "id long, y double, n long, x binary")


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, passages: int = 60_000, passage: int = 64, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Model:
    """The model of `labels` (id_col and label_col, 0 or 1) on the texts of `docs`."""
    found = kept(sample(docs, labels, rows, passage, id_col, text_col, label_col)).where(F.col("n") <= passages // 10)
    size = found.agg(F.sum("n")).first()[0] or 0
    if size > passages:
        found = found.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * passages / size))
    told = found.toArrow().to_pylist()
    told.sort(key=lambda r: (r["id"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in told), np.float16).astype(np.float32).reshape(-1, N_FEATURES)
    return learn(x, np.array([r["n"] for r in told], np.int64), np.array([r["y"] for r in told], np.float32), passage, **options)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, the chance of label 1) of each row."""

    def run(batches):
        for batch in batches:
            for part in hashing.bounded(batch, 1, SLICE):
                score = model.score([t or b"" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(score, 6), pa.float64())], schema=_PREDICTED)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
