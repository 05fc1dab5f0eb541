"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes. Each passage is encoded by byte-class shares, its compressibility
and hashed byte pairs. A gated attention layer, learned from document labels alone, weighs
the passages; the score is a logistic unit on the weighted passage representation.

Training takes at most SAMPLE labelled documents, those with the smallest hashes, and every passage of them: where a document
has more than BAG, neighbouring passages are averaged into BAG, so that a bound holds for the driver; scoring encodes every passage of every text.

Defined results: null and empty texts are one empty passage and get a score; very long texts are many passages; ties in the hash of ids are ordered by doc_id; labels that are null
are not learned from; with labels of one class only, or none, every score is the share of label 1 (0.5
without labels); rows that repeat are scored each; a null doc_id counts as the empty text for
held_out; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

PASSAGE, SAMPLE, BAG = 1024, 6000, 24
CUT = 0.3
HIDDEN, GATE, EPOCHS, SEED = 24, 12, 30, 7
HASHED = 32

#: Byte classes: names only matter for reading; each byte has one.
_CLASSES = ("lower", "upper", "digit", "space", "line", "high", "stop", "mark", "pipe", "symbol", "other")


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), dtype=np.int64)
    for name, chars in (
        ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", bytes(range(48, 58))), ("space", b" \t"), ("line", b"\n\r"),
        ("high", bytes(range(128, 256))), ("stop", b".,;:"), ("mark", b"!?"), ("pipe", b"|"), ("symbol", b"#*$%&<>@^~={}[]\\/_+"),
    ):
        table[list(chars)] = _CLASSES.index(name)
    return table


def encode(text: str | None) -> np.ndarray:
    """Passages x features of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-len(raw) // PASSAGE))
    at = np.arange(len(raw)) // PASSAGE
    k = len(_CLASSES)
    sizes = np.maximum(np.bincount(at, minlength=n), 1).astype(np.float64)
    shares = np.bincount(at * k + _byte_classes()[raw], minlength=n * k).reshape(n, k) / sizes[:, None]
    pairs = (raw[:-1].astype(np.int64) * 131 + raw[1:] * 7) % HASHED if len(raw) > 1 else np.zeros(0, dtype=np.int64)
    hashed = np.bincount(at[1:] * HASHED + pairs, minlength=n * HASHED).reshape(n, HASHED) / sizes[:, None] if len(raw) > 1 else np.zeros((n, HASHED))
    data = raw.tobytes()
    packed = np.array([len(zlib.compress(data[s : s + PASSAGE], 1)) for s in range(0, n * PASSAGE, PASSAGE)]) / (sizes + 24)
    share = dict(zip(_CLASSES, shares.T, strict=True))
    letters = share["upper"] + share["lower"] + share["high"] + 1e-6
    more = np.stack([share["upper"] / letters, share["space"] / letters, (share["symbol"] + share["pipe"]) / (share["space"] + 0.01), share["mark"] / (share["space"] + 0.01), packed, np.log1p(sizes) / 7, np.full(n, np.log1p(len(raw)) / 12)], axis=1)
    return np.concatenate([np.sqrt(shares), more, np.sqrt(hashed)], axis=1)


def crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        bags = []
        for text in batch.column(1):
            x = encode(text.as_py())
            if len(x) > BAG:
                starts = np.arange(BAG) * len(x) // BAG
                x = np.add.reduceat(x, starts) / np.diff(starts, append=len(x))[:, None]
            bags.append(x.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], names=["label", "bag"])


class Model:
    """Gated attention pooling over passages, and a logistic unit; plain numpy."""

    def __init__(self, width: int, rate: float = 0.5, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale, self.rate = np.zeros(width), np.ones(width), rate
        self.p = {"W": draw(width, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE, 1)[:, 0], "o": draw(HIDDEN, 1)[:, 0], "c": np.zeros(1)}
        self.trained = False

    def _forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        """x: passages of n bags in order; bag: the bag of each."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        w = np.exp(e - top[bag])
        w /= np.bincount(bag, w, minlength=n)[bag]
        z = np.zeros((n, HIDDEN))
        np.add.at(z, bag, w[:, None] * h)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "w": w, "z": z, "y": y}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not self.trained:
            return np.full(len(bags), self.rate)
        return self._forward(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))["y"]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
        """Adam on the log loss, both classes weighing alike half-way; deterministic for the same bags in the same order."""
        self.rate = float(labels.mean()) if len(labels) else 0.5
        if len(set(labels.tolist())) < 2:
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng, p = np.random.default_rng(seed), self.p
        weight = np.where(labels == 1, (0.5 / self.rate) ** 0.5, (0.5 / (1 - self.rate)) ** 0.5)
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                n, bag = len(some), np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
                f = self._forward(np.concatenate([bags[i] for i in some]), bag, n)
                d = (f["y"] - labels[some]) * weight[some] / n
                g = {"o": f["z"].T @ d, "c": np.array([d.sum()])}
                dz = d[:, None] * p["o"]
                dw = (dz[bag] * f["h"]).sum(axis=1)
                dh = f["w"][:, None] * dz[bag]
                de = f["w"] * (dw - np.bincount(bag, f["w"] * dw, minlength=n)[bag])
                g["a"] = (f["t"] * f["s"]).T @ de
                dt, ds = de[:, None] * p["a"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["s"] * (1 - f["s"])
                g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
                dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
                g["W"], g["b"] = f["x"].T @ dh, dh.sum(axis=0)
                step += 1
                rate = 0.01 * (1 - epoch / epochs) + 0.0005
                for k in p:
                    grad = g[k] + 1e-5 * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.trained = True
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows that aren't held out; at most ``sample`` of them, by the smallest hashes of their ids, reach the driver (BAG passages each).

    Of rows that share a doc_id the text with the smallest hash counts, so the bound is one of rows.
    """
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.filter(crc(F.col("doc_id")) % 5 != 0).select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` ids
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))  # and one row an id
    width = encode("").shape[1]
    found = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(_encoded, "label int, bag binary").collect()
    found.sort(key=lambda r: (r["bag"], r["label"]))  # the order of tasks mustn't matter
    bags = [np.frombuffer(r["bag"], dtype="<f4").reshape(-1, width).astype(np.float64) for r in found]
    return Model(width).fit(bags, np.array([r["label"] for r in found], dtype=np.float64))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        scores: list[float] = []
        held: list[np.ndarray] = []
        for text in batch.column(1):
            held.append(encode(text.as_py()))
            if sum(map(len, held)) > 4096:
                scores += model.score(held).tolist()
                held = []
        if held:
            scores += model.score(held).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_score, model=model), f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
