"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. The encoder turns each passage into a vector: the mean of
learnt embeddings of its words and of the words' shapes, plus learnt weights of how varied and how long the passage
is, under tanh. Gated attention gives each passage the weight softmax(w . (tanh(V h) * sigmoid(U h))); the label is
predicted from the weighted sum of the passages. Only document labels are learnt from, so the attention finds by
itself which passages tell.

Learning reads a bounded sample of labelled rows, about ``docs_per_label`` whole documents of each label picked by a
hash of the id, and runs on the driver; scoring reads whole texts in one narrow pass.

Defined results: a null or empty text is one empty passage and gets the score of such; without labelled rows of both
kinds every score is 0.5; a document with both labels counts once for each; of several texts under a labelled id the
least is learnt from, so that what is gathered stays within the sample's bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, narrow

PASSAGE = 64
WORDS, SHAPES = 1024, 256
FEATURES = WORDS + SHAPES
HIDDEN, GATE = 16, 8
MEMO_ENTRIES = 300_000
#: Documents of a learning step, and how many steps a fit takes at least, however few documents there are.
BATCH, LEAST_STEPS = 64, 300
#: Words that are encoded at once.
SLICE = 1 << 17

_RUNS = re.compile(r"(.)\1+", re.S)


def shape_of(word: str) -> str:
    """Letters by case and digits by class, other characters as they are, runs shortened to two."""
    classes = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1\1", classes)


class _WordCodes(dict):
    """word -> hashed word and hashed shape in one integer; keeps the first words it meets, up to a bound."""

    def __missing__(self, word: str) -> int:
        lower = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) % WORDS
        shape = xxhash.xxh3_64_intdigest(shape_of(word).encode("utf-8", "surrogatepass")) % SHAPES
        code = lower * SHAPES + shape
        if len(self) < MEMO_ENTRIES and len(word) <= 64:
            self[word] = code
        return code


_codes = _WordCodes()


def word_codes(text: str | None) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(_codes.__getitem__, words), np.int32, len(words))


def passages_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages (one even without words), and two numbers on each: varied, short."""
    n = len(codes)
    starts = np.arange(0, max(n, 1), PASSAGE)
    sizes = np.minimum(PASSAGE, n - starts)
    if not n:
        return starts, np.array([[0.0, 1.0]], np.float32)
    keys = np.sort((np.arange(n, dtype=np.int64) // PASSAGE << 32) + codes)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    distinct = np.bincount((keys >> 32)[first], minlength=len(starts))
    return starts, np.column_stack([distinct / sizes, 1 - sizes / PASSAGE]).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> AttentionModel:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        return AttentionModel({"E": draw(FEATURES, HIDDEN), "D": draw(2, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)})

    def encode(self, codes: np.ndarray) -> np.ndarray:
        """One vector for each passage of a document, in bounded memory."""
        w = self.weights
        starts, dense = passages_of(codes)
        out = dense @ w["D"] + w["b"]
        step = SLICE // PASSAGE
        for at in range(0, len(starts) if len(codes) else 0, step):
            part = codes[at * PASSAGE : (at + step) * PASSAGE]
            rows = w["E"].take(part // SHAPES, axis=0) + w["E"].take(WORDS + part % SHAPES, axis=0)
            begins = np.arange(0, len(part), PASSAGE)
            sizes = np.minimum(PASSAGE, len(part) - begins)
            out[at : at + step] += np.add.reduceat(rows, begins, axis=0) / sizes[:, None]
        return np.tanh(out)

    def attention(self, h: np.ndarray) -> np.ndarray:
        w = self.weights
        logits = (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"]
        e = np.exp(logits - logits.max())
        return e / e.sum()

    def score(self, text: str | None) -> float:
        h = self.encode(word_codes(text))
        z = self.attention(h) @ h
        return float(_sigmoid(z @ self.weights["c"] + self.weights["d"][0]))

    def _gradients(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> dict[str, np.ndarray]:
        """bags: (passages x features) means and dense numbers of each document."""
        w = self.weights
        sizes = [len(x) for x, _ in bags]
        x, dense = np.concatenate([x for x, _ in bags]), np.concatenate([d for _, d in bags])
        begins = np.cumsum([0, *sizes])[:-1]
        bag = np.repeat(np.arange(len(bags)), sizes)
        h = np.tanh(x @ w["E"] + dense @ w["D"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logits = (t * g) @ w["w"]
        e = np.exp(logits - np.maximum.reduceat(logits, begins)[bag])
        a = e / np.add.reduceat(e, begins)[bag]
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        dy = ((_sigmoid(z @ w["c"] + w["d"][0]) - labels) / len(bags)).astype(np.float32)
        dz = dy[:, None] * w["c"]
        da = (dz[bag] * h).sum(1)
        dl = a * (da - np.add.reduceat(a * da, begins)[bag])
        dt, dg = dl[:, None] * w["w"] * g * (1 - t * t), dl[:, None] * w["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
        dp = dh * (1 - h * h)
        return {"E": x.T @ dp, "D": dense.T @ dp, "b": dp.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ dl, "c": z.T @ dy, "d": dy.sum(keepdims=True)}

    def train(self, documents: list[np.ndarray], labels: np.ndarray, *, epochs: int, rate: float, seed: int, batch: int = BATCH) -> None:
        """Adam over shuffled batches; ``documents`` are arrays of word codes."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(documents))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                grads = self._gradients([_bag(documents[i]) for i in chosen], labels[chosen])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - rate * change).astype(np.float32)


def _bag(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, dense = passages_of(codes)
    n = len(starts)
    at = np.arange(len(codes)) // PASSAGE * FEATURES
    x = np.bincount(np.concatenate([at + codes // SHAPES, at + WORDS + codes % SHAPES]), minlength=n * FEATURES).astype(np.float32).reshape(n, FEATURES)
    return x / np.maximum(np.minimum(PASSAGE, len(codes) - starts), 1)[:, None], dense


def learning_row(id_col: str = "doc_id"):
    return crc_bucket(id_col, 5) != 0


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_label: int = 800, epochs: int = 12, rate: float = 0.01, seed: int = 7) -> AttentionModel | None:
    """A model learnt from at most about ``docs_per_label`` documents of either label; None if a label is missing."""
    told = narrow(labels, id=id_col, label=label_col).where("id is not null and label in (0, 1)")
    sizes = dict(map(tuple, told.groupBy("label").count().collect()))
    if set(sizes) != {0, 1}:
        return None
    share = F.when(F.col("label") == 1, F.lit(min(1.0, docs_per_label / sizes[1]))).otherwise(F.lit(min(1.0, docs_per_label / sizes[0])))
    drawn = told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("id", "label").limit(4 * docs_per_label)
    rows = narrow(df, id=id_col, text=text_col).join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [word_codes(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.list_(pa.int32()))], ["id", "label", "codes"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    sample = rows.mapInArrow(code, f"id {types['id']}, label {types['label']}, codes array<int>").collect()
    sample = sorted(sample, key=lambda r: (r["id"], r["label"], len(r["codes"])))
    truth = np.array([r["label"] for r in sample], np.float32)
    if not len(truth) or truth.min() == truth.max():
        return None
    model = AttentionModel.fresh(seed)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(sample) // BATCH)))
    model.train([np.array(r["codes"], np.int32) for r in sample], truth, epochs=epochs, rate=rate, seed=seed)
    return model


def score(df: DataFrame, model: AttentionModel | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: ``id_col``, ``score`` (higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on, else 0)."""
    source = narrow(df, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # some 100 KB whatever the input

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [0.5 if m is None else m.score(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["id", "score", "predicted"])

    return source.mapInArrow(apply, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, model: AttentionModel | None, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores ``threshold`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m is None or m.score(x.as_py()) >= threshold for x in batch.column(text_col)], pa.bool_()))

    return df.mapInArrow(apply, df.schema)
