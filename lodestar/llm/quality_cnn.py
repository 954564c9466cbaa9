"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over the bytes of the whole text. Their outputs are max-pooled in overlapping
chunks of 256 bytes (each half belongs to two chunks), every chunk gets a logit, and the text's
chunk logits (mean, highest, lowest, share below zero) are combined into one probability.

It is fitted on the driver on a bounded sample: at most `per_class` labelled documents of each class,
taken in hash order, and `chunks_each` chunks of each, which the executors cut out; the driver never holds a whole text. The
chunk summaries of the sampled documents are computed by the executors too. Scoring covers every byte.

Defined cases: null and empty texts are scored as a chunk of zero bytes; labels without a
document are unused; of labels or documents that repeat an id one is taken for the fit; repeated rows are scored each; without any label of both classes every score is
0.5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import annotate, cut, fresh

HALF, STRIDE, DIM, FILTERS, HIDDEN = 128, 4, 8, 32, 16


class ByteCNN:
    """Embedding, one convolution of width 8 and stride 4, ReLU, max pool, two dense layers."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        w = STRIDE * DIM
        self.p = {
            "emb": r.normal(0, 0.5, (256, DIM)), "left": r.normal(0, 1 / np.sqrt(2 * w), (w, FILTERS)), "right": r.normal(0, 1 / np.sqrt(2 * w), (w, FILTERS)), "cb": np.zeros(FILTERS),
            "w1": r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][0] = 0
        self.doc = np.zeros(5, np.float64)

    def conv(self, data: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Filter outputs at the strides of `data` (bytes, one stride more than outputs); strides that end a text (`last`) see none behind."""
        x = self.p["emb"][data].reshape(-1, STRIDE * DIM)
        right = x[1:] @ self.p["right"]
        right[last] = 0
        return x[:-1] @ self.p["left"] + right

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(np.maximum(pooled + self.p["cb"], 0) @ self.p["w1"] + self.p["b1"], 0)
        return h @ self.p["w2"] + self.p["b2"]

    def chunk_logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all chunks, and where each text's chunks begin."""
        halves = np.array([max(2, -(-(len(t) + STRIDE) // HALF)) for t in texts], np.int64)
        data = np.frombuffer(b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves, strict=True)), np.uint8)
        data = np.append(data, np.zeros(STRIDE, np.uint8))
        pooled = np.empty((len(data) // HALF, FILTERS), np.float32)
        ends = np.cumsum(halves)
        last = np.zeros(len(pooled), bool)
        last[ends - 1] = True
        step = 4096
        for at in range(0, len(pooled), step):
            to = min(at + step, len(pooled))
            stops = (np.flatnonzero(last[at:to]) + 1) * (HALF // STRIDE) - 1
            block = data[at * HALF : to * HALF + STRIDE]
            pooled[at:to] = self.conv(block, stops).reshape(-1, HALF // STRIDE, FILTERS).max(axis=1)
        chunks = np.maximum(pooled[:-1], pooled[1:])[~last[:-1]]
        return self.logits(chunks), ends - halves - np.arange(len(texts))

    def features(self, texts: list[bytes]) -> np.ndarray:
        logits, starts = self.chunk_logits(texts)
        logits = np.clip(logits, -12, 12).astype(np.float64)
        n = np.diff(np.append(starts, len(logits)))
        cols = [np.add.reduceat(logits, starts) / n, np.maximum.reduceat(logits, starts), np.minimum.reduceat(logits, starts), np.add.reduceat(logits < 0, starts, dtype=np.float64) / n]
        return np.stack([*cols, np.ones(len(texts))], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.doc, -30, 30))) if texts else np.zeros(0)

    def _step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss for chunks x (bytes) with labels y."""
        p, k = self.p, x.shape[1] // STRIDE
        e = p["emb"][x].reshape(len(x), k, STRIDE * DIM)
        c = e @ p["left"]
        c[:, :-1] += e[:, 1:] @ p["right"]
        top = c.argmax(axis=1)
        rows = np.arange(len(x))[:, None]
        pooled = c[rows, top, np.arange(FILTERS)] + p["cb"]
        a = np.maximum(pooled, 0)
        z = a @ p["w1"] + p["b1"]
        h = np.maximum(z, 0)
        out = h @ p["w2"] + p["b2"]
        d = (1 / (1 + np.exp(-out)) - y) * weight / len(x)
        g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
        dh = d[:, None] * p["w2"] * (z > 0)
        g |= {"w1": a.T @ dh, "b1": dh.sum(0)}
        da = (dh @ p["w1"].T) * (pooled > 0)
        g["cb"] = da.sum(0)
        dc = np.zeros_like(c)
        dc[rows, top, np.arange(FILTERS)] = da
        w = STRIDE * DIM
        g["left"] = e.reshape(-1, w).T @ dc.reshape(-1, FILTERS)
        g["right"] = e[:, 1:].reshape(-1, w).T @ dc[:, :-1].reshape(-1, FILTERS)
        de = dc @ p["left"].T
        de[:, 1:] += dc[:, :-1] @ p["right"].T
        flat, ids = de.reshape(-1, DIM), x.ravel()
        g["emb"] = np.stack([np.bincount(ids, flat[:, j], 256) for j in range(DIM)], axis=1).astype(np.float32)
        g["emb"][0] = 0
        return g

    def fit_filters(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 3e-3, seed: int = 11) -> ByteCNN:
        """Fit the network to chunks x (rows of 2 * HALF bytes) with labels y."""
        if len(set(y.tolist())) < 2:
            return self
        r = np.random.default_rng(seed)
        y = y.astype(np.float32)
        share = y.mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            lr = rate * (1 - epoch / epochs)
            for at in range(0, len(x), batch):
                pick, t = order[at : at + batch], t + 1
                for k, g in self._step(x[pick], y[pick], weight[pick]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.p[k] -= (lr * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def fit_summaries(self, f: np.ndarray, labels: np.ndarray, prior: float | None = None) -> ByteCNN:
        """Fit the last step to chunk summaries f of documents; prior is the share of good texts where they were drawn."""
        if len(set(labels.tolist())) < 2:
            return self
        w = np.zeros(f.shape[1])
        prior = labels.mean() if prior is None else prior
        own = np.where(labels > 0, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
        for _ in range(30):  # Newton steps of a ridge logistic regression
            q = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            hess = (f * (own * q * (1 - q))[:, None]).T @ f + 1e-1 * np.eye(len(w))
            w = w - np.linalg.solve(hess, f.T @ (own * (q - labels)) + 1e-1 * w)
        self.doc = w
        return self


def draw_chunks(text: bytes, chunks_each: int) -> bytes:
    """Up to chunks_each chunks from places that the text itself decides, padded with zeros; some are cut short, as short texts occur too."""
    r = np.random.default_rng([len(text), zlib.crc32(text)])
    out = []
    for at in r.integers(0, max(1, len(text) - 2 * HALF + 1), min(chunks_each, 1 + len(text) // HALF)).tolist():
        size = int(r.integers(4, 2 * HALF)) if r.random() < 0.3 else 2 * HALF
        out.append(text[at : at + size].ljust(2 * HALF, b"\0"))
    return b"".join(out)


def id_bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, folds: int = 3, held: int = 1, chunks_each: int = 6, **options) -> ByteCNN:
    """A network fitted to at most `per_class` labelled documents of each class outside the held-out fold."""
    pool = labels.where((id_bucket("doc_id", folds) != held) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [pool.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = cut(picked[0].unionByName(picked[1]), "op7-picked")  # 2 * per_class ids at most
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")

    def chunks():
        import pyarrow as pa

        return lambda texts: [pa.array([draw_chunks(t, chunks_each) for t in texts], pa.binary()), pa.array([zlib.crc32(t) for t in texts], pa.int64())]

    drawn = annotate(sample, "text", "chunks binary, crc long", chunks, ["doc_id", "quality"])
    rows = drawn.groupBy("doc_id", "quality").agg(F.min(F.struct("crc", "chunks")).alias("c")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["c"]["chunks"] for r in rows), np.uint8).reshape(-1, 2 * HALF)
    y = np.repeat(np.array([r["quality"] for r in rows], np.float64), [len(r["c"]["chunks"]) // (2 * HALF) for r in rows])
    model = ByteCNN().fit_filters(x, y, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def summaries():
        import pyarrow as pa

        def work(texts):
            f = shared.value.features(texts) if texts else np.zeros((0, 5))
            return [*[pa.array(c) for c in f.T], pa.array([zlib.crc32(t) for t in texts], pa.int64())]

        return work

    made = annotate(sample, "text", "f0 double, f1 double, f2 double, f3 double, f4 double, crc long", summaries, ["doc_id", "quality"], slice_bytes=2 << 20)
    found = made.groupBy("doc_id", "quality").agg(F.min(F.struct("crc", *[f"f{i}" for i in range(5)])).alias("c")).collect()
    found.sort(key=lambda r: r["doc_id"])
    f = np.array([[r["c"][f"f{i}"] for i in range(5)] for r in found]).reshape(-1, 5)
    return model.fit_summaries(f, np.array([r["quality"] for r in found], np.float64), pool.agg(F.avg("quality")).first()[0])


def score_documents(docs: DataFrame, model: ByteCNN, keep: list[str], name: str = "score") -> DataFrame:
    """`keep` columns and the model's score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa

        return lambda texts: [pa.array(shared.value.score(texts), pa.float64())]

    return annotate(docs, "text", f"`{name}` double", make, keep, slice_bytes=2 << 20)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_documents(docs, train(docs, labels, folds=folds, held=held, **options), ["doc_id"])
    return scored.select("doc_id", (id_bucket("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """`docs` whose score is `least` or more; same columns."""
    name = fresh(docs, "quality_score")
    return score_documents(docs, train(docs, labels, **options), docs.columns, name).where(F.col(name) >= least).select(*docs.columns)


def op7_quality_cnn(spark, sf_dir):
    """Every document of `documents` scored as `labels.quality` marks it."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
