"""Quality classifier by co-training of two views.

The text view sees a document's byte shares and a few counts over its words,
the metadata view its language, source, length and layout.  Each has a logistic
classifier fitted on labelled documents.  For some rounds each view labels the
unlabelled documents it is surest of and hands them to the other view.  Both
are then calibrated on held-out labels (Platt scaling), and their log odds are
added, each weighted by how well it ranks the held-out labels, to score every
document.

Fitting uses a bounded sample, ``LABELLED`` labelled and ``UNLABELLED`` other
documents by hash, whole texts; features and scores cover all documents.

Nulls: a null text is an empty one, a null language or source a value of its
own.  Labels that are null are left out, of labels that differ the bad one counts; without labels of both kinds every
document scores the share of good ones (1 without any) and is kept.  Repeated
rows get equal scores.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.common import cut, ship

LABELLED = 4_000
UNLABELLED = 4_000
ROUNDS = 4
#: Share of the unlabelled sample that a view hands over in a round.
HAND_OVER = 0.05
TEXT_DIM = 256 + 6
META_DIM = 16 + 64 + 4


def text_features(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    out = np.zeros(TEXT_DIM, np.float32)
    if not data:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data))
    words = data.split()
    if words:
        n = len(words)
        distinct = len(set(words))
        again = sum(a == b for a, b in zip(words, words[1:]))
        sizes = np.fromiter(map(len, words), np.float32, n)
        out[256:] = (1.0, distinct / n, again / n, sizes.mean() / 10, min(4.0, sizes.std() / 10), math.log1p(n) / 10)
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None, n_lines: int) -> np.ndarray:
    import xxhash

    out = np.zeros(META_DIM, np.float32)
    out[xxhash.xxh64_intdigest(f"lang{lang}") % 16] = 1
    out[16 + xxhash.xxh64_intdigest(f"source{source}") % 64] = 1
    n = max(0, n_chars or 0)
    out[80:] = (math.log1p(n) / 10, math.log1p(n_lines) / 10, math.log1p(n / max(1, n_lines)) / 10, float(n == 0))
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_x, meta_x: float32 bytes of both views for every row."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text_x, meta_x = [], []
            for lang, source, n, t in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                text_x.append(text_features(t).tobytes())
                meta_x.append(meta_features(lang, source, n, (t or "").count("\n") + 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_x, pa.binary()), pa.array(meta_x, pa.binary())], names=["doc_id", "text_x", "meta_x"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_x binary, meta_x binary")


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weighted logistic regression by accelerated gradient descent; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    weight = weight / weight.sum()
    rate = 1.0 / (0.25 * float((weight[:, None] * x * x).sum()) + ridge)
    w, ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (weight * (p - y)) + ridge * ahead)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(np.argsort(score)) + 1.0
    good = int(y.sum())
    bad = len(y) - good
    return 0.5 if not good or not bad else float((order[y == 1].sum() - good * (good + 1) / 2) / (good * bad))


def co_train(views: list[np.ndarray], y: np.ndarray, other: list[np.ndarray]) -> dict:
    """Classifiers, calibrations and weights of the views."""
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    scale = [(v.mean(axis=0), v.std(axis=0) + 1e-3) for v in views]
    norm = lambda v, i: np.clip((v - scale[i][0]) / scale[i][1], -8, 8)
    xs = [norm(v, i) for i, v in enumerate(views)]
    us = [norm(v, i) for i, v in enumerate(other)]
    pool = [(x[~held], y[~held]) for x in xs]
    taken = np.zeros(len(us[0]), bool)
    share = float(y.mean())

    def balanced(t):
        return np.where(t == 1, 0.5 / max(1, (t == 1).sum()), 0.5 / max(1, (t == 0).sum()))

    models = [_fit(x, t, balanced(t)) for x, t in pool]
    for _ in range(ROUNDS):
        n = int(HAND_OVER * len(taken))
        for i in (0, 1):
            free = np.flatnonzero(~taken)
            if not n or not len(free):
                break
            sure = _logit(us[i][free], models[i])
            order = np.argsort(sure, kind="stable")
            bad, good = order[: max(1, int(n * (1 - share)))], order[::-1][: max(1, int(n * share))]
            picks = [(k, 0) for k in bad if sure[k] < -1] + [(k, 1) for k in good if sure[k] > 1]
            if picks:
                rows = free[[k for k, _ in picks]]
                taken[rows] = True
                x, t = pool[1 - i]
                pool[1 - i] = (np.vstack([x, us[1 - i][rows]]), np.concatenate([t, [v for _, v in picks]]))
        models = [_fit(x, t, balanced(t)) for x, t in pool]
    proof = held if held.any() else np.ones(len(y), bool)
    out = {"views": [], "auc": []}
    for i in (0, 1):
        raw = _logit(xs[i][proof], models[i])
        a, b = _fit(raw[:, None] / 10, y[proof], np.ones(int(proof.sum())), ridge=1e-4)
        auc = _auc(raw, y[proof])
        out["views"].append({"mean": scale[i][0], "std": scale[i][1], "w": models[i], "a": a / 10, "b": b, "trust": max(0.0, 2 * auc - 1)})
        out["auc"].append(auc)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    clean = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # of labels that differ the bad one counts
    each = clean.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by_hash = lambda n, bound, *cols: F.pmod(F.xxhash64(*cols), F.lit(max(1, math.ceil(n / bound)))) == 0
    sample = cut(each.filter(by_hash(each.count(), LABELLED, "doc_id", F.lit("labelled"))))
    # both samples are bounded, so their ids may be broadcast; rows that repeat an id count once
    once = F.min(F.struct("text_x", "meta_x")).alias("x")
    labelled = features(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")).groupBy("doc_id").agg(once).join(sample, "doc_id").select("doc_id", "x.*", "quality").orderBy("doc_id").collect()
    y = np.array([r["quality"] for r in labelled], float)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 1.0, "auc": [0.5, 0.5]}
    # told by id and text, so rows without ids are sampled too, and copies of a row count once
    free = docs.filter(by_hash(docs.count(), UNLABELLED, "doc_id", F.col("text").cast("string"), F.lit("unlabelled"))).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    unlabelled = features(free).distinct().orderBy("doc_id", "text_x", "meta_x").collect()
    rows = lambda some, name, dim: np.array([np.frombuffer(r[name], np.float32) for r in some], np.float64).reshape(-1, dim)
    dims = (("text_x", TEXT_DIM), ("meta_x", META_DIM))
    return co_train([rows(labelled, n, d) for n, d in dims], y, [rows(unlabelled, n, d) for n, d in dims])


def score(docs: DataFrame, model: dict, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, quality, kept for every row."""
    both = features(docs)
    kind = both.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if "constant" in model:
                text = meta = quality = np.full(n, model["constant"])
                kept = np.ones(n, bool)
            else:
                logits = []
                for k, v in enumerate(model["views"]):
                    x = np.frombuffer(b"".join(batch.column(1 + k).to_pylist()), np.float32).reshape(n, -1)
                    x = np.clip((x - v["mean"]) / v["std"], -8, 8)
                    logits.append(v["a"] * _logit(x, v["w"]) + v["b"])
                trust = [v["trust"] + 1e-9 for v in model["views"]]
                total = sum(t * z for t, z in zip(trust, logits)) / max(trust)
                text, meta, quality = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logits, total))
                kept = quality >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(v, float)) for v in (text, meta, quality)), pa.array(kept)], names=["doc_id", "text_score", "meta_score", "quality", "kept"])

    return both.mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, quality double, kept boolean")
