"""Clause scorers: recurrent models run in numpy from given weights, and a logistic default.

The recurrent models take weights by name from a dict of arrays (``numpy.load`` of an .npz file).
Without weights, ``fit_default`` trains a logistic regression on clause features from labelled rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import grammar as g

PAD, MASKED = 0, 3  # fixed values: padding id and the id that pooling leaves out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def gru(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    """Hidden states over (steps, width); inputs of all steps are projected at once."""
    inner = x @ w[f"{name}.Wx"].T + w[f"{name}.b"]
    wh, bhn = w[f"{name}.Wh"], w[f"{name}.bhn"]
    n = len(bhn)
    h, out = np.zeros(n), np.empty((len(x), n))
    for k, row in enumerate(inner):
        back = wh @ h
        gate = sigmoid(row[: 2 * n] + back[: 2 * n])
        new = np.tanh(row[2 * n :] + gate[:n] * (back[2 * n :] + bhn))
        h = (1 - gate[n:]) * new + gate[n:] * h
        out[k] = h
    return out


def both_ways(x: np.ndarray, w: dict[str, np.ndarray], prefix: str) -> np.ndarray:
    return np.concatenate([gru(x, w, f"{prefix}_forward"), gru(x[::-1], w, f"{prefix}_backward")[::-1]], axis=1)


def pooled(units: list[list[int]], w: dict[str, np.ndarray]) -> np.ndarray:
    """Mean embeddings; short units are padded with id 0, which counts, while id 3 does not."""
    ids = np.full((len(units), max(map(len, units))), PAD)
    for k, u in enumerate(units):
        ids[k, : len(u)] = u
    on = (ids != MASKED)[..., None]
    return (w["embedding.weight"][ids] * on).sum(axis=1) / np.maximum(on.sum(axis=1), 1)


def norm_and_attend(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Layer norm and one residual attention head, where the weights have them."""
    if "norm.weight" in w:
        x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5) * w["norm.weight"] + w["norm.bias"]
    if "attention_query.weight" in w:
        q, k, v = (x @ w[f"attention_{n}.weight"].T + w[f"attention_{n}.bias"] for n in ("query", "key", "value"))
        s = q @ k.T / np.sqrt(q.shape[1])
        s = np.exp(s - s.max(axis=1, keepdims=True))
        x = x + (s / s.sum(axis=1, keepdims=True)) @ v
    return x


def document_logits(units: list[list[int]], w: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of the clauses of one window: mean embeddings, two-way recurrence, linear head."""
    x = norm_and_attend(both_ways(pooled(units, w), w, "document"), w)
    return (x @ w["keep_head.weight"].T + w["keep_head.bias"])[:, 0]


def hierarchical_logits(units: list[list[int]], w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(logits, unit vectors of length 1): recurrence within each clause, then over clauses."""
    rows = []
    for u in units:
        local = both_ways(w["embedding.weight"][np.array(u)], w, "local")
        rows.append(local.mean(axis=0))
    x = both_ways(np.stack(rows), w, "document")
    s = x @ w["semantic_head.weight"].T + w["semantic_head.bias"]
    return (x @ w["keep_head.weight"].T + w["keep_head.bias"])[:, 0], s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)


def word_probabilities(clauses: list[list[int]], w: dict[str, np.ndarray]) -> np.ndarray:
    """Keep probability per clause from hashed word ids; two-class softmax."""
    e = w["embedding.weight"]
    x = np.stack([e[np.array(c)].mean(axis=0) if c else np.zeros(e.shape[1]) for c in clauses])
    x = np.concatenate([gru(x, w, "forward_gru"), gru(x[::-1], w, "backward_gru")[::-1]], axis=1)
    z = x @ w["classifier.weight"].T + w["classifier.bias"]
    return sigmoid(z[:, 1] - z[:, 0])


def window_scores(units: list[list[int]], w: dict[str, np.ndarray], size: int = 64) -> list[float]:
    """Scores in runs of ``size`` units, nothing carried from one run to the next."""
    return [float(s) for k in range(0, len(units), size) for s in sigmoid(document_logits(units[k : k + size], w))]


def parameter_count(w: dict[str, np.ndarray]) -> int:
    return int(sum(a.size for a in w.values()))


def adaptive_threshold(std: Column, base: float = 0.28) -> Column:
    """Base moved by .3 std - .1, by at most .1, kept within .1 and .6."""
    move = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), std * 0.3 - 0.1))
    return F.greatest(F.lit(0.1), F.least(F.lit(0.6), F.lit(base) + move))


def quantize(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Head and attention weights as 8-bit integers with a scale; the others unchanged."""
    out: dict[str, np.ndarray] = {}
    for name, a in w.items():
        if "keep_head" in name or "attention" in name:
            scale = float(np.abs(a).max()) / 127.0 or 1.0
            out[name], out[name + "_scale"] = np.clip(np.rint(a / scale), -127, 127).astype(np.int8), np.float32(scale)
        else:
            out[name] = a
    return out


def start_weights(vocab: int = 8000, width: int = 64, hidden: int = 128, seed: int = 7, attention: bool = False) -> dict[str, np.ndarray]:
    """Untrained weights in the layout of ``document_logits``."""
    r = np.random.default_rng(seed)
    w = {"embedding.weight": r.normal(0, 0.1, (vocab, width))}
    for d in ("document_forward", "document_backward"):
        k = hidden**-0.5
        w |= {f"{d}.Wx": r.uniform(-k, k, (3 * hidden, width)), f"{d}.Wh": r.uniform(-k, k, (3 * hidden, hidden)), f"{d}.b": r.uniform(-k, k, 3 * hidden), f"{d}.bhn": r.uniform(-k, k, hidden)}
    if attention:
        w |= {"norm.weight": np.ones(2 * hidden), "norm.bias": np.zeros(2 * hidden)}
        for n, rows in (("query", max(1, hidden // 4)), ("key", max(1, hidden // 4)), ("value", 2 * hidden)):
            w |= {f"attention_{n}.weight": r.normal(0, 0.05, (rows, 2 * hidden)), f"attention_{n}.bias": np.zeros(rows)}
    return w | {"keep_head.weight": r.normal(0, 0.05, (1, 2 * hidden)), "keep_head.bias": np.zeros(1)}


def fit_head(windows: list[tuple[list[list[int]], list[int]]], w: dict[str, np.ndarray], epochs: int = 30, rate: float = 0.05, decay: float = 0.01) -> dict[str, np.ndarray]:
    """Train the linear head on fixed recurrent features with class-balanced logistic loss; the best epoch is kept.

    The windows are a bounded list on the driver; training is offline.
    """
    xs = [norm_and_attend(both_ways(pooled(u, w), w, "document"), w) for u, _ in windows]
    x, y = np.concatenate(xs), np.concatenate([np.array(l, dtype=float) for _, l in windows])
    pos = max(1.0, y.sum())
    weight = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * max(1.0, len(y) - pos)))
    v, b = w["keep_head.weight"][0].copy(), float(w["keep_head.bias"][0])
    best = (np.inf, v.copy(), b)
    m, s, t = np.zeros(len(v) + 1), np.zeros(len(v) + 1), 0
    for _ in range(epochs):
        p = sigmoid(x @ v + b)
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean())
        if loss < best[0]:
            best = (loss, v.copy(), b)
        d = weight * (p - y)
        grad = np.append(x.T @ d / len(y), d.mean())
        t += 1
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        v, b = v - step[:-1] - rate * decay * v, b - step[-1]
    return {**w, "keep_head.weight": best[1][None, :], "keep_head.bias": np.array([best[2]])}


# ---- logistic default on clause features

FEATURES = ["f_len", "f_words", "f_digits", "f_upper", "f_path", "f_code", "f_status", "f_narration", "f_question", "f_pos"]


def clause_features(clause: Column, pos: Column, of: Column) -> dict[str, Column]:
    """Features of a clause, all in the JVM."""
    at = lambda p: clause.rlike(rf"(?idU)(?<!\w)(?:{p})(?!\w)").cast("double")
    return {
        "f_len": F.log1p(F.length(clause)), "f_words": F.log1p(F.size(F.split(clause, r"\s+"))), "f_digits": F.length(F.regexp_replace(clause, r"\D", "")) / F.greatest(F.lit(1), F.length(clause)),
        "f_upper": F.length(F.regexp_replace(clause, r"(?U)[^\p{Lu}]", "")) / F.greatest(F.lit(1), F.length(clause)), "f_path": clause.rlike(r"\w/\w").cast("double"), "f_code": clause.rlike(r"`|\w_\w|[a-z][A-Z]").cast("double"),
        "f_status": at("|".join(p for k, p in g.STATUS.items())), "f_narration": at(g.NARRATION), "f_question": clause.contains("?").cast("double"), "f_pos": pos / F.greatest(F.lit(1), of),
    }


def labelled_clauses(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, clause, label, features) of clause-label rows whose labels fit their units."""
    x = rows.where(F.size("units") == F.size("labels")).select(key, F.size("units").alias("n"), F.posexplode(F.arrays_zip("units", "labels")).alias("pos", "z"))
    x = x.select(key, "pos", "n", F.col("z.units.text").alias("clause"), F.col("z.labels").cast("double").alias("label"))
    return x.withColumns(clause_features(F.col("clause"), F.col("pos"), F.col("n"))).na.fill(0.0)


def fit_default(clauses: DataFrame, most: int = 200_000):
    """A logistic regression on at most ``most`` labelled clauses, taken by digest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    sample = clauses.orderBy(F.xxhash64("clause", "pos")).limit(most)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), LogisticRegression(labelCol="label", regParam=0.001, maxIter=50)]).fit(sample)


_WORD_GAP = re.compile(r"[ \t\n\x0b\f\r]+")
_PATH = re.compile(r"\w/\w", re.A)
_CODE = re.compile(r"`|\w_\w|[a-z][A-Z]", re.A)
_STATUS = re.compile(rf"(?<!\w)(?:{'|'.join(g.STATUS.values())})(?!\w)", re.I)
_NARRATION = re.compile(rf"(?<!\w)(?:{g.NARRATION})(?!\w)", re.I)


def feature_row(clause: str, pos: int, of: int) -> list[float]:
    """The values of ``clause_features`` for a clause that is already in Python."""
    n = max(1, len(clause))
    upper = sum(c.isupper() and unicodedata.category(c) == "Lu" for c in clause)
    return [
        math.log1p(len(clause)), math.log1p(len(_WORD_GAP.split(clause))), sum("0" <= c <= "9" for c in clause) / n, upper / n, float(_PATH.search(clause) is not None), float(_CODE.search(clause) is not None),
        float(_STATUS.search(clause) is not None), float(_NARRATION.search(clause) is not None), float("?" in clause), pos / max(1, of),
    ]


def default_score(clauses: DataFrame) -> Callable[[list[str]], list[float]]:
    """The keep probabilities of a document's clauses under ``fit_default`` on labelled clauses; a few numbers go to the workers."""
    fitted = fit_default(clauses).stages[-1]
    weights, bias = np.array(fitted.coefficients.toArray()), float(fitted.intercept)

    def score(texts: list[str]) -> list[float]:
        x = np.array([feature_row(t, k, len(texts)) for k, t in enumerate(texts)])
        return sigmoid(x @ weights + bias).tolist()

    return score


def hashed_units(texts: list[str], vocab: int = 8000, most: int = 256) -> list[list[int]]:
    """Token ids without a vocabulary file: hashed words between begin and end marks."""
    return [[1, *(4 + int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % (vocab - 4) for t in x.split()), 2][:most] for x in texts]
