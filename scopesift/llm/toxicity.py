"""Toxicity as severity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all ordered
thresholds t_1 < t_2 < ...; the thresholds are a first one and positive steps.
Features are counts (log1p) of words, lower-cased runs of letters, chosen for
standing in toxic labelled texts more often than chance allows. Expected severity
is the sum of P(grade >= k).

The labels know toxic or not; a toxic text's grade above that is how much of it
is made of the chosen words, cut at the median of the toxic training texts.
The model is fitted on at most ``sample`` labelled rows, drawn by hash; a
held-out quarter sets the score from which a text is called toxic.

Null and empty texts score as texts without any chosen word. Without both
kinds of label in the sample no text is called toxic.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import ship, table

_WORD = re.compile(r"[^\W\d_]+")


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ordinal:
    """Cumulative-link model: words, weights, thresholds and the severity from which a text is toxic."""

    def __init__(self, words: list[str], grades: int):
        self.words = {w: i for i, w in enumerate(words)}
        self.w, self.first, self.steps, self.cut = np.zeros(len(words)), 0.0, np.zeros(grades - 2), np.inf

    def features(self, counts: list[dict[str, int]]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.words)))
        for i, c in enumerate(counts):
            for w, n in c.items():
                if w in self.words:
                    x[i, self.words[w]] = np.log1p(n)
        return x

    def thresholds(self) -> np.ndarray:
        return self.first + np.append(0, np.cumsum(np.exp(self.steps)))

    def fit(self, x: np.ndarray, grade: np.ndarray, penalty: float = 1e-3, rate: float = 0.05, rounds: int = 600) -> "Ordinal":
        """Gradient steps (Adam) on the likelihood of the grades."""
        k, m, s = len(self.steps) + 1, None, None
        theta = np.concatenate([self.w, [1.0], np.zeros(k - 1)])
        for t in range(1, rounds + 1):
            w, first, steps = theta[: x.shape[1]], theta[x.shape[1]], theta[x.shape[1] + 1 :]
            cuts = first + np.append(0, np.cumsum(np.exp(steps)))
            p = np.concatenate([np.ones((len(x), 1)), sigmoid(x @ w[:, None] - cuts), np.zeros((len(x), 1))], 1)
            i = np.arange(len(x))
            hi, lo = p[i, grade], p[i, grade + 1]
            like = np.maximum(hi - lo, 1e-12)
            dh, dl = hi * (1 - hi) / like, lo * (1 - lo) / like  # of log likelihood by the two logits
            g_w = -x.T @ (dh - dl) / len(x) + penalty * w
            g_c = np.zeros(k + 2)
            np.add.at(g_c, grade, dh)
            np.add.at(g_c, grade + 1, -dl)
            g_c = g_c[1 : k + 1] / len(x)
            g_s = np.array([g_c[j + 1 :].sum() * np.exp(steps[j]) for j in range(k - 1)])
            g = np.concatenate([g_w, [g_c.sum()], g_s])
            m = 0.1 * g if m is None else 0.9 * m + 0.1 * g
            s = 0.001 * g**2 if s is None else 0.999 * s + 0.001 * g**2
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w, self.first, self.steps = theta[: x.shape[1]], float(theta[x.shape[1]]), theta[x.shape[1] + 1 :]
        return self

    def predict(self, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and the likeliest grade."""
        p = sigmoid(logit[:, None] - self.thresholds())
        each = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
        return p.sum(1), each.argmax(1)


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def choose_words(counts: list[Counter], toxic: np.ndarray, most: int, error: float = 0.01) -> list[str]:
    """Words that stand in toxic texts too often for chance: the bound on their binomial tail, over all words, is under ``error``."""
    with_, total = Counter(), Counter()
    for c, y in zip(counts, toxic):
        total.update(c.keys())
        if y:
            with_.update(c.keys())
    p, need, bound = toxic.mean(), np.log(max(1, len(total)) / error), {}
    for w, k in with_.items():
        q = k / total[w]
        if q > p:
            bound[w] = total[w] * (q * np.log(q / p) + ((1 - q) * np.log((1 - q) / (1 - p)) if q < 1 else 0))
    return [w for w, v in sorted(bound.items(), key=lambda x: (-x[1], x[0]))[:most] if v >= need]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = 6_000, words: int = 400) -> Ordinal | None:
    """Fitted on at most ``sample`` labelled rows."""
    some = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    drawn = some.orderBy(F.xxhash64("i"), "i", "y").limit(sample)
    rows = sorted((r.i, r.y, r.t or "") for r in docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "i").collect())[:sample]
    toxic = np.array([r[1] > 0 for r in rows], dtype=bool)
    if toxic.sum() < 4 or (~toxic).sum() < 4:
        return None
    counts = [word_counts(r[2]) for r in rows]
    held = np.arange(len(rows)) % 4 == 0
    fit = ~held if toxic[~held].sum() >= 3 else np.ones(len(rows), bool)
    chosen = choose_words([c for c, f in zip(counts, fit) if f], toxic[fit], words)
    if not chosen:
        return None
    model = Ordinal(chosen, 3)
    share = np.array([sum(c[w] for w in chosen) / max(1, sum(c.values())) for c in counts])
    grade = np.where(toxic, 1 + (share > np.median(share[toxic & fit])), 0).astype(int)
    x = model.features(counts)
    model.fit(x[fit], grade[fit])
    severity = model.predict(x @ model.w)[0]
    test = held if toxic[held].any() and (~toxic[held]).any() else np.ones(len(rows), bool)
    # the cut with the best F1 on held-out rows, in the middle of its gap
    order = np.argsort(-severity[test], kind="stable")
    s, y = severity[test][order], toxic[test][order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    model.cut = float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])
    return model


def severity(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, expected_severity, grade, toxic."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            if model is None:
                logit, s, g = None, np.zeros(b.num_rows), np.zeros(b.num_rows, int)
            else:
                logit = np.zeros(b.num_rows)
                known = model.words.keys()
                for i, t in enumerate(b.column(1).to_pylist()):
                    if t:
                        found = Counter(w for w in _WORD.findall(t.lower()) if w in known)
                        # in one order, so that equal texts give equal sums
                        logit[i] = sum(model.w[model.words[w]] * np.log1p(found[w]) for w in sorted(found))
                s, g = model.predict(logit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(g, pa.int64()), pa.array(s >= model.cut if model is not None else np.zeros(b.num_rows, bool), pa.bool_())], names=[id_col, "expected_severity", "grade", "toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_severity double, grade long, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))
