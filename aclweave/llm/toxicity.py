"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and character 4-grams of words (present or not, whole texts) is trained with numpy from confirmed toxic texts and
unlabelled ones. The risk estimator corrects for the class prior: with positives P, unlabelled U and prior pi, the loss is
pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)), and where the second term turns negative the step goes against it (Kiryo et al.,
2017). Features enter where they lean to toxic texts by more than chance, against the count that the unlabelled texts lead
one to expect; without that screen the few positives are learnt by heart through topics. The prior is the share of toxic texts among the rows that carry a label. A threshold shift, fitted on rows kept out
of training, maps the best cut by F1 to a score of 0.3.

Bound: the classifier is fitted on at most about ``POSITIVES`` toxic and ``UNLABELLED`` other training rows, chosen by a hash
over all of them; scoring covers every text.

Defined results: a null or empty text is scored by the intercept alone; without positives every score is 0; repeated labels
of one document count as toxic if any is; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow_pass, is_held_out, saved, table, with_fields

BUCKETS, POSITIVES, UNLABELLED, CUT = 1 << 18, 6000, 18000, 0.3
_WORD = re.compile(rb"[a-z\x80-\xff']+")


class Hasher:
    """Distinct hashed features of a text, with a bounded memo of words: character 4-grams in the lower half, words above."""

    def __init__(self, limit: int = 200_000):
        self.memo, self.limit = {}, limit

    def _features(self, word: bytes) -> bytes:
        padded, half = b"^" + word + b"$", BUCKETS // 2
        grams = [zlib.crc32(padded[i : i + 4]) % half for i in range(max(1, len(padded) - 3))] if len(word) <= 64 else []
        return np.array([half + zlib.crc32(word) % half, *grams], "<i4").tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        words = set(_WORD.findall(text.lower().encode("utf-8", "replace")))
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = self._features(w)
        mark = np.zeros(BUCKETS, bool) if len(words) > 20_000 else None
        found = np.frombuffer(b"".join([memo[w] for w in words]), "<i4")
        if mark is None:
            return np.unique(found).astype(np.int64)
        mark[found] = True
        return np.flatnonzero(mark)


def _gradient(rows: list[np.ndarray], w: np.ndarray, b: float, sign: int) -> tuple[float, np.ndarray, float]:
    """Mean logistic loss of label ``sign`` over rows, with its gradient."""
    n, sizes = len(rows), np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(n), sizes)
    z = np.bincount(of, w[flat], n) + b
    m = np.clip(sign * z, -30, 30)
    slope = -sign / (1 + np.exp(m)) / n
    return float(np.log1p(np.exp(-m)).mean()), np.bincount(flat, slope[of], BUCKETS), float(slope.sum())


def _frequencies(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each feature stands, a few rows at a time."""
    out = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(rows), 512):
        out += np.bincount(np.concatenate(rows[i : i + 512]), minlength=BUCKETS)
    return out


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 1200, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept by mini-batches of Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    m, v, mb, vb, t = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 0
    in_p, in_u = _frequencies(positive), _frequencies(unlabelled)
    # a feature of toxic texts alone is 1 / prior times as frequent in them as in unlabelled ones; the rest is topic, and
    # what few texts have is chance: it would only be learnt by heart
    expected = len(positive) * (in_u + 1) / len(unlabelled)
    seen = (in_p >= 0.3 / prior * expected) & (in_p - expected >= 4.5 * np.sqrt(expected + 1))
    positive, unlabelled = ([r[seen[r]] for r in rows] for rows in (positive, unlabelled))
    batches = max(8, len(unlabelled) // 512)
    epochs = -(-steps // batches)
    for epoch in range(epochs):
        # every mini-batch has some positives, however few there are
        order = np.concatenate([rng.permutation(len(positive)) for _ in range(-(-8 * batches // len(positive)) if len(positive) < 8 * batches else 1)])
        p_parts = np.array_split(order, batches)
        u_parts = np.array_split(rng.permutation(len(unlabelled)), batches)
        for pi, ui in zip(p_parts, u_parts, strict=True):
            if not len(pi) or not len(ui):
                continue
            pos, unl = [positive[i] for i in pi], [unlabelled[i] for i in ui]
            _, gp, bp = _gradient(pos, w, b, 1)
            lpn, gpn, bpn = _gradient(pos, w, b, -1)
            lun, gun, bun = _gradient(unl, w, b, -1)
            if lun - prior * lpn >= 0:
                g, gb = prior * gp + gun - prior * gpn, prior * bp + bun - prior * bpn
            else:
                g, gb = prior * gpn - gun, prior * bpn - bun
            g = g + 2e-6 * w
            t += 1
            rate = 0.05 * (1 - epoch / epochs) + 0.005
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
            b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return w.astype(np.float32), b


def best_shift(z: np.ndarray, y: np.ndarray) -> float:
    """What to add to log odds so that the cut with the best F1 falls on a score of CUT."""
    at = float(np.log(CUT / (1 - CUT)))
    if not y.any():
        return 0.0
    order = np.argsort(-z, kind="stable")
    ranked = z[order]
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(z) + 1) + y.sum())
    ends = np.flatnonzero(ranked[:-1] > ranked[1:])  # equal scores can't be cut apart, and a cut below all says nothing
    if not len(ends):
        return at - float(ranked[0]) - 1
    k = ends[f1[ends].argmax()]
    return at - float(ranked[k] + ranked[k + 1]) / 2


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float] | None:
    """Weights and intercept from rows that aren't held out, or None without toxic ones."""
    y = labels.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isNotNull())
    sizes = {r[0]: r[1] for r in y.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return None
    prior = toxic / (toxic + clean)
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / float(1 << 30)
    # labels are chosen before any text moves: at most about POSITIVES + UNLABELLED of them, whatever the input
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, positives / toxic))).otherwise(F.lit(min(1.0, unlabelled / max(1, clean))))
    labelled = saved(y.withColumn("place", place("doc_id") / share).filter("place < 1"), "labels")
    training = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    drawn = place("doc_id", "text") / min(1.0, unlabelled / max(1, docs.count()))

    def make():
        hashed = Hasher()

        def run(cols: dict) -> dict:
            return {"toxic": cols["toxic"], "place": cols["place"], "drawn": cols["drawn"], "words": [hashed(t).astype("<i4").tobytes() for t in cols["text"]]}

        return run

    # unlabelled texts are drawn from all, toxic ones among them in their natural share
    rows = training.join(F.broadcast(labelled), "doc_id", "left").withColumn("drawn", drawn < 1)
    chosen = rows.filter("drawn OR place IS NOT NULL").select("toxic", F.coalesce("place", F.lit(2.0)).alias("place"), "drawn", "text")
    # a row that is repeated very often is one text to learn from; hashed in all tasks at once, the few rows are then read back
    chosen = chosen.dropDuplicates(["toxic", "place", "drawn", "text"])
    got = saved(arrow_pass(chosen, make, "toxic int, place double, drawn boolean, words binary", rows=256), "features").toLocalIterator()
    pos, unl, held, truth = [], [], [], []
    for toxic_, at, free, words in sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=lambda r: (r[1], r[3])):
        words = np.frombuffer(words, "<i4")
        if toxic_ is not None and 0.8 <= at < 1:
            held.append(words)
            truth.append(toxic_ == 1)
            continue
        if toxic_ == 1:
            pos.append(words)
        if free:
            unl.append(words)
    if not pos or not unl:
        return None
    w, b = train(pos, unl, prior)
    z = np.array([w[x].sum() for x in held]) + b
    if any(truth):
        b += best_shift(z, np.array(truth))
    return w, b


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """docs with score and predicted (columns of these names are replaced)."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("score", "predicted")

    def make():
        hashed, model = Hasher(), handle.value

        def run(cols: dict) -> dict:
            if model is None:
                return cols | {"score": [0.0] * len(cols["text"]), "predicted": [0] * len(cols["text"])}
            z = np.array([float(model[0][hashed(t)].sum()) for t in cols["text"]]) + model[1]
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            return cols | {"score": p, "predicted": (p >= CUT).astype(np.int32)}

        return run

    return arrow_pass(base, make, with_fields(base.schema, "score double, predicted int"), rows=256)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
