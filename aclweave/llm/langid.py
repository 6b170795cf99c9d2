"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased, each run of characters that aren't letters becomes one space. Every language gets a character model
of order 5. For each order one sorted array holds the hashes of the n-grams that any language has seen, beside it a row
with each language's interpolated log probability; a second pair of arrays has the contexts' back-off weights. A text's
cross-entropy a character is thus exact for every language after one look-up for most characters.

The language with the lowest cross-entropy is predicted. Labelled rows kept out of the models calibrate two things: a
temperature, by which cross-entropies become the score (a posterior), and each language's limit: mean plus eight deviations
of a text of that length. A text beyond it is ``rejected``: its characters follow no learnt language.

Bound: models are fitted on about ``SAMPLE`` labelled rows of each language (whole texts, chosen by a hash over all rows).

Defined results: a null text or one without letters is ``und`` with score 0, rejected; so is all text if nothing could be
learnt; ties go to the first language by name; repeated rows are predicted as often as they occur; null langs teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import arrow_pass, is_held_out, saved, table, with_fields

ORDER, SAMPLE, DEVIATIONS = 5, 1500, 8.0
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
#: Characters whose n-grams are counted at once.
COUNTED = 500_000


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


def codes_of(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' codes one after another, each after ORDER - 1 spaces, and where each starts (with the end of all)."""
    parts, starts, at = [], [], 0
    pad = np.full(ORDER - 1, _SPACE, np.uint32)
    for t in texts:
        c = np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)
        c = np.where(letters[c], c, np.uint32(_SPACE))
        keep = np.ones(len(c), bool)
        if len(c):
            keep[0] = c[0] != _SPACE
            keep[1:] = (c[1:] != _SPACE) | (c[:-1] != _SPACE)
        parts += [pad, c[keep]]
        starts.append(at)
        at += len(pad) + len(parts[-1])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array([*starts, at])


def gram_hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order k from 1, the hash of the k-gram that ends at each place (the first k - 1 places are void)."""
    with np.errstate(over="ignore"):
        one = codes.astype(np.uint64) * _PRIME + np.uint64(1)
        one ^= one >> np.uint64(29)
    own = one
    for k in range(ORDER):
        if k:
            with np.errstate(over="ignore"):
                own = one + np.concatenate((np.zeros(1, np.uint64), own[:-1])) * np.uint64(0xD6E8FEB86659FD93)
        yield own


def _counts(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """Of each order: n-grams, their suffixes, their contexts, and Kneser-Ney counts (of places, below the top of distinct left neighbours)."""
    letters, kept, n, at = letter_table(), np.zeros((2 * ORDER - 1, 0), np.uint64), np.zeros(0), 0
    while at < len(texts):  # some texts at a time; what is held are the distinct n-grams
        end, chars = at + 1, len(texts[at])
        while end < len(texts) and chars + len(texts[end]) < COUNTED:
            chars, end = chars + len(texts[end]), end + 1
        codes, starts = codes_of(texts[at:end], letters)
        real = np.ones(len(codes), bool)
        for k in range(ORDER - 1):
            real[starts[:-1] + k] = False
        places, hashes = np.flatnonzero(real), list(gram_hashes(codes))[::-1]
        _, first, times = np.unique(hashes[0][places], return_index=True, return_counts=True)
        where = places[first]
        # of each n-gram of the top order: its own hash and its suffixes', then those of the n-grams before its last character
        both = np.concatenate((kept, np.stack([h[where] for h in hashes] + [h[where - 1] for h in hashes[1:]])), axis=1)
        _, first, inverse = np.unique(both[0], return_index=True, return_inverse=True)
        kept, n, at = both[:, first], np.bincount(inverse, np.concatenate((n, times))), end
    out = []
    for j in range(ORDER):  # each distinct longer n-gram gives its suffix one count
        if j:
            _, first, n = np.unique(kept[j], return_index=True, return_counts=True)
            kept = kept[:, first]
        none = np.zeros(kept.shape[1], np.uint64)
        out.append((kept[j], none, none, n) if j == ORDER - 1 else (kept[j], kept[j + 1], kept[ORDER + j], n))
    return out[::-1]


class Models:
    """The languages' models side by side."""

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, ...]]]):
        self.langs = sorted(counts)
        size = len(self.langs)
        self.grams, self.contexts = [], []
        vocabulary = 1 + len(np.unique(np.concatenate([c[0][0] for c in counts.values()]))) if counts else 1
        p_lower, g_lower = None, None
        for k in range(ORDER if counts else 0):
            per = [counts[x][k] for x in self.langs]
            grams, first = np.unique(np.concatenate([p[0] for p in per]), return_index=True)
            suffix, context = (np.concatenate([p[j] for p in per])[first] for j in (1, 2))
            contexts, inverse = np.unique(context, return_inverse=True)
            prob, gamma = np.zeros((len(grams), size)), np.ones((len(contexts), size))
            lower = np.full((len(grams), size), 1 / vocabulary) if k == 0 else p_lower[np.searchsorted(g_lower, suffix)]
            for j, (g, _, _, n) in enumerate(per):
                c = np.zeros(len(grams))
                c[np.searchsorted(grams, g)] = n
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
                total = np.bincount(inverse, c, len(contexts))
                kinds = np.bincount(inverse, c > 0, len(contexts))
                seen = total > 0
                gamma[seen, j] = d * kinds[seen] / total[seen]
                prob[:, j] = np.maximum(c - d, 0) / np.where(seen, total, 1)[inverse] + gamma[inverse, j] * lower[:, j]
            p_lower, g_lower = prob, grams
            self.grams.append((grams, np.log(prob).astype(np.float32)))
            self.contexts.append((contexts, np.log(gamma).astype(np.float32)))
        self.floor = np.float32(-np.log(vocabulary))
        self.temperature, self.limits = 0.1, {}

    @classmethod
    def of(cls, parts: dict) -> Models:
        """From another instance's parts, as they are sent to tasks."""
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def cross_entropy(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text its cross-entropy a character by each language (0 without letters), and the number of characters."""
        codes, starts = codes_of(texts, letters)
        hashes = list(gram_hashes(codes))
        sums = np.zeros((len(codes), len(self.langs)), np.float32)
        left = np.arange(ORDER - 1, len(codes))
        for k in range(ORDER, 0, -1):
            grams, logs = self.grams[k - 1]
            h = hashes[k - 1][left]
            at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            hit = grams[at] == h
            sums[left[hit]] += logs[at[hit]]
            left = left[~hit]
            contexts, gammas = self.contexts[k - 1]
            h = hashes[k - 2][left - 1] if k > 1 else np.zeros(len(left), np.uint64)
            at = np.minimum(np.searchsorted(contexts, h), len(contexts) - 1)
            hit = contexts[at] == h
            sums[left[hit]] += gammas[at[hit]]
        sums[left] += self.floor
        for k in range(ORDER - 1):
            sums[starts[:-1] + k] = 0
        n = np.diff(starts) - (ORDER - 1)
        total = np.add.reduceat(sums, starts[:-1], axis=0, dtype=np.float64) if len(texts) else np.zeros((0, len(self.langs)))
        return -total / np.maximum(n, 1)[:, None], n

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, truth: list[str]) -> None:
        want = np.array([self.langs.index(x) for x in truth], int)
        rows = np.arange(len(want))

        def loss(t: float) -> float:
            z = -entropy / t
            z -= z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[rows, want]).mean())

        if len(want):
            self.temperature = min((0.01 * 1.5**i for i in range(14)), key=loss)
        right = entropy.argmin(axis=1) == want if len(want) else np.zeros(0, bool)
        low = entropy.min(axis=1) if len(want) else np.zeros(0)

        def limit(use: np.ndarray) -> tuple[float, float, float]:
            own, m = low[use], n[use]
            mean = float(np.average(own, weights=m))
            a = np.stack([np.ones(len(own)), 1 / m], axis=1)
            spread, _, _, _ = np.linalg.lstsq(a, (own - mean) ** 2, rcond=None)
            return mean, max(float(spread[0]), 1e-3), max(float(spread[1]), 1.0)

        pooled = limit(right) if right.sum() >= 5 else None
        for j, lang in enumerate(self.langs):
            use = right & (want == j)
            own = limit(use) if use.sum() >= 5 else pooled  # a language of few rows is held to all languages' limit
            if own:
                self.limits[lang] = own

    def judge(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Predictions, scores, cross-entropies, rejections."""
        entropy, n = self.cross_entropy([t or "" for t in texts], letters) if self.langs else (np.zeros((len(texts), 1)), np.zeros(len(texts)))
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-(entropy - low[:, None]) / self.temperature).sum(axis=1)
        mean, flat, per = (np.array([self.limits.get(x, (1e9, 0, 0))[i] for x in self.langs] or [0.0])[best] for i in range(3))
        m = np.maximum(n, 1)
        rejected = (n == 0) | (low > mean + DEVIATIONS * np.sqrt(flat + per / m))
        score[n == 0] = 0
        return [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], score, low, rejected


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Models:
    """Models from rows with doc_id, text and lang; every fifth of the chosen rows only calibrates."""
    rows = labelled.select("doc_id", "text", "lang").dropna(subset=["text", "lang"])
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Models({})
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in sizes], "lang string, _share double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # rows that repeat id and text are one to learn from
    chosen = rows.join(F.broadcast(shares), "lang").withColumn("_place", place / F.col("_share")).filter("_place < 1").dropDuplicates(["lang", "_place"])
    # ranked within the language (about `sample` rows): four of five teach, and at least one does
    whole, ranked = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("_place")
    chosen = chosen.withColumn("_teaches", F.row_number().over(ranked) <= F.ceil(0.8 * F.count("*").over(whole)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["_teaches"]]
        out = _counts(list(own["text"]))
        return pd.DataFrame([{"lang": pdf["lang"].iloc[0], "k": k, **dict(zip("abcd", (x.astype("<u8").tobytes() for x in got), strict=True))} for k, got in enumerate(out)])

    chosen = saved(chosen.select("lang", "text", "_teaches"), "sample")
    counts: dict = {}
    for r in chosen.groupBy("lang").applyInPandas(count, "lang string, k int, a binary, b binary, c binary, d binary").collect():
        counts.setdefault(r["lang"], [None] * ORDER)[r["k"]] = tuple(np.frombuffer(r[x], "<u8") for x in "abcd")
    counts = {x: v for x, v in counts.items() if all(len(g[0]) for g in v)}
    models = Models(counts)
    if not counts:
        return models
    handle = spark.sparkContext.broadcast(vars(models))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, models = letter_table(), Models.of(handle.value)
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                some = pdf.iloc[i : i + 64]
                e, n = models.cross_entropy(list(some["text"]), letters)
                yield pd.DataFrame({"lang": some["lang"].values, "n": n, "e": list(e)})

    held = chosen.filter("NOT _teaches").filter(F.col("lang").isin(models.langs))
    got = [r for r in held.mapInPandas(measure, "lang string, n bigint, e array<double>").collect() if r["n"] > 0]
    if got:
        models.calibrate(np.array([r["e"] for r in got]), np.array([r["n"] for r in got]), [r["lang"] for r in got])
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected (columns of these names are replaced)."""
    handle = docs.sparkSession.sparkContext.broadcast(vars(models))
    base = docs.drop("lang_pred", "score", "cross_entropy", "rejected")

    def make():
        letters, models = letter_table(), Models.of(handle.value)

        def run(cols: dict) -> dict:
            lang, score, entropy, rejected = models.judge(cols["text"], letters)
            return cols | {"lang_pred": lang, "score": score, "cross_entropy": entropy, "rejected": rejected}

        return run

    return arrow_pass(base, make, with_fields(base.schema, "lang_pred string, score double, cross_entropy double, rejected boolean"), rows=64, size=1_000_000)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = fit(docs.filter(~is_held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
