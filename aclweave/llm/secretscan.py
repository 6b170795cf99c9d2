"""Secrets: base patterns, and a battery of randomness tests over code-like words with false-discovery control.

Candidates are all runs of ``[A-Za-z0-9+/_=-]`` of 16 characters or more, whatever their shape. Each is read in the narrowest encoding that holds
it (digits, hex, base 32, letters of one case, letters, alphanumeric, base 64; once more without its signs, as keys come in
groups), and three tests ask whether it could be drawn evenly from that alphabet: chi-squared over the alphabet and over
groups of it, runs above and below the alphabet's middle, and serial correlation of neighbours. Their z values are combined
by Stouffer's rule. A candidate that an even draw would hardly give (``EVEN``) isn't random.

How people write is counted over the whole corpus as pairs of neighbouring letters and digits, from words and numbers of
fewer than 16 characters, so no candidate is part of its own null. The test statistic is a candidate's log likelihood ratio
of an even draw to writing, letters and digits each within their own kind (so a number is held to numbers), less the mean of
writing, over the deviation of writing of as many letters: both follow from the fitted cost of a character and the length,
so power grows with length and no length needs words of its own. The null distribution of that is counted over the
corpus's text, cut without spaces into pieces of all lengths, and its tail extrapolated from ``TAIL``, below the few pieces
that are junk. The threshold is Benjamini and Hochberg's over all candidates.

Defined results: a null text is empty and has no spans; an empty table gives no rows; repeated rows are found each; spans of
the base patterns stay; added spans that overlap one are left out.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Cover, arrow_pass, saved, table

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = re.compile(r"(?ai:passw|secret|token|api)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_CODE = re.compile("[A-Za-z0-9+/_=-]{16,}")
#: Encodings from narrow to wide, with their alphabets in order.
_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [("digits", _DIG), ("hex", _DIG + "abcdef"), ("HEX", _DIG + "ABCDEF"), ("lower", _LOW), ("upper", _UP), ("base32", _UP + "234567"), ("lower36", _DIG + _LOW), ("upper36", _DIG + _UP), ("letters", _UP + _LOW), ("alphanumeric", _UP + _LOW + _DIG), ("base64", _UP + _LOW + _DIG + "+/-_=")]
_TABLES = [(name, {c: i for i, c in enumerate(a)}, len(a)) for name, a in ENCODINGS]
#: Letters that are common in writing in most Latin alphabets, then the rest, digits, signs.
_COMMON = "etaoinshrdlu"
_GROUP = {c: (0 if c.lower() in _COMMON else 1) + 2 * c.isupper() for c in _LOW + _UP} | {c: 4 for c in _DIG}
_EXPECTED = {name: [sum(_GROUP.get(c, 5) == i for c in a) / len(a) for i in range(6)] for name, a in ENCODINGS}
_RUN = re.compile("[A-Za-z0-9+/_=-]+")
_UNSIGNED = str.maketrans("", "", "+/_=-")
BANDS = (16, 20, 24, 32, 40, 64)
BINS, RATE = 400, 0.05
#: What one even draw in a few thousand falls below, in deviations; shares of the null from which its tail is fitted.
EVEN, TAIL = -4.0, (0.1, 0.025)
#: Pairs of characters that writing is taken to have seen before any is counted; share of pairs in writing that follow no rule.
PRIOR, LOOSE = 200.0, 0.02
_FREQUENCY = dict(zip(_LOW, (8, 1.5, 3, 4, 12.5, 2, 2, 5.5, 7.3, 0.3, 0.8, 4, 2.5, 7, 7.5, 2, 0.2, 6, 6.5, 9, 3, 1, 2, 0.2, 1.7, 0.2), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = []
    if _NAMES.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def band(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def evenness(word: str) -> float:
    """Stouffer's z of the three tests: about 0 or above for an even draw, far below for writing."""
    word = word.rstrip("=") or word
    chars = set(word)
    name, place, size = next((t for t in _TABLES if chars <= t[1].keys()), _TABLES[-1])
    codes, n = [place.get(c, 0) for c in word], len(word)
    # chi-squared over the alphabet, by Wilson and Hilferty's cube root as a z value; excess repetition is negative
    seen: dict[int, int] = {}
    for c in codes:
        seen[c] = seen.get(c, 0) + 1
    chi, df = sum(v * v for v in seen.values()) * size / n - n, size - 1
    z1 = _cube_root(chi, df)
    # the same over groups (case, digits, letters common in writing or not), which short words fill too
    groups, expected = [0] * 6, _EXPECTED[name]
    for c in word:
        groups[_GROUP.get(c, 5)] += 1
    used = [i for i in range(6) if expected[i]]
    if len(used) > 1:
        chi = sum((groups[i] - n * expected[i]) ** 2 / (n * expected[i]) for i in used)
        z1 = (z1 + 2 * _cube_root(chi, len(used) - 1)) / math.sqrt(5)
    # runs above and below the middle: letters apart from digits where the alphabet has both
    mid = size / 2
    up = [c >= mid for c in codes]
    a = sum(up)
    b = n - a
    if a and b:
        runs, mean = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False)), 1 + 2 * a * b / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        z2 = -abs(runs - mean) / math.sqrt(var) + 0.8
    else:
        z2 = -math.sqrt(n)
    # serial correlation of neighbouring codes
    m = sum(codes) / n
    var = sum((c - m) ** 2 for c in codes)
    r = sum((x - m) * (y - m) for x, y in zip(codes, codes[1:], strict=False)) / var if var else 1.0
    z3 = -abs(r + 1 / n) * math.sqrt(n) + 0.8
    return (z1 + z2 + z3) / math.sqrt(3)


def _cube_root(chi: float, df: int) -> float:
    return -(((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def _bin(z: float) -> int:
    return min(BINS - 1, max(0, int((z + 8) * BINS / 40)))


class Writing:
    """How likely neighbouring letters and digits are in writing, against an even draw, in nats.

    ``counts`` are of pairs: 26 x 26 letters without case, then 10 x 10 digits.
    """

    def __init__(self, counts: np.ndarray):
        prior = np.array([_FREQUENCY[c] for c in _LOW]) / sum(_FREQUENCY.values())
        self.scores, self.cost, self.even = {}, {}, {}
        for kind, pairs, first in (("a", counts[:676].reshape(26, 26), prior), ("d", counts[676:].reshape(10, 10), np.full(10, 0.1))):
            n, size = pairs.astype(np.float64), len(first)
            single = (n.sum(axis=0) + PRIOR * first) / (n.sum() + PRIOR)
            p = (n + PRIOR * single) / (n.sum(axis=1, keepdims=True) + PRIOR)
            p = (1 - LOOSE) * np.vstack([p, single]) + LOOSE / size  # the last row is for what stands after another kind
            own = self.scores[kind] = -np.log(p * size)
            # mean and variance in writing and in an even draw, of a character after its own kind and of one after another
            self.cost[kind] = _moments(own[:-1], single[:, None] * p[:-1]), _moments(own[-1:], p[-1:])
            self.even[kind] = _moments(own[:-1], np.ones((size, size))), _moments(own[-1:], np.ones((1, size)))
        self.even["hex"] = _moments(self.scores["a"][:6, :6], np.ones((6, 6))), _moments(self.scores["a"][-1:, :6], np.ones((1, 6)))
        self.rows = {k: v.tolist() for k, v in self.scores.items()}

    def measure(self, word: str) -> tuple[float, bool]:
        """The statistic of a word, and whether an even draw could have it."""
        letters, digits = self.rows["a"], self.rows["d"]
        total, last, before = 0.0, 26, 10
        m, k = [0, 0], [0, 0]  # letters and digits, after their own kind and after another
        for c in word:
            x = _CODES.get(c, -1)
            if x >= 26:
                total += digits[before][x - 26]
                k[before == 10] += 1
                last, before = 26, x - 26
            elif x >= 0:
                total += letters[last][x]
                m[last == 26] += 1
                last, before = x, 10
            else:
                last, before = 26, 10
        hexes = not word.translate(_HEXES) or not word.translate(_UPPER_HEXES)

        def moments(of: dict, name: str) -> tuple[float, float]:
            parts = [*zip(m, of[name], strict=True), *zip(k, of["d"], strict=True)]
            return sum(n * x[0] for n, x in parts), 1 + sum(n * x[1] for n, x in parts)

        mean, var = moments(self.cost, "a")
        even, spread = moments(self.even, "hex" if hexes else "a")
        # drawn from six letters each is likelier than from 26; writing stays what it is
        narrow = sum(m) * math.log(26 / 6) if hexes else 0.0
        return (total + narrow - mean) / math.sqrt(var), total >= even + EVEN * math.sqrt(spread)

    def bin(self, word: str) -> int:
        z, even = self.measure(word)
        if z <= 0 or not even:
            return min(_bin(z), _bin(0.0))
        if evenness(word) < EVEN and evenness(word.translate(_UNSIGNED)) < EVEN:
            return _bin(0.0)
        return _bin(z)

    def pieces(self, letters: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Bands and bins of writing without spaces (as codes), cut into pieces of each band's length in turn."""
        sizes = np.resize(np.roll(BANDS, at), 1 + len(letters) // min(BANDS))
        ends = np.cumsum(sizes)
        sizes = sizes[ends <= len(letters)]
        if not len(sizes):
            return np.zeros(0, int), np.zeros(0, int)
        starts = np.cumsum(sizes) - sizes
        scores = self.scores["a"][np.concatenate(([26], letters[:-1])), letters]
        mean, var = self.cost["a"][0]
        z = (np.add.reduceat(scores[: starts[-1] + sizes[-1]], starts) - sizes * mean) / np.sqrt(sizes * var + 1)
        return np.searchsorted(BANDS, sizes), ((z + 8) * BINS / 40).astype(int).clip(0, BINS - 1)


def _moments(scores: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    weight = weight / weight.sum()
    mean = float((scores * weight).sum())
    return mean, float(((scores - mean) ** 2 * weight).sum())


_CODES = {c: i % 26 for i, c in enumerate(_LOW + _UP)} | {c: 26 + i for i, c in enumerate(_DIG)}
_HEXES, _UPPER_HEXES = (str.maketrans("", "", _DIG + x + "+/_=-") for x in ("abcdef", "ABCDEF"))


def written(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letters and the digits of a text's words and numbers of fewer than 16 characters, as codes."""
    short = [w for w in _RUN.findall(text) if len(w) < 16]
    letters = "".join(filter(str.isalpha, short)).lower().encode()
    digits = "".join(filter(str.isdigit, short)).encode()
    return np.frombuffer(letters, np.uint8).astype(np.int64) - 97, np.frombuffer(digits, np.uint8).astype(np.int64) - 48


def fit(docs: DataFrame) -> Writing:
    """Pairs of neighbouring characters in the writing of all texts."""

    def make():
        def run(cols: dict) -> dict:
            total = np.zeros(776, np.int64)
            for t in cols["text"]:
                a, d = written(t or "")
                total[:676] += np.bincount(a[:-1] * 26 + a[1:], minlength=676)
                total[676:] += np.bincount(d[:-1] * 10 + d[1:], minlength=100)
            at = np.flatnonzero(total)
            return {"pair": at, "n": total[at]}

        return run

    counts = np.zeros(776, np.int64)
    for r in arrow_pass(docs.select("text"), make, "pair int, n bigint", rows=2048).groupBy("pair").agg(F.sum("n")).collect():  # 776 rows at most
        counts[r[0]] = r[1]
    return Writing(counts)


def found_in(text: str, writing: Writing) -> tuple[list, list]:
    """Base spans; candidates (start, end, band, bin)."""
    base = base_spans(text)
    cover = Cover((s, e) for s, _, e in base)
    free = (m for m in _CODE.finditer(text) if not cover.touches(m.start(), m.end()))
    return base, [(m.start(), m.end(), band(m.end() - m.start()), writing.bin(m.group())) for m in free]


def thresholds(null: dict[int, int], cands: dict[int, int], rate: float = RATE) -> dict[int, int]:
    """The lowest bin of each band that counts as found, from the counts of writing and of candidates by band and bin.

    Up to ``TAIL`` a p value is the share of writing at least as far off; beyond it falls exponentially, by a rate fitted
    between both shares of ``TAIL``. The statistic is held to the length already, so all bands have one null; a few
    pieces of a wide tail are added to it, which count only where there is hardly any writing.
    """
    counts = np.zeros(BINS)
    for k, n in null.items():
        counts[k % BINS] += n
    unit = BINS / 40
    wide = np.arange(1, BINS + 1) * (np.arange(BINS) >= _bin(0.0))
    counts += 20 * np.where(wide, np.exp(-(np.arange(BINS) - _bin(0.0)) / unit), 0) * (1 - math.exp(-1 / unit))
    above = counts[::-1].cumsum()[::-1] / counts.sum()
    near, far = (int(np.flatnonzero(above > share)[-1]) for share in TAIL)
    fall = max(far - near, 0.2 * unit) / math.log(TAIL[0] / TAIL[1])
    tail = TAIL[0] * np.exp(-(np.arange(BINS) - near) / fall)
    shared = np.where(np.arange(BINS) > near, tail, above)
    p = {b * BINS + i: float(shared[i]) for b in range(len(BANDS)) for i in range(BINS)}
    tests = sum(cands.values())
    ranked, k, cut = sorted(cands, key=p.__getitem__), 0, -1.0
    for c in ranked:
        k += cands[c]
        if p[c] <= rate * k / tests:
            cut = p[c]
    return {b: min((i for i in range(BINS) if p[b * BINS + i] <= cut), default=BINS) for b in range(len(BANDS))}


def _lowest(found: DataFrame) -> dict[int, int]:
    null = {r[0]: r[1] for r in found.select(F.explode("null").alias("x")).groupBy("x.cell").agg(F.sum("x.n")).collect()}  # at most bands x bins rows
    cands = {r[0]: r[1] for r in found.select(F.explode("cands").alias("x")).groupBy("x.cell").count().collect()}
    return thresholds(null, cands)


def _found(docs: DataFrame, writing: Writing) -> DataFrame:
    """Base spans, candidates and counts of pieces of writing of every text, stored."""

    def make():
        def run(cols: dict) -> dict:
            out = [found_in(t or "", writing) for t in cols["text"]]
            null = np.zeros(len(BANDS) * BINS, np.int64)
            for k, t in enumerate(cols["text"]):
                bands, bins = writing.pieces(written(t or "")[0], k % len(BANDS))
                null += np.bincount(bands * BINS + bins, minlength=len(null))
            rest = [None] * (len(out) - 1)
            counts = [(k, null[k]) for k in np.flatnonzero(null).tolist()]
            return {
                "doc_id": cols["doc_id"],
                "base": [[{"kind": k, "start": s, "end": e} for s, k, e in b] for b, _ in out],
                "cands": [[{"start": s, "end": e, "cell": b * BINS + z} for s, e, b, z in c] for _, c in out],
                "null": [[{"cell": k, "n": n} for k, n in counts], *rest],
            }

        return run

    spans = "array<struct<start:int,end:int,{}>>"
    schema = f"doc_id bigint, base {spans.format('kind:int')}, cands {spans.format('cell:int')}, null array<struct<cell:int,n:bigint>>"
    return saved(arrow_pass(docs.select("doc_id", "text"), make, schema, rows=256), "found")


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every row of docs, found over whole texts: ``base`` and ``all`` (arrays of start, end, kind)."""
    found = _found(docs, fit(docs))
    low = _lowest(found)
    lowest = F.array(*[F.lit(low[b]) for b in range(len(BANDS))])
    kept = F.filter("cands", lambda x: x["cell"] % BINS >= F.element_at(lowest, F.floor(x["cell"] / BINS).cast("int") + 1))
    added = F.transform(kept, lambda x: F.struct(x["start"], x["end"], F.lit(3).alias("kind")))
    return found.select("doc_id", "base", F.concat("base", added).alias("all"))


def spans_text(base: list, names: tuple[str, ...], by_kind: bool) -> str:
    key = (lambda x: (x["kind"], x["start"], x["end"])) if by_kind else (lambda x: (x["start"], x["kind"], x["end"]))
    return ",".join(f"{names[x['kind']]}:{x['start']}:{x['end']}" for x in sorted(base, key=key))


def digest(found: DataFrame, names: tuple[str, ...], n_base: int, by_kind: bool) -> DataFrame:
    """Counts of each base kind, the base spans' checksum and all spans as text."""

    def make():
        def run(cols: dict) -> dict:
            out = {"doc_id": cols["doc_id"]}
            for k in range(n_base):
                out[f"n_{names[k]}"] = [sum(x["kind"] == k for x in b) for b in cols["base"]]
            out["base_sha256"] = [hashlib.sha256(spans_text(b, names, by_kind).encode()).hexdigest() for b in cols["base"]]
            out["spans"] = [spans_text(b, names, by_kind) for b in cols["all"]]
            return out

        return run

    counts = ", ".join(f"n_{names[k]} bigint" for k in range(n_base))
    return arrow_pass(found.select("doc_id", "base", "all"), make, f"doc_id bigint, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by ``mark`` (and n_chars counted anew, where there is such a column)."""
    writing = fit(docs)
    low = _lowest(_found(docs, writing))

    def clean(text: str | None) -> str | None:
        base, cands = found_in(text or "", writing)
        spans = sorted([(s, -e) for s, _, e in base] + [(s, -e) for s, e, b, z in cands if z >= low[b]])
        parts, at = [], 0
        for s, e in spans:
            if s >= at:
                parts += [text[at:s], mark]
            at = max(at, -e)
        return "".join([*parts, text[at:]]) if spans else text

    def make():
        def run(cols: dict) -> dict:
            texts = [clean(t) for t in cols["text"]]
            out = cols | {"text": texts}
            if "n_chars" in out:
                out["n_chars"] = [n if t is u else len(u) for n, t, u in zip(out["n_chars"], cols["text"], texts, strict=True)]
            return out

        return run

    return arrow_pass(docs, make, docs.schema, rows=256)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")), KINDS, 3, by_kind=False)
