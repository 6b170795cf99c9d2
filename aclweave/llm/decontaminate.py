"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

Passages are TF-IDF vectors; document frequencies are counted over all documents. A randomised SVD gives the latent basis:
tasks project passages by a Gaussian matrix and sum Y'Y and Y'X, whose sizes don't depend on the input, and the driver
finishes the small problem. The benchmark's own passages are part of the matrix, with as much weight as the corpus. The
basis is whitened and its first direction, shared by all, is left out.

Every document is then searched whole, in windows of several lengths that start at every eighth word: windows whose latent
cosine with a benchmark passage of about that length reaches ``COSINE`` are candidates. A candidate is a leak if the longest
common subsequence of the item's and the region's words covers ``ALIKE`` of the item, or, for paraphrases, ``LOOSE`` of it
and ``RARER`` of its rarer words (below a tenth of the documents; without such words, ``LOOSE`` of its idf), with the whole
answer kept in order (column ``answer``, else the item's last quarter).

Bounds: the basis is fitted on all documents; benchmark text of more than ``BLOCK_CHARS`` characters is searched in several
blocks, since each block's passages go to every task.

Defined results: null or empty texts and items match nothing; words differ neither by case nor by ASCII
punctuation; repeated items and rows are matched each; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow_pass, saved, slices, table

RANK, EXTRA, CELLS, PASSAGE, BLOCK_CHARS = 64, 8, 2048, 48, 4_000_000
COSINE, ALIKE, LOOSE, RARER = 0.5, 0.75, 0.6, 0.4
STEP, SCALES, LONGEST, SLOTS = 8, (3, 4, 6, 8), 56, 1 << 22
RESULT = "doc_id bigint, item_id bigint, common double, answer double"
_PUNCTUATION, _LOWER = string.punctuation.encode(), bytes(range(256)).lower()
_FACTORS = np.random.default_rng(3).integers(0, 1 << 64, 5, np.uint64) | np.uint64(1)


def _bare(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").translate(_LOWER, _PUNCTUATION) if text else b""


def bare_words(text: str | None) -> list[bytes]:
    """Words in lower case, without punctuation."""
    return _bare(text).split()


class Words:
    """Texts as word ids: 1.. for the benchmark's words, then cells for all others; 0 is no word."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.known = pa.array(list(vocabulary), pa.binary())
        self.ids = np.fromiter(vocabulary.values(), np.int32, len(vocabulary))
        self.size = len(vocabulary) + 1 + CELLS

    def __call__(self, text: str | None) -> np.ndarray:
        return self.all([text])[0]

    def all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word ids of all texts, one after the other, and how many each text has."""
        lists = pc.ascii_split_whitespace(pa.array([_bare(t) for t in texts], pa.binary()).view(pa.string()))
        words, edges = lists.values.view(pa.binary()), lists.offsets.to_numpy()
        at = pc.index_in(words, value_set=self.known)
        out = np.zeros(len(words), np.int32)
        here = at.is_valid().to_numpy(zero_copy_only=False)
        out[here] = self.ids[at.drop_null().to_numpy()]
        bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        sizes = np.diff(bounds)
        real = sizes > 0  # the split has an empty word before leading and after trailing blanks
        others = np.flatnonzero(real & ~here)
        if len(others):
            out[others] = self.size - CELLS + self._cells(np.frombuffer(words.buffers()[2], np.uint8), bounds[others], sizes[others])
        return out[real], np.diff(np.concatenate(([0], np.cumsum(real)))[edges])

    @staticmethod
    def _cells(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A hash of each word's length, first and last eight bytes."""
        data = np.concatenate((np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        beyond = (8 * (8 - np.minimum(sizes, 8))).astype(np.uint64)  # bits of the neighbours
        hashed = (eight[starts + 8] << beyond) * _FACTORS[0] ^ (eight[starts + sizes] >> beyond) * _FACTORS[1] ^ sizes.astype(np.uint64) * _FACTORS[2]
        hashed = (hashed ^ hashed >> np.uint64(32)) * _FACTORS[3]
        return ((hashed >> np.uint64(33)) % np.uint64(CELLS)).astype(np.int32)


def lcs(masks: dict[int, int], n: int, region: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors: masks has each word's places among the item's n."""
    full = v = (1 << n) - 1
    get = masks.get
    for w in region:
        m = get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _slots(words: np.ndarray, items: np.ndarray | int) -> np.ndarray:
    """A hash below ``SLOTS`` of each word and item."""
    return (np.asarray(words, np.uint64) * _FACTORS[3] + np.asarray(items, np.uint64) * _FACTORS[4]) >> np.uint64(64 - SLOTS.bit_length() + 1)


def _frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches):
        words = Words(vocabulary)
        counts = np.zeros(words.size, np.int64)
        for batch in (part for whole in batches for part in slices(whole, 512)):
            ids, sizes = words.all(batch.column(0).to_pylist())
            pairs = np.repeat(np.arange(len(sizes)), sizes) * words.size + ids
            pairs.sort()
            counts += np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % words.size, minlength=words.size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], schema=schema)

    out = np.zeros(len(vocabulary) + 1 + CELLS, np.int64)
    for r in docs.select("text").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n")).collect():  # one row a word id
        out[r[0]] = r[1]
    return out


def _added(rows: np.ndarray, grid: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds to each row of out the rows that its line of the grid names."""
    columns, room = np.ascontiguousarray(grid.T), np.empty((2048, rows.shape[1]), rows.dtype)
    for i in range(0, len(out), len(room)):
        to = out[i : i + len(room)]
        for column in columns:
            to += np.take(rows, column[i : i + len(room)], axis=0, out=room[: len(to)], mode="clip")
    return out


def _sums(rows: np.ndarray, at: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Sums of rows[at] over groups of the given sizes (1 at least), below a first row of zeros; rows[0] is zero too.

    Groups are summed ``width`` at a time, and these sums again, until one is left of each.
    """
    while True:
        parts = -(-sizes // width)
        grid = np.zeros(int(parts.sum()) * width, np.int64)
        grid[np.arange(len(at)) + np.repeat((np.cumsum(parts) - parts) * width - (np.cumsum(sizes) - sizes), sizes)] = at
        grid = grid.reshape(-1, width)
        out = np.zeros((len(grid) + 1, rows.shape[1]), rows.dtype)
        _added(rows, grid, out[1:])
        if parts.max(initial=1) == 1:
            return out
        rows, at, sizes = out, np.arange(1, len(out)), parts


def _sketch(ids: np.ndarray, sizes: np.ndarray, omega: np.ndarray, g: np.ndarray, x: np.ndarray) -> int:
    """Adds Y'Y and Y'A of the texts' passages (A: how often each has each word, Y: A by omega) to g and x; gives how many these are."""
    if not len(ids):
        return 0
    sizes = sizes[sizes > 0]
    parts = -(-sizes // PASSAGE)
    lengths = np.full(int(parts.sum()), PASSAGE)
    lengths[np.cumsum(parts) - 1] = sizes - (parts - 1) * PASSAGE
    ends = np.cumsum(lengths)
    for i in range(0, len(lengths), 4096):  # a very long text has many passages
        some = lengths[i : i + 4096]
        part = ids[ends[i] - lengths[i] : ends[i + len(some) - 1]]
        y = _sums(omega, part, some, PASSAGE)
        g += y.T @ y
        pairs = part.astype(np.int64) * len(y) + np.repeat(np.arange(1, len(y)), some)
        pairs.sort()
        word, own = np.divmod(pairs, len(y))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        x[word[first]] += _sums(y, own, np.diff(first, append=len(word)), 8)[1:]
    return len(lengths)


def _basis(docs: DataFrame, items: list[np.ndarray], vocabulary: dict[bytes, int], df: np.ndarray, n_docs: int, seed: int = 11) -> np.ndarray:
    """A row for each word id: its idf-weighted, whitened latent direction."""
    idf = np.log((n_docs + 1) / (df + 0.5)).clip(0.0)
    idf[0] = 0.0
    k = RANK + 1 + EXTRA
    omega = (np.random.default_rng(seed).standard_normal((len(idf), k)) * idf[:, None]).astype(np.float32)
    width = len(idf)
    handle = docs.sparkSession.sparkContext.broadcast((omega, idf))  # (benchmark words + CELLS) x k
    schema = pa.schema([("g", pa.binary()), ("x", pa.binary()), ("n", pa.int64())])

    def total(rows):
        g, x, n = np.zeros((k, k)), np.zeros((width, k)), 0
        for a, b, c in rows:
            g += a
            x += b
            n += c
        return g, x, n

    def row(g, x, n):
        return pa.RecordBatch.from_arrays([pa.array([g.astype("<f4").tobytes()]), pa.array([x.astype("<f4").tobytes()]), pa.array([n])], schema=schema)

    def project(batches):
        words, (omega, idf) = Words(vocabulary), handle.value

        g, x, n = np.zeros((k, k)), np.zeros((width, k)), 0
        for batch in (part for whole in batches for part in slices(whole, 256)):
            n += _sketch(*words.all(batch.column(0).to_pylist()), omega, g, x)
        if n:
            yield row(g, x * idf[:, None], n)

    def parse(r):
        return np.frombuffer(r[0], "<f4").reshape(k, k), np.frombuffer(r[1], "<f4").reshape(width, k), r[2]

    def add(batches):
        g, x, n = total(parse([c[0].as_py() for c in b.slice(i, 1).columns]) for b in batches for i in range(b.num_rows))
        if n:
            yield row(g, x, n)

    # every document is read; a task makes one matrix, and these are summed by tens until ten are left
    sums = saved(docs.select("text").mapInArrow(project, "g binary, x binary, n bigint"), "sketch")
    tasks = sums.count()
    while tasks > 10:
        tasks = -(-tasks // 10)
        sums = saved(sums.repartition(tasks).mapInArrow(add, "g binary, x binary, n bigint"), "sketch")
    g, x, n = total(parse(r) for r in sums.toLocalIterator())
    own_g, own_x = np.zeros((k, k)), np.zeros((width, k))
    own_n = _sketch(np.concatenate(items), np.array([len(i) for i in items]), omega, own_g, own_x)
    weight = max(1.0, n / max(1, own_n))
    g, x = g + weight * own_g, x + weight * own_x * idf[:, None]
    values, vectors = np.linalg.eigh(g)
    good = values > values[-1] * 1e-7
    b = (vectors[:, good] / np.sqrt(values[good])).T @ x.T
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    keep = s > s[0] * 1e-4
    v = (vt[keep] / s[keep, None])[1 : RANK + 1] if keep.sum() > 1 else vt[:1]
    out = (v.T * idf[:, None]).astype(np.float32)
    return out * np.float32(1 / max(1e-30, np.abs(out).max()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, alike: float = ALIKE, loose: float = LOOSE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and benchmark item that it leaks: doc_id, item_id, share of the item that is common."""
    docs = docs.select("doc_id", "text")
    found = [arrow_pass(docs, pairs, RESULT, rows=256) for pairs, _ in _searches(docs, benchmark, cosine, alike, loose, block_chars)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], RESULT)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, alike: float = ALIKE, loose: float = LOOSE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that leak no benchmark item, with all their columns."""
    for _, clean in _searches(docs, benchmark, cosine, alike, loose, block_chars):
        docs = arrow_pass(docs, clean, docs.schema, rows=256)
    return docs


def _searches(docs: DataFrame, benchmark: DataFrame, cosine: float, alike: float, loose: float, block_chars: int) -> list:
    """For each block of the benchmark, what gives the leaking pairs of a batch, and what gives its clean rows."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    benchmark = benchmark.select("item_id", "text", answer.alias("answer")).filter(F.col("text").isNotNull())
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    n_docs = docs.count()
    found = [_search(docs.select("doc_id", "text"), benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), n_docs, cosine, alike, loose) for b in range(blocks)]
    return [f for f in found if f]


def _search(docs: DataFrame, benchmark: DataFrame, n_docs: int, cosine: float, alike: float, loose: float):
    rows = [(r["item_id"], bare_words(r["text"]), bare_words(r["answer"])) for r in benchmark.collect()]  # of bounded length
    rows = [r for r in rows if r[1]]
    if not rows:
        return None
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words, more in rows for w in words + more), 1)}
    ids = [np.array([vocabulary[w] for w in words], np.int32) for _, words, _ in rows]
    df = _frequencies(docs, vocabulary)
    rare = df < 0.1 * n_docs
    basis = _basis(docs, ids, vocabulary, df, n_docs)
    items, passages, owners, offsets = [], {s: [] for s in SCALES}, {s: [] for s in SCALES}, {s: [] for s in SCALES}
    for k, (item_id, _, more) in enumerate(rows):
        own = ids[k].tolist()
        end = [vocabulary[w] for w in more] or own[-max(1, len(own) // 4) :]
        few = [w for w in own if rare[w]]
        weights = {}
        if not few:  # a hot item, or one of frequent words: each word's share of the item's idf
            idf = np.log((n_docs + 1) / (df[own] + 0.5)).clip(1e-6)
            for w, x in zip(own, (idf / idf.sum()).tolist(), strict=True):
                weights[w] = weights.get(w, 0.0) + x
        items.append((item_id, len(own), _masks(own), len(end), _masks(end), len(few), _masks(few), weights))
        for at in range(0, max(1, len(own) - LONGEST + 32), 32) if len(own) > LONGEST else (0,):
            part = ids[k][at : at + LONGEST]
            scale = next(s for s in SCALES if len(part) <= STEP * (s - 1))
            v = basis[part].sum(axis=0)
            passages[scale].append(v / max(1e-12, np.linalg.norm(v)))
            owners[scale].append(k)
            offsets[scale].append(at)
    scales = [(s, np.array(passages[s], np.float32).T, np.array(owners[s]), np.array(offsets[s])) for s in SCALES if passages[s]]
    handle = docs.sparkSession.sparkContext.broadcast((basis, items, scales))

    def make():
        words, (basis, items, scales) = Words(vocabulary), handle.value

        def leaks(region: list[int], k: int, out: dict[int, tuple[float, float]]) -> None:
            _, n, masks, n_end, end, n_few, few, weights = items[k]
            if (k in out and out[k][0] == 1.0) or sum(map(masks.__contains__, region)) < loose * n:
                return
            common = lcs(masks, n, region) / n
            if common < min(alike, loose):
                return
            kept = lcs(end, n_end, region) / n_end
            if common >= alike or (common >= loose and kept == 1.0 and (lcs(few, n_few, region) >= RARER * n_few if n_few else sum(map(weights.get, weights.keys() & set(region))) >= loose)):
                out[k] = max(out.get(k, (0.0, 0.0)), (common, kept))

        lengths = np.array([item[1] for item in items])
        own = np.concatenate([_slots(np.fromiter(item[2], np.int64), k) for k, item in enumerate(items)])
        marked = np.zeros(SLOTS, bool)
        marked[own] = True

        def regions(ids: np.ndarray, sizes: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray]):
            """Text, item, start and end of the hits' regions that can have enough of the item's words; equal ones once."""
            d, k, at = hits
            texts = np.cumsum(sizes) - sizes
            start = np.maximum(0, at - 2 * STEP)
            _, first = np.unique((d * len(items) + k) * (int(start.max(initial=0)) // (2 * STEP) + 1) + start // (2 * STEP), return_index=True)
            first.sort()
            d, k, at, start = (v[first] for v in (d, k, at, start))
            begins, reach = texts[d] + start, np.clip(np.minimum(at + lengths[k] + 4 * STEP, sizes[d]) - start, 0, None)
            ends, i = np.cumsum(reach), 0
            while i < len(ends):  # about a million words at once, or one longer region
                some = slice(i, max(i + 1, int(np.searchsorted(ends, ends[i] - reach[i] + (1 << 20), "right"))))
                i, begin, size = some.stop, begins[some], reach[some]
                edges = np.cumsum(size) - size
                words = ids[np.arange(size.sum()) + np.repeat(begin - edges, size)]
                there = np.concatenate(([0], np.cumsum(marked[_slots(words, np.repeat(k[some], size))])))  # at least as many as are there
                enough = there[edges + size] - there[edges] >= loose * lengths[k[some]]
                yield from zip(*(v[enough].tolist() for v in (d[some], k[some], begin, begin + size)), strict=True)

        def search(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Text, item and place of the item's start, of each window and passage that are alike."""
            blocks = -(-sizes // STEP) + max(SCALES)  # the last windows reach beyond the text
            firsts = np.cumsum(blocks) - blocks
            flat = np.zeros(int(blocks.sum()) * STEP, np.int64)
            flat[np.arange(len(ids)) + np.repeat(firsts * STEP - (np.cumsum(sizes) - sizes), sizes)] = ids
            sums = _added(basis, flat.reshape(-1, STEP), np.zeros((len(flat) // STEP, basis.shape[1]), basis.dtype))
            hits, w, size = [], sums, 1
            for scale, matrix, owners, offsets in scales:
                for j in range(size, scale):
                    w = w[:-1] + sums[j:]
                size = scale
                rows = max(1, (1 << 23) // len(owners))
                for i in range(0, len(w), rows):
                    part = w[i : i + rows]
                    norms = np.sqrt(np.einsum("ij,ij->i", part, part))
                    where, which = np.divmod(np.flatnonzero(part @ matrix >= cosine * np.maximum(norms, 1e-12)[:, None]), len(owners))
                    where += i
                    d = np.searchsorted(firsts, where, "right") - 1
                    hits.append((d, owners[which], (where - firsts[d]) * STEP - offsets[which]))
            return tuple(np.concatenate(x) for x in zip(*hits, strict=True))

        def found(texts: list[str | None]) -> list[dict[int, tuple[float, float]]]:
            out: list[dict] = [{} for _ in texts]
            ids, sizes = words.all(texts)
            ends = np.cumsum(sizes)
            i = 0
            while i < len(texts):  # about 32,000 words at once, or one longer text
                start = ends[i] - sizes[i]
                j = max(i + 1, int(np.searchsorted(ends, start + (1 << 15), "right")))
                part = ids[start : ends[j - 1]]
                for d, k, a, b in regions(part, sizes[i:j], search(part, sizes[i:j])):
                    leaks(part[a:b].tolist(), k, out[i + d])
                i = j
            return out

        return found, items

    def pairs():
        found, items = make()

        def run(cols: dict) -> dict:
            rows = [(d, items[k][0], *v) for d, f in zip(cols["doc_id"], found(cols["text"]), strict=True) for k, v in f.items()]
            return dict(zip(("doc_id", "item_id", "common", "answer"), zip(*rows, strict=True) if rows else ([],) * 4, strict=True))

        return run

    def clean():
        found, _ = make()

        def run(cols: dict) -> dict:
            keep = [not f for f in found(cols["text"])]
            return {c: [x for x, k in zip(v, keep, strict=True) if k] for c, v in cols.items()}

        return run

    return pairs, clean


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
