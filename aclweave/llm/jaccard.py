"""Exact Jaccard join of word shingles by universe partition and pigeonhole.

A document is the set of its distinct 5-word shingles; two link at 80 % overlap. Sizes are cut into bands whose bounds grow
by 1 / 0.8 (large ones by 1 / 0.64), so linked sets lie in one band or in neighbours, and every set is indexed by its own
band's scheme and, where sets of the band below are large enough to link to it, by theirs. In a scheme, sets differ by at most H shingles where they link. Shingles are hashed into segments:

* large bands: more segments than H. Linked sets agree on all but as many as they differ by, and a set of n shingles
  differs from any that it links to by at most h = n / 4. Each set leaves out its costliest segments, empty ones first, then
  those whose subset is most frequent in the corpus (counted beforehand), and indexes h + 1. As both sets order their common
  subsets alike, and have more of them than either leaves out, one of these is left out by neither.
* small bands: H // 2 + 1 segments, of which linked sets have one that differs by at most one shingle. Its subset and the
  subsets without one of its shingles (one-deletion neighbourhoods) are indexed, and meet.

Of sets that share an indexed subset, each is compared first with one of them, the set with most frequent subsets (its
leader). Parity sketches, whose differing bits never exceed the differing shingles, drop pairs beforehand: 512 bits, and for
large sets a finer one that grows with the set. The rest are verified on the whole texts' shingles; a text is moved to its
leader once, and a leader with many members is dealt to several tasks.

What this leaves apart is compared pair by pair, but only where a set isn't in its leader's component. Sizes, the triangle
inequality over the leader and both sketches are conditions of that join, so no row exists for a pair that they refuse; pairs
meet by subset or by leader, whichever compares less, and crowded groups are dealt out in tiles. Equal sets are one node throughout.

Defined results: texts without words, and null texts, are empty sets, linked with nothing; fewer than five words are one
shingle; a null doc_id counts as larger than any other; repeated rows are one node and each get a row; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow_pass, saved, slices, table

SHINGLE, PERCENT = 5, 80
#: Up to this size bands use one-deletion neighbourhoods.
SMALL = 24
_CELLS = 1 << 20
#: Bits of the finest sketch; most bits of the bitmap of wanted texts; members of a leader in one task; comparisons in a tile.
_FINEST, _BITMAP, _MEMBERS, _TILE = 1 << 15, 1 << 27, 1024, 4_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


class Shingler:
    """A text's distinct shingles as sorted 64-bit hashes."""

    def __init__(self, size: int = SHINGLE):
        from xxhash import xxh3_64_intdigest

        self.size, self.digest = size, xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            return np.zeros(0, _U)
        h = np.fromiter(map(self.digest, words), _U, len(words))
        n = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                out = out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
            return _distinct(_mix(out + _U(n)))


#: Bands by percentage, with their lowest sizes; a plain table, so that it travels to executors by value.
_BANDS: dict[int, tuple[list[tuple[int, int, int, int]], np.ndarray]] = {}


def _most(a: int, b: int, percent: int) -> int:
    """By how many shingles linked sets of these sizes differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def schemes(percent: int = PERCENT) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(lowest size, highest size, segments, 1 for one-deletion) of each band; the lowest sizes."""
    if percent not in _BANDS:
        out, low = [], 1
        while low < 1 << 40:
            high = low if low < 5 else low * 100 // percent
            if high <= SMALL:
                out.append((low, high, _most(high, high * 100 // percent, percent) // 2 + 1, 1))
            else:
                high = high * 100 // percent
                most = _most(high, high * 100 // percent, percent)
                out.append((low, high, most + 5 + most // 14, 0))
            low = high + 1
        _BANDS[percent] = out, np.array([s[0] for s in out])
    return _BANDS[percent]


def subsets(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For the set's schemes: (how many it leaves out, segment subsets' hashes, which are empty); deletions included."""
    bands, lows = schemes(percent)
    band = int(np.searchsorted(lows, len(s), "right")) - 1
    out = []
    for k in {band, band - 1} - {-1}:
        low, high, m, deletions = bands[k]
        if len(s) * percent > 100 * high:
            continue  # no set of that band is large enough to link
        largest = len(s) * 100 // percent if k == band else high
        spare = 0 if deletions else m - 1 - _most(len(s), largest, percent)
        with np.errstate(over="ignore"):
            salt = _U((k * 0x2545F4914F6CDD1D + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
            segment = ((s >> _U(32)) % _U(m)).astype(np.uint16 if m < 1 << 16 else np.int64)
            sums = np.zeros(m, _U)
            order = np.argsort(segment, kind="stable")
            sizes = np.bincount(segment, minlength=m)
            full = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[full]
            sums[full] = np.add.reduceat(s[order], starts)
            place = _mix(np.arange(m, dtype=_U) + salt * _U(31))
            own = sums + place
            if deletions:
                less = (sums[segment] - s) + place[segment]
                own, full = np.concatenate((own, less)), np.ones(m + len(s), bool)
            out.append((spare, _mix(own), ~full))
    return out


def indexed(s: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The subsets to index, as 56 bits of hash and 8 bits of rank (how few of the set's subsets are frequent)."""
    parts, frequent = [], 0
    for spare, h, empty in subsets(s, percent):
        cost = hot[(h >> _U(8)).astype(np.int64) & (_CELLS - 1)].astype(np.int64)
        frequent += int((cost > 0).sum())
        if spare:
            order = np.lexsort((h, np.where(empty, 1 << 62, cost)))
            h = h[order[: len(h) - spare]]
        parts.append(h)
    h = np.concatenate(parts) if parts else np.zeros(0, _U)
    return (h & ~_U(255)) | _U(255 - min(255, frequent))


def _node(s: np.ndarray) -> int:
    """The identity of a set: a sum of its mixed hashes."""
    with np.errstate(over="ignore"):
        return int(_mix(_mix(s).sum(dtype=_U) + _U(len(s))).view(np.int64)) if len(s) else 0


def sketches(s: np.ndarray) -> tuple[list[int], list[int] | None]:
    """A set's parities over 512 cells and, for large sets, over a power of two of cells that is at least twice its size."""
    m = 512
    while m < 2 * len(s) and m < _FINEST:
        m *= 2
    bits = np.bincount(((s >> _U(13)) & _U(m - 1)).astype(np.int64), minlength=m) & 1
    pack = lambda x: np.packbits(x.astype(bool)).view(np.int64).tolist()
    return pack(bits.reshape(-1, 512).sum(axis=0) & 1), pack(bits) if m > 512 else None


def _facts(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Each document's node, set size and parity sketches; in a task's last row the counts of frequent subsets."""
    longs = pa.list_(pa.int64())
    out = pa.schema([("doc_id", pa.int64()), ("_t", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("parity", longs), ("fine", longs), ("cells", longs), ("counts", longs)])

    def run(batches):
        shingles, cells, seen = Shingler(size), np.zeros(_CELLS, np.uint32), set()
        for batch in (part for whole in batches for part in slices(whole, 512)):
            rows = []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                node = _node(s)
                rows.append((node, len(s), *sketches(s)))
                if node not in seen and len(s):
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node)
                    for spare, h, empty in subsets(s, percent):
                        if spare:
                            np.add.at(cells, (h[~empty] >> _U(8)).astype(np.int64) & (_CELLS - 1), 1)
            cols = [batch.column("doc_id"), batch.column("_t"), *zip(*rows, strict=True)] if rows else None
            if cols:
                none = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*cols, none, none], out, strict=True)], schema=out)
        mean = cells.mean()
        at = np.flatnonzero(cells > mean + 6 * np.sqrt(mean) + 3)
        if len(at):
            last = [*[[None]] * 6, [at.tolist()], [(cells[at] - int(mean)).tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(last, out, strict=True)], schema=out)

    return docs.mapInArrow(run, "doc_id bigint, _t bigint, node bigint, n bigint, parity array<bigint>, fine array<bigint>, cells array<bigint>, counts array<bigint>")


def _index(docs: DataFrame, hot, percent: int, size: int) -> DataFrame:
    def make():
        shingles, seen = Shingler(size), set()

        def run(cols: dict) -> dict:
            sigs, nodes = [], []
            for text in cols["text"]:
                s = shingles(text)
                node = _node(s)
                if not len(s) or node in seen:  # equal sets in one task are indexed once
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                h = indexed(s, hot.value, percent)
                sigs.append(h.view(np.int64))
                nodes.append(np.full(len(h), node, np.int64))
            none = np.zeros(0, np.int64)
            return {"sig": np.concatenate([none, *sigs]), "node": np.concatenate([none, *nodes])}

        return run

    return arrow_pass(docs.select("text"), make, "sig bigint, node bigint", rows=512)


def _shared(index: DataFrame) -> DataFrame:
    """Of subsets that several nodes share: each node, with the first of them as leader. Reads sorted rows as a stream."""
    out = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("leader", pa.int64())])

    def run(batches):
        last = None  # subset, node, leader, whether still alone
        for batch in batches:
            s = batch.column(0).to_numpy() >> 8
            n = batch.column(1).to_numpy()
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
            if len(s) and last and (s[0], n[0]) == last[:2]:
                new[0] = False
            s, n = s[new], n[new]
            if not len(s):
                continue
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            runs = np.flatnonzero(first)
            sizes = np.diff(np.append(runs, len(s)))
            leaders = n[runs].copy()
            keep = sizes > 1
            head = ([], [], [])
            if last and s[0] == last[0]:
                leaders[0], keep[0] = last[2], True
                if last[3]:
                    head = ([last[0]], [last[1]], [last[2]])
            rows = np.repeat(keep, sizes)
            last = (s[-1], n[-1], leaders[-1], not keep[-1])
            cols = [np.concatenate((np.array(h, np.int64), c)) for h, c in zip(head, (s[rows], n[rows], np.repeat(leaders, sizes)[rows]), strict=True)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out)

    dealt = index.repartition(F.shiftright("sig", 8)).sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(run, "sig bigint, node bigint, leader bigint")


def _apart(p: str, q: str) -> Column:
    """Differing bits of two sketches of 512 bits."""
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(p)[i].bitwiseXOR(F.col(q)[i])) for i in range(8)])


def _finely_apart(p: str, q: str) -> Column:
    """Differing bits of two finer sketches, the longer one folded to the other's length; 0 where one is missing."""

    def fold(c: Column) -> Column:
        half = (F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    def bits(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, n: a + n)

    a, b = F.col(p), F.col(q)
    same, longer, shorter = F.size(a) == F.size(b), F.size(a) == 2 * F.size(b), 2 * F.size(a) == F.size(b)
    return F.coalesce(F.when(same, bits(a, b)).when(longer, bits(fold(a), b)).when(shorter, bits(a, fold(b))), F.lit(0))


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sizes and ``least``: they differ by at least so many shingles, by sizes and parity."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("p_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("p_b"))
    return pairs.join(one, "a").join(two, "b").withColumn("least", F.greatest(_apart("p_a", "p_b"), F.abs(F.col("n_a") - F.col("n_b")))).drop("p_a", "p_b")


def _may_link(least, n_a, n_b, percent: int):
    """Whether sets of these sizes that differ by at least ``least`` can link."""
    return least * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) with by how many of their whole texts' shingles they differ, and whether they link.

    b's text comes first in each of its tasks, then the texts of those compared with it.
    """
    spark = docs.sparkSession
    salts = pairs.groupBy("b").agg(F.floor(F.count("*") / _MEMBERS).alias("_more"))
    dealt = pairs.select("a", "b").join(salts, "b").withColumn("_salt", F.pmod(F.xxhash64("a"), F.col("_more") + 1))
    roles = dealt.select("b", "_salt", F.col("a").alias("node"), F.lit(1).alias("_kind"))
    roles = roles.unionByName(dealt.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_more"))).alias("_salt"), F.col("b").alias("node"), F.lit(0).alias("_kind")).distinct())
    roles = roles.join(nodes.select("node", F.col("rep.doc_id").alias("_d"), F.col("rep._t").alias("_r")), "node")
    roles = saved(roles, "roles")
    # a bitmap keeps most other texts from being moved; its size follows the number of wanted texts up to _BITMAP bits
    bits = 1 << 16
    while bits < _BITMAP and bits < 16 * roles.count():
        bits *= 2

    def bitmap(batches):
        out = np.zeros(bits, bool)
        for batch in batches:
            out[batch.column(0).to_numpy().view(_U) % _U(bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])

    parts = roles.select("_r").coalesce(4).mapInArrow(bitmap, "bits binary").toLocalIterator()
    handle = spark.sparkContext.broadcast(functools.reduce(np.bitwise_or, (np.frombuffer(r[0], np.uint8) for r in parts), np.zeros(bits // 8, np.uint8)))

    moved = pa.schema([("doc_id", pa.int64()), ("_t", pa.int64()), ("size", pa.int64()), ("packed", pa.binary())])

    def maybe(batches):
        wanted, seen, codec = handle.value, set(), pa.Codec("zstd", 3)
        for batch in batches:
            at = batch.column("_t").to_numpy().view(_U) % _U(bits)
            keep = (wanted[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1 == 1
            for i in np.flatnonzero(keep).tolist():  # a repeated row is moved once a task
                key = (batch.column("doc_id")[i].as_py(), batch.column("_t")[i].as_py())
                keep[i] = key not in seen
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
            some = batch.filter(pa.array(keep))
            texts = [t.encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()]
            cols = [some.column("doc_id"), some.column("_t"), [len(t) for t in texts], [codec.compress(t, asbytes=True) for t in texts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, moved, strict=True)], schema=moved)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64()), ("linked", pa.bool_())])

    def compare(batches):
        shingles, codec, last, own = Shingler(size), pa.Codec("zstd"), None, None
        for batch in (part for whole in batches for part in slices(whole, 256)):
            rows = []
            for b, node, kind, n, packed in zip(*(batch.column(c).to_pylist() for c in ("b", "node", "_kind", "size", "packed")), strict=True):
                if (b, node, kind) == last:  # a repeated row
                    continue
                last = (b, node, kind)
                s = shingles(codec.decompress(packed, n, asbytes=True).decode("utf-8", "surrogatepass"))
                if not kind:
                    own = s
                    continue
                same = len(np.intersect1d(s, own, assume_unique=True))
                rows.append((node, b, len(s) + len(own) - 2 * same, 100 * same >= percent * (len(s) + len(own) - same)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    some = docs.mapInArrow(maybe, "doc_id bigint, _t bigint, size bigint, packed binary")
    found = some.join(roles, (some["_t"] == roles["_r"]) & some["doc_id"].eqNullSafe(roles["_d"])).select("b", "_salt", "_kind", "node", "size", "packed")
    return found.repartition("b", "_salt").sortWithinPartitions("b", "_salt", "_kind", "node").mapInArrow(compare, "a bigint, b bigint, apart bigint, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes that have edges: least labels are passed on and followed to their own until none change."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        passed = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        further = labels.select(F.col("node").alias("low"), F.col("comp").alias("jump"))
        after = saved(passed.join(further, "low").select("node", F.least("low", "jump").alias("comp"), (F.least("low", "jump") != F.col("comp")).alias("changed")), "labels")
        labels = after.select("node", "comp")
        if after.filter("changed").isEmpty():
            return labels


def _left_over(shared: DataFrame, stars: DataFrame, tested: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a subset, lie in different components and may link.

    One of the two isn't in the component of the subset's leader (it is ``out``). Distances obey the triangle inequality, so
    a set that differs much from the leader is compared only with others that differ much from it, not with its near copies.
    """
    comp = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c_{c}"))
    known = stars.join(tested.select("a", "b", "apart"), ["a", "b"], "left").join(comp("a"), "a", "left").join(comp("b"), "b", "left")
    known = known.withColumns({"c_a": F.coalesce("c_a", "a"), "c_b": F.coalesce("c_b", "b"), "least": F.coalesce("apart", "least"), "most": F.coalesce("apart", F.col("n_a") + F.col("n_b"))})
    known = saved(known.select(F.col("a").alias("node"), F.col("b").alias("leader"), F.col("c_a").alias("c"), (F.col("c_a") != F.col("c_b")).alias("out"), F.col("n_a").alias("n"), "least", "most"), "known")
    # only groups that have a set outside its leader's component, and another beside it, move any further
    count = lambda rows, *keys: rows.groupBy(*keys).agg(F.count("*").alias("all"), F.count_if("out").alias("outs")).filter("outs > 0 AND all > 1")
    by_leader = count(known, "leader")
    known = saved(known.join(by_leader.select("leader"), "leader", "left_semi"), "crowded")
    members = shared.filter("node != leader").join(known.select("node", "leader", "out"), ["node", "leader"])
    by_sig = saved(count(members, "leader", "sig"), "crowds")
    # pairs meet by leader where all of them are fewer than those by subset, which may meet many times
    cost = by_sig.groupBy("leader").agg(F.sum(F.col("all") * F.col("outs")).alias("cost"))
    split = lambda c: F.least(F.ceil(F.sqrt(c / _TILE)), F.lit(4096)).cast("int")
    ways = by_leader.join(cost, "leader").withColumn("whole", F.col("all") * F.col("outs") <= F.col("cost")).withColumn("tiles", split(F.col("all") * F.col("outs")))
    ways = saved(ways.select("leader", "whole", "tiles"), "ways")
    whole = known.select("node", "leader").join(ways.filter("whole"), "leader").select("node", "leader", F.lit(0).cast("bigint").alias("sig"), "tiles")
    crowds = by_sig.join(ways.filter("NOT whole").select("leader"), "leader").select("leader", "sig", split(F.col("all") * F.col("outs")).alias("tiles"))
    parts = members.select("node", "leader", "sig").join(crowds, ["leader", "sig"]).select("node", "leader", "sig", "tiles")
    rows = whole.unionByName(parts).join(known, ["node", "leader"]).join(nodes.select("node", "parity", "fine"), "node")
    place = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    facts = ["node", "c", "n", "least", "most", "parity", "fine"]
    outer = rows.filter("out").select("leader", "sig", place.alias("_i"), every.alias("_j"), *[F.col(x).alias(f"{x}_1") for x in facts])
    inner = rows.select("leader", "sig", every.alias("_i"), place.alias("_j"), "out", *[F.col(x).alias(f"{x}_2") for x in facts])
    sizes = F.col("n_1"), F.col("n_2")
    apart = F.greatest(F.col("least_1") - F.col("most_2"), F.col("least_2") - F.col("most_1"), F.abs(sizes[0] - sizes[1]))
    one_of_two = ~F.col("out") | (F.col("node_1") < F.col("node_2"))
    tests = [F.col("c_1") != F.col("c_2"), one_of_two, *(_may_link(x, *sizes, percent) for x in (apart, _apart("parity_1", "parity_2"), _finely_apart("fine_1", "fine_2")))]
    met = [F.col(f"o.{x}") == F.col(f"i.{x}") for x in ("leader", "sig", "_i", "_j")]
    pairs = outer.alias("o").join(inner.alias("i"), functools.reduce(lambda x, y: x & y, met + tests))
    return pairs.select(F.col("node_1").alias("a"), F.col("node_2").alias("b")).distinct()


def _grouped(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of each row; each node with the smallest doc_id that links reach; the first row of each group of linked ones."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_t"))
    facts = saved(_facts(docs, percent, size), "facts")
    hot = np.zeros(_CELLS, np.uint32)
    # at most as many rows as there are cells, and only the frequent ones
    for cell, count in facts.filter("cells IS NOT NULL").select(F.explode(F.arrays_zip("cells", "counts")).alias("x")).groupBy("x.cells").agg(F.sum("x.counts")).toLocalIterator():
        hot[cell] = min(count, 0xFFFFFFFF)
    rows = facts.filter("node IS NOT NULL").drop("cells", "counts")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_t")).alias("rep"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("fine").alias("fine"))
    nodes = saved(nodes, "nodes")
    shared = saved(_shared(_index(docs, spark.sparkContext.broadcast(hot), percent, size)), "shared")
    stars = shared.filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    stars = saved(_bounded(stars, nodes), "stars")
    linked = _may_link(F.col("least"), F.col("n_a"), F.col("n_b"), percent)
    tested = saved(_verified(stars.filter(linked).select("a", "b"), docs, nodes, percent, size), "tested")
    edges = tested.filter("linked")
    labels = components(edges)
    rest = saved(_left_over(shared, stars, tested, labels, nodes, percent), "rest")
    more = saved(_verified(rest, docs, nodes, percent, size).filter("linked"), "links")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    ids = nodes.select("node", "low", "rep").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = saved(ids.groupBy("comp").agg(F.min("low").alias("component_id"), F.min("rep").alias("first")), "groups")
    ids = saved(ids.join(least, "comp").select("node", "component_id"), "components")
    return rows, ids, least.select("first.doc_id", "first._t")


def join_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of docs."""
    rows, ids, _ = _grouped(docs, percent, size)
    # empty sets have nothing to look up: their ids keep them from meeting in one task
    keyed = rows.withColumn("node", F.when(F.col("n") == 0, F.xxhash64("doc_id")).otherwise(F.col("node")))
    found = keyed.join(ids, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id (null last); of rows that repeat id and text, one."""
    rows, _, first = _grouped(docs, percent, size)
    own = "_key"
    while own in docs.columns:
        own = f"_{own}"
    # a struct is one key, equal where its parts are (nulls too), by which the join and the removal of repeats are both dealt
    key = F.struct("doc_id", "_t").alias(own)
    kept = first.select(key).unionByName(rows.filter("n = 0").select(key))
    keyed = docs.withColumn(own, F.struct("doc_id", F.xxhash64("text").alias("_t")))
    return keyed.join(kept, own, "left_semi").dropDuplicates([own]).drop(own)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
