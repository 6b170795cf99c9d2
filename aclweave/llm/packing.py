"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Lengths lie between 1 and the capacity, so the whole packing problem is a histogram of ``capacity`` numbers, whatever the
number of documents. The plan is made on that histogram: patterns (lists of lengths) with how often each is used. Pieces
are then dealt to pattern slots by their rank within their length, in parallel. Pieces that fill a sequence alone take no
part in that.

Defined results: a null text is empty and packs its end id alone; an empty table gives no rows; repeated rows are packed as
often as they occur; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import arrow_pass, saved, table
from .tokens import Encoder, default_vocabulary

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that are ranked in one group.
SALTED = 20_000


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often to use each, using up ``counts``.

    A bin is filled greedily, always with the longest length that still fits; then its smallest member (of one alone, that)
    is replaced by the two unpacked lengths that fill the widened gap best, if they fill it more tightly. One pattern serves as many bins as
    the counts allow, and each use of one exhausts a length, so there are at most ``capacity`` patterns.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a length is outside 1 to the capacity")
    patterns = []
    while left:
        lengths, used = sorted(left, reverse=True), {}
        bin_, gap = [], capacity
        for n in lengths:
            while n <= gap and left[n] > used.get(n, 0):
                bin_.append(n)
                used[n] = used.get(n, 0) + 1
                gap -= n
        small = bin_[-1]
        if gap:
            used[small] -= 1
            room, best = gap + small, (small, ())
            free = [n for n in reversed(lengths) if left[n] > used.get(n, 0) and n < room]
            i, j = 0, len(free) - 1
            while i <= j:
                total = free[i] + free[j]
                if total > room or i == j and left[free[i]] - used.get(free[i], 0) < 2:
                    j -= 1
                    continue
                if total > best[0]:
                    best = (total, (free[i], free[j]))
                i += 1
            bin_[-1:] = best[1] or (small,)
            used = {n: bin_.count(n) for n in bin_}
        times = min(left[n] // k for n, k in used.items())
        patterns.append((bin_, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return patterns


def slots(patterns: Iterable[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, uses, first sequence, offset), ranks counted from 0."""
    out, ranks, sequence = [], {}, 0
    for bin_, times in patterns:
        offset = 0
        for n in bin_:
            out.append((n, ranks.get(n, 0), times, sequence, offset))
            ranks[n] = ranks.get(n, 0) + times
            offset += n
        sequence += times
    return out


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and end id, cut into pieces only where they exceed the capacity."""

    def make():
        encode, end = Encoder(vocabulary), end_id.to_bytes(4, "little")

        def run(cols: dict) -> dict:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, ids in zip(cols["doc_id"], encode(cols["text"]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        out[name].append(value)
            return out

        return run

    ids = ", ids binary" if keep_ids else ""
    return arrow_pass(docs.select("doc_id", "text"), make, f"doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint{ids}")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with ``length``) with ``sequence_id`` and ``offset``.

    Ranks within a length come from counts per (length, salt) and a row number within each such group of about ``SALTED``
    rows, so a length that very many pieces share is ranked by many tasks. Full pieces get sequences of their own (below 0).
    """
    spark = pieces.sparkSession
    total = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(n < 1 or n > capacity for n in total):
        raise ValueError("a length is outside 1 to the capacity")
    plan = slots(best_two_fit({n: c for n, c in total.items() if n < capacity}, capacity))
    # the plan has at most one row for each slot of at most `capacity` patterns: arrays of starts, searched by rank
    by: dict[int, list] = {}
    for n, first, times, sequence, offset in plan:
        by.setdefault(n, []).append((first, sequence, offset))
    rows = [(n, 1 + total[n] // SALTED, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for n, v in by.items()]
    where = spark.createDataFrame(rows, "length bigint, _salts bigint, _firsts array<bigint>, _sequences array<bigint>, _offsets array<bigint>")
    own = [c for c in pieces.columns if c != "ids"]
    salted = pieces.filter(F.col("length") < capacity).join(F.broadcast(where.select("length", "_salts")), "length").withColumn("_salt", F.pmod(F.xxhash64(*own), F.col("_salts")))
    by_length = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_salt").count().withColumn("_first", F.coalesce(F.sum("count").over(by_length), F.lit(0))).drop("count")
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*own)) - 1)
    ranked = ranked.join(firsts, ["length", "_salt"]).withColumn("_rank", F.col("_row") + F.col("_first"))
    slot = F.size(F.filter("_firsts", lambda x: x <= F.col("_rank")))
    placed = ranked.join(F.broadcast(where.drop("_salts")), "length").withColumn("_slot", slot)
    at = lambda c: F.element_at(c, F.col("_slot"))
    placed = placed.select(*pieces.columns, (at("_sequences") + F.col("_rank") - at("_firsts")).alias("sequence_id"), at("_offsets").alias("offset"))
    full = pieces.filter(F.col("length") == capacity).select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids of each, in order (needs pieces made with keep_ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most `capacity` pieces
    joined: Column = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    return pack(saved(token_pieces(docs, vocabulary or default_vocabulary(), capacity, end_id, keep_ids), "pieces"), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
