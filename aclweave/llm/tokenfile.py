"""Token-id files with directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level k stores the k-th chunks of the ids that have one, in order, and
a bitmap with a bit for each that is set where the id goes on at level k + 1; a directory has the rank of each bitmap at
every 512th bit. The position of an id's next chunk is the rank of its bit, so any id is read in a few steps without
decoding others.

A shard is one value of ``payload`` and complete in itself: ``DAC2``, the numbers of documents, ids and levels and the place
of the first level, the documents' ids (a bitmap marks null ones) and ends, then for each level its length, chunks, bitmap,
directory. Shards are rows of a Parquet table without compression or dictionaries, so every store that Spark writes to can
hold them, and a payload's bytes stand in its file as they are: ``payload_places`` finds them, and ``Reader`` reads single
ids there with a few short reads.

Key ranges are cut first, from ids and hashes alone; then texts are encoded, and what is moved once and sorted are ids of two
bytes where the vocabulary allows it.

Defined results: a null text is empty (its end id alone); an empty table gives no shards; rows are ordered by doc_id (null
first), then by a hash of the text, and repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow_pass, saved, slices, table, work_dir
from .tokens import Encoder, default_vocabulary

END_ID, BLOCK = 2, 512
#: Text whose ids one task sorts and writes, in bytes, at about.
TASK_BYTES = 1 << 28
MAGIC = b"DAC2"
_HEAD = "<4sIQBI"
_HEAD_SIZE = struct.calcsize(_HEAD)


def encode_ids(ids: np.ndarray, doc_ids: list[int | None] = (), lengths: list[int] = ()) -> bytes:
    levels, left = [], ids.astype(np.uint32)
    while True:
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-max(len(more), 1) // BLOCK) * BLOCK, dtype=bool)
        padded[: len(more)] = more
        ranks = np.concatenate(([0], np.cumsum(padded.reshape(-1, BLOCK).sum(axis=1))[:-1])).astype("<u4")
        levels.append(struct.pack("<I", len(left)) + (left & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        left = left[more] >> 8
        if not len(left):
            break
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + nulls + np.cumsum(np.array(lengths, "<u4"), dtype="<u4").tobytes()
    return struct.pack(_HEAD, MAGIC, len(doc_ids), len(ids), len(levels), _HEAD_SIZE + len(docs)) + docs + b"".join(levels)


class Reader:
    """A shard's ids: ``reader[i]`` for any one, ``reader.all()`` for all, ``reader.documents()`` for who has them.

    The shard is given as bytes, or as a function that reads n of its bytes at an offset; then only what is asked for is read.
    """

    def __init__(self, payload: bytes | Callable[[int, int], bytes]):
        self.read = payload if callable(payload) else lambda at, n: payload[at : at + n]
        head = self.read(0, _HEAD_SIZE)
        if head[:4] != MAGIC:
            raise ValueError("not a token-id shard")
        _, self.n_docs, self.count, levels, at = struct.unpack(_HEAD, head)
        self.levels = []  # of each: its length, and where its chunks, bitmap and directory start
        for _ in range(levels):
            (n,) = struct.unpack("<I", self.read(at, 4))
            bits, ranks = -(-n // 8), max(1, -(-n // BLOCK))
            self.levels.append((n, at + 4, at + 4 + n, at + 4 + n + bits))
            at += 4 + n + bits + 4 * ranks

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, ranks) in enumerate(self.levels):
            value |= self.read(chunks + i, 1)[0] << 8 * k
            start = i - i % BLOCK
            bits = int.from_bytes(self.read(bitmap + (start >> 3), (i >> 3) + 1 - (start >> 3)), "little")
            if not bits >> (i - start) & 1:
                break
            (before,) = struct.unpack("<I", self.read(ranks + 4 * (start // BLOCK), 4))
            i = before + (bits & ((1 << (i - start)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        out, at = np.zeros(self.count, np.uint32), np.arange(self.count)
        for k, (n, chunks, bitmap, ranks) in enumerate(self.levels):
            out[at] |= np.frombuffer(self.read(chunks, n), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            if k + 1 < len(self.levels):
                at = at[np.unpackbits(np.frombuffer(self.read(bitmap, ranks - bitmap), np.uint8), count=n, bitorder="little").astype(bool)]
        return out

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and where each ends."""
        n, at = self.n_docs, _HEAD_SIZE
        ids = np.frombuffer(self.read(at, 8 * n), "<i8").tolist()
        nulls = np.unpackbits(np.frombuffer(self.read(at + 8 * n, -(-n // 8)), np.uint8), count=n)
        ends = np.frombuffer(self.read(at + 8 * n + -(-n // 8), 4 * n), "<u4")
        return [None if x else d for d, x in zip(ids, nulls.tolist(), strict=True)], ends


def payload_places(file) -> Iterator[tuple[int, int]]:
    """(offset, length) of each payload in one Parquet file of shards (a seekable file), in its rows' order."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(file).metadata
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        column = next(group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == "payload")
        if column.compression != "UNCOMPRESSED":
            raise ValueError("the shards are compressed")
        at, end = column.data_page_offset, column.data_page_offset + column.total_compressed_size
        for _ in range(group.num_rows):
            file.seek(at)
            # a value follows the one before it, or the next page's short header: its length, then its mark
            skip = file.read(min(4096, end - at)).index(MAGIC)
            file.seek(at + skip - 4)
            (n,) = struct.unpack("<I", file.read(4))
            yield at + skip, n
            at += skip + n


def _placed(doc_id: int | None, h: int, row: int) -> tuple:
    """What documents are ordered by: id (null first), hash of the text, place."""
    return doc_id is not None, doc_id or 0, h, row


def encoded(docs: DataFrame, vocabulary: str, end_id: int, cuts: list[tuple]) -> DataFrame:
    """Each document's ids with its end id, as little-endian numbers of ``width`` bytes, and the key range that it lies in."""

    def make():
        encode, end = Encoder(vocabulary), end_id.to_bytes(4, "little")
        narrow = max(encode.whole.get_vocab_size(), end_id + 1) <= 1 << 16

        def run(cols: dict) -> dict:
            ids = [b + end for b in encode(cols["text"])]
            lengths = [len(b) // 4 for b in ids]
            if narrow:
                ids = [np.frombuffer(b, "<u4").astype("<u2").tobytes() for b in ids]
            parts = [bisect_right(cuts, _placed(*key)) for key in zip(cols["doc_id"], cols["_h"], cols["_r"], strict=True)]
            return {"part": parts, "doc_id": cols["doc_id"], "_h": cols["_h"], "_r": cols["_r"], "n": lengths, "width": [2 if narrow else 4] * len(ids), "ids": ids}

        return run

    return arrow_pass(docs, make, "part int, doc_id bigint, _h bigint, _r bigint, n bigint, width int, ids binary", rows=256)


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shard_ids: int = 1 << 20, path: str | None = None) -> DataFrame:
    """Shards of about ``shard_ids`` ids, in ascending doc_id order by (part, shard); a longer document has one of its own.

    They are written to ``path``, or to a new shared folder, and what is returned reads them there.
    """
    spark = docs.sparkSession
    # rows that repeat id and text are ordered by their place, so that even very many are dealt to several tasks
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_r"))
    keys = saved(docs.select("doc_id", "_h", "_r", F.octet_length("text").alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    ranges = keys.repartitionByRange(n, "doc_id", "_h", "_r").groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "_h", "_r")).alias("low"))
    cuts = sorted(_placed(*r["low"]) for r in ranges.collect())[1:]  # one for each write task
    ordered = encoded(docs, vocabulary, end_id, cuts).repartitionById(n, "part").sortWithinPartitions("part", "doc_id", "_h", "_r")
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        own, docs_, lengths, size, first, shard, part = [], [], [], 0, 0, 0, None

        def flush():
            row = [[part], [shard], [first], [size], [encode_ids(np.concatenate(own), docs_, lengths)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(row, schema, strict=True)], schema=schema)

        for batch in (b for whole in batches for b in slices(whole, 256)):
            for part, doc_id, k, width, b in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "width", "ids")), strict=True):  # noqa: B007
                if size and size + k > shard_ids:
                    yield flush()
                    own, docs_, lengths, first, size, shard = [], [], [], first + size, 0, shard + 1
                own.append(np.frombuffer(b, f"<u{width}"))
                docs_.append(doc_id)
                lengths.append(k)
                size += k
        if size:
            yield flush()

    path = path or f"{work_dir(spark)}/shards"
    shards = ordered.select("part", "doc_id", "n", "width", "ids").mapInArrow(run, "part int, shard int, first bigint, n_ids bigint, payload binary")
    shards.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(shards.schema).parquet(path)


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Each document of the shards: where it starts among all ids, how many it has, their checksum (and the ids)."""
    spark = shards.sparkSession
    before, offsets = 0, []
    for part, n in sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row for each write task
        offsets.append((part, before))
        before += n
    parts = spark.createDataFrame(offsets, "part int, _before bigint")
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, payload = (batch.column(k)[row].as_py() for k in range(3))
                reader = Reader(payload)
                ids = reader.all().astype("<u4").tobytes()
                doc_ids, ends = reader.documents()
                ends = ends.astype(np.int64)
                starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                pieces = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [[part] * len(pieces), doc_ids, starts + first, ends - starts, [zlib.crc32(p) for p in pieces]] + [pieces] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(cols, schema, strict=True)], schema=schema)

    out = shards.select("part", "first", "payload").mapInArrow(run, "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    return out.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("_before")).drop("part", "_before")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), default_vocabulary()))
