import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aclweave.llm import packing, tokenfile
from aclweave.llm.base import table
from aclweave.llm.tokens import Encoder, default_vocabulary

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library(plain):
    rng = random.Random(2)
    odd = ["a\x1cb  É'S don't 12ab İx Σας ΣΑΣ \u0301e ﬁ 日本語 é <|endoftext|> \x85\xa0x", "hello <|endoftext|> world", "HELLO <|ENDOFTEXT|><|startoftext|>", "", None, " \n", "x" * 5000, "naïve—dash 'll's"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), 32, 39, 0x301])) for _ in range(60)) for _ in range(200)]
    for memo in (50, 400_000):
        assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(default_vocabulary(), memo)(odd)] == [plain(t) for t in odd]


def test_addressable_codes_round_trip():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0, int), np.array([0]), np.array([255, 256, 65535, 65536, 2**32 - 1]), rng.integers(0, 50_000, 5000), rng.integers(0, 200, 1024)):
        r = tokenfile.Reader(tokenfile.encode_ids(ids))
        assert r.all().tolist() == ids.tolist() and len(r) == len(ids)
        assert [r[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
        with pytest.raises(IndexError):
            r[len(ids)]
    with pytest.raises(ValueError):
        tokenfile.Reader(b"nope")


def test_token_files(spark, plain):
    docs = sorted((r.doc_id, plain(r.text) + [2]) for r in table(spark, DIR, "documents").collect())
    want, at = [], 0
    for d, ids in docs:
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfile.op7_token_files(spark, DIR).collect())) == want
    small = tokenfile.write_shards(table(spark, DIR, "documents"), default_vocabulary(), shard_ids=500)
    assert small.count() > 50
    assert sorted(map(tuple, tokenfile.read_documents(small).collect())) == want


def test_token_files_odd_rows(spark, odd, nothing):
    got = tokenfile.read_documents(tokenfile.write_shards(odd, default_vocabulary())).orderBy("start").collect()
    assert len(got) == odd.count() and got[0].doc_id is None and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert tokenfile.read_documents(tokenfile.write_shards(nothing, default_vocabulary())).count() == 0


def test_single_ids_are_read_from_the_file(spark, plain, tmp_path):
    """A token id costs a few short reads at its place, whatever the shard's size."""
    want = [i for r in sorted(table(spark, DIR, "documents").collect(), key=lambda r: r.doc_id) for i in plain(r.text) + [2]]
    shards = tokenfile.write_shards(table(spark, DIR, "documents"), default_vocabulary(), shard_ids=20_000, path=f"file://{tmp_path}/shards")
    at, seen = {}, 0
    for r in shards.drop("payload").collect():
        at[r.part] = at.get(r.part, 0) + r.n_ids
    for name in sorted((tmp_path / "shards").glob("*.parquet")):
        with open(name, "rb") as file:
            rows = pq.read_table(name, columns=["part", "first", "n_ids"]).to_pylist()
            places = list(tokenfile.payload_places(file))
            assert len(places) == len(rows)
            for row, (offset, _) in zip(rows, places, strict=True):
                reads = []

                def read(a, n, file=file, offset=offset, reads=reads):
                    reads.append(n)
                    file.seek(offset + a)
                    return file.read(n)

                reader = tokenfile.Reader(read)
                start = row["first"] + sum(n for p, n in at.items() if p < row["part"])
                for i in range(0, row["n_ids"], 997):
                    reads.clear()
                    assert reader[i] == want[start + i]
                    assert sum(reads) < 300
                seen += 1
    assert seen > 5


def test_best_two_fit():
    # greedy takes 6, then 3; the two 2s fill the gap of 4 better than 3
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)
    # a bin of one: 7 leaves a gap that nothing fits, 6 and 4 fill the whole of it
    assert packing.best_two_fit({7: 1, 6: 1, 4: 1}, 10)[0] == ([4, 6], 1)
    rng = random.Random(8)
    for cap in (10, 100, 2048):
        counts = Counter(min(cap, int(rng.lognormvariate(4, 1)) + 1) for _ in range(3000))
        plan = packing.best_two_fit(counts, cap)
        used = Counter()
        for bin_, times in plan:
            assert sum(bin_) <= cap and times > 0
            for n in bin_:
                used[n] += times
        assert used == counts
        least = -(-sum(n * c for n, c in counts.items()) // cap)
        assert sum(t for _, t in plan) <= 1.02 * least + 2
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def _check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, plain):
    rows = packing.op6_packing(spark, DIR).collect()
    used = _check(rows, 2048)
    want = []
    for r in table(spark, DIR, "documents").collect():
        ids = np.array(plain(r.text) + [0], "<u4")
        want += [(r.doc_id, k, k * 2048, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[i : i + 2048] for i in range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_odd_rows_and_sequences(spark, odd, nothing):
    packed = packing.pack_documents(odd, capacity=256, keep_ids=True)
    _check(packed.collect(), 256)
    out = packing.sequences(packed).withColumn("n", F.octet_length("ids")).collect()
    assert all(r.n == 4 * r.length for r in out)
    assert packing.pack_documents(nothing).count() == 0
