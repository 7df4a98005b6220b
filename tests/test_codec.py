import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import codec

TOP = (1 << 63) - 1


def test_packing_order():
    def one(b):
        return codec.packed(np.frombuffer(b, np.uint8)).tolist()

    assert one(b"\x00\x00\x01") == [1] and one(b"\x01\x00\x00") == [0x10000]
    assert one(b"abc") < one(b"abd") and one(b"abz") < one(b"aca")


@pytest.mark.parametrize("ids", [[], [1], [1, 2, 3], [1, 200, 300000, 5_000_000_000], [TOP]])
def test_round_trip(ids):
    assert codec.decode_ids(codec.encode_ids(np.array(ids, dtype=np.int64))) == (ids, None)


def test_density():
    assert len(codec.encode_ids(np.arange(1, 1001))) == 1000


@pytest.mark.parametrize(
    ("data", "error"),
    [(b"\x80", "Truncated"), (b"\xff" * 11, "Overlong"), (b"\xff" * 9 + b"\x01", "Overflow"), (b"\x80" * 9 + b"\x7e", "Overlong"), (b"\x80" * 9 + b"\x01", "Overflow")],
)
def test_damage(data, error):
    assert codec.decode_ids(data) == (None, error)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, TOP), max_size=30))
def test_round_trip_any(ids):
    ids = sorted(ids)
    assert codec.decode_ids(codec.encode_ids(np.array(ids, dtype=np.int64))) == (ids, None)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_decoding_never_fails(data):
    ids, error = codec.decode_ids(data)
    assert (ids is None) != (error is None)


def _hash(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def test_columns(spark):
    rows = [(1, "abcabc", [1, 3, 5, 7], [3, 4, 5, 8]), (2, "ab", [], [1]), (3, None, [1, 3], [2, 3]), (4, "", [1, 2, 3], [2])]
    df = spark.createDataFrame(rows, "k int, s string, a array<long>, b array<long>")
    out = {r["k"]: r for r in df.selectExpr("*").select("*", codec.trigrams("s").alias("t"), codec.fnv1a64("s").alias("h"), codec.intersected(df.a, df.b).alias("i"), codec.merged(df.a, df.b).alias("m"), codec.merge_changes(df.a, df.b).alias("c"), codec.encoded_size(df.a).alias("n"), codec.encode_postings("a").alias("e")).collect()}
    assert out[1]["t"] == [0x616263, 0x626361, 0x636162] and out[2]["t"] == [] and out[3]["t"] is None
    assert out[1]["h"] == _hash(b"abcabc") and out[4]["h"] == _hash(b"") and out[3]["h"] is None
    assert out[1]["i"] == [3, 5] and out[2]["i"] == [] and out[3]["m"] == [1, 2, 3]
    assert out[3]["c"] and not out[4]["c"]
    assert all(len(r["e"]) == r["n"] for r in out.values())


def test_large_blob_equals_brute_force(spark):
    chance = np.random.default_rng(1)
    data = chance.integers(32, 96, 300 * 1024, dtype=np.uint8).tobytes()
    got = spark.createDataFrame([(bytearray(data),)], "s binary").select(codec.trigrams("s").alias("t")).first()["t"]
    assert got == sorted({int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)})


def test_sql_names_and_damage(spark):
    codec.register(spark)
    row = spark.sql("select trigrams('abcd') as t, decode_postings(unhex('80')) as d, decode_postings(encode_postings(array(1L, 9L))) as e, decode_postings(null) as n").first()
    assert row["t"] == [0x616263, 0x626364] and row["d"]["error"] == "Truncated" and row["e"]["ids"] == [1, 9] and row["n"]["ids"] is None


def test_decoded_lists_take_few_bytes_an_id():
    lists = [np.cumsum(np.full(10_000, 1 + k)) for k in range(100)]
    blobs = pa.array([codec.encode_ids(x) for x in lists], pa.binary())
    tracemalloc.start()
    ids, error = codec.decoded(blobs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.to_pylist() == [x.tolist() for x in lists] and error.null_count == len(lists)
    # objects take 32 bytes an id, and 8 for the list
    assert peak < 24 * 1_000_000


def test_encoded_lengths_of_slices_nulls_and_empty_lists():
    lists = [[5], [], None, [1, 200, 300000, 5 * 10**9], [(1 << 63) - 1], list(range(1, 1001))]
    column = pa.array(lists, pa.list_(pa.int64()))
    expected = [None if x is None else len(codec.encode_ids(np.array(x, dtype=np.int64))) for x in lists]
    assert codec.encoded_size.func(column).to_pylist() == expected
    assert codec.encoded_size.func(column[3:]).to_pylist() == expected[3:]
    assert codec.encoded_size.func(column[:0]).to_pylist() == []
