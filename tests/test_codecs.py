import hashlib
import struct
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from idledger.functions import ids
from idledger.sources.journal import Sidecar, decode_lines, encode_lines, expired_from_bytes, expired_to_bytes, read_expired, read_sidecars


def test_sidecar_round_trip(tmp_path):
    one = Sidecar((0x0123456789ABCDEF,), 64)
    data = one.to_bytes()
    assert struct.unpack("<I", data[-4:])[0] == zlib.crc32(data[:28]) == 0x7F251103
    one.write(str(tmp_path / "a.bloom"))
    assert Sidecar.read(str(tmp_path / "a.bloom")) == one


def test_sidecar_rejects():
    data = Sidecar((1, 2), 128).to_bytes()
    with pytest.raises(ValueError, match="checksum"):
        Sidecar.from_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(ValueError, match="^words"):
        Sidecar((), 64)
    with pytest.raises(ValueError, match="^path"):
        Sidecar((1,), 64).write("sidecar-only.bloom")


def test_expired_files(spark, tmp_path):
    keys = [(1, 2), ((1 << 64) - 1, 5), (1, 2)]
    data = expired_to_bytes(keys)
    assert expired_from_bytes(data) == keys[:2]
    assert expired_from_bytes(data[8:-4]) == keys[:2]
    for bad in (data[:-1] + b"\0", data[:-5], b"EXPD\2\0\0\0" + data[8:]):
        with pytest.raises(ValueError, match="^expired file"):
            expired_from_bytes(bad)
    (tmp_path / "a.bin").write_bytes(data)
    assert sorted(tuple(r) for r in read_expired(spark, str(tmp_path)).collect()) == [(-1, 5), (1, 2)]


def test_journal_lines(spark):
    rows = spark.createDataFrame([("<a@b>", "s")], "message_id string, server_id string").withColumn("created_at", F.timestamp_micros(F.lit(1_700_000_000_123_456)))
    hi, lo = ids.hash_halves(F.col("message_id"))
    line = encode_lines(rows.withColumns({"hash_hi": hi, "hash_lo": lo})).first()["value"]
    a, b, ticks, h, low = line.split("|")
    assert int(ticks) == 621355968000000000 + 17_000_000_001_234_560
    assert (int(h), int(low)) == struct.unpack("<QQ", hashlib.md5(b"<a@b>").digest())
    bad = [f"{a}|{b}|{ticks}|{h}", f"!{line}", f"{a}|{b}|x|{h}|{low}", "", f"|{b}|{ticks}|{h}|{low}", f"{a}|{b}|{ticks}|{1 << 64}|{low}"]
    got = decode_lines(spark.createDataFrame([(x,) for x in [line, f"{a}|{b}|{ticks}", *bad]], "value string")).collect()
    assert [r["is_valid"] for r in got] == [True, True] + [False] * len(bad)
    assert got[0]["hash_hi"] == got[1]["hash_hi"] and got[0]["message_id"] == "<a@b>"
    assert all(r["message_id"] is None for r in got[2:])


def mix(x):
    m = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def test_mix_and_bloom_bits(spark):
    rows = spark.createDataFrame([(ids.signed(v), ids.signed(v * 7919 % (1 << 64))) for v in (0, 1, 5, 1 << 63, (1 << 64) - 1, 0x9E3779B97F4A7C15)], "hi long, lo long")
    got = rows.select("hi", "lo", ids.mix64(F.col("lo")).alias("m"), ids.bloom_bits(F.col("hi"), F.col("lo"), 1 << 16).alias("bits")).collect()
    for r in got:
        hi, lo = r["hi"] % (1 << 64), r["lo"] % (1 << 64)
        assert r["m"] % (1 << 64) == mix(lo)
        h1, h2 = mix(lo), mix(hi ^ 0x9E3779B97F4A7C15) | 1
        assert list(r["bits"]) == [(h1 + i * h2) % (1 << 64) & 0xFFFF for i in range(7)]


def test_generated_ids(spark):
    r = spark.createDataFrame([(1000,), (7,)], "i long").select(ids.generated_message_id(F.col("i")).alias("m"), ids.generated_server_id(F.col("i")).alias("s")).collect()
    assert r[0]["m"].startswith("<00000000000003e8.08b37c993af4b208@")
    assert r[1]["s"] == "00000007-0000-0000-127c-4a7fb979379e" == str(uuid.UUID(bytes_le=struct.pack("<QQ", 7, 7 ^ ids.GOLDEN)))


def test_sidecar_table(spark, tmp_path):
    good = Sidecar((1, (1 << 64) - 1), 128)
    good.write(str(tmp_path / "a.idx"))
    (tmp_path / "b.idx").write_bytes(good.to_bytes()[:-1] + b"x")
    got = read_sidecars(spark, str(tmp_path)).select("word_idx", "word", "trusted").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, False), (0, 1, True), (1, -1, True)]


def test_telemetry():
    from idledger.sources import telemetry

    assert telemetry.process().resident_bytes > 0 and telemetry.installed_memory() > 1 << 20
    assert telemetry.bloom_budget(0.5, 7) == 7 and telemetry.bloom_budget(0.5) > 1 << 20
