"""Raw binary profiles: shares of a file, bounded files, broken ones, failed writes."""

import struct
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowlens.sources import raw_profiles, readers, sinks

SHAPE = "fn string, hash decimal(20,0), counters array<decimal(20,0)>"


def found(df):
    return sorted((r.fn, int(r.hash), [int(c) for c in r.counters]) for r in df.where("error IS NULL").collect())


ROWS = [(f"função {i}" if i % 3 else "", 2**64 - 1 - i, [2**63 + i] * (i % 5)) for i in range(200)]


def frame(spark, rows=ROWS, parts=3):
    return spark.createDataFrame([(f, Decimal(h), [Decimal(c) for c in cs]) for f, h, cs in rows], SHAPE).repartition(parts)


@pytest.mark.parametrize("width,order", [(64, "little"), (64, "big"), (32, "little"), (32, "big")])
def test_round_trip(spark, tmp_path, width, order):
    sinks.write_raw_profile(frame(spark), str(tmp_path / "p"), width, order)
    files = list((tmp_path / "p").glob("[!_.]*"))
    assert len(files) == 3 and all(f.read_bytes()[:8] == raw_profiles.magic(raw_profiles.ORDERS[order], width) for f in files)
    assert found(readers.read_raw_profiles(spark, str(tmp_path / "p"))) == sorted(ROWS)


def test_a_file_is_read_in_shares_and_written_in_bounded_files(spark, tmp_path, monkeypatch):
    df = frame(spark, parts=1)
    raw_profiles.register(spark)
    df.write.format("rawprofile").option("fileBytes", 1000).mode("append").save(str(tmp_path / "many"))
    sizes = [f.stat().st_size for f in (tmp_path / "many").glob("*.raw")]
    assert len(sizes) > 10 and max(sizes) <= 1000 + raw_profiles.HEADER
    assert found(readers.read_raw_profiles(spark, str(tmp_path / "many"))) == sorted(ROWS)
    df.write.format("rawprofile").mode("append").save(str(tmp_path / "one"))
    shares = spark.read.format("rawprofile").option("splitBytes", 500).load(str(tmp_path / "one"))
    assert shares.rdd.getNumPartitions() > 20 and found(shares) == sorted(ROWS)
    monkeypatch.setattr(raw_profiles, "READ", 64)
    source = raw_profiles.Reader(str(tmp_path / "one"), 700)
    rows = [r for s in source.partitions() for b in source.read(s) for r in b.to_pylist()]
    assert sorted((r["fn"], int(r["hash"]), [int(c) for c in r["counters"]]) for r in rows) == sorted(ROWS)


def test_overwrite_append_and_leftovers(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_raw_profile(frame(spark), path)
    sinks.write_raw_profile(frame(spark, ROWS[:2]), path, mode="append")
    assert found(readers.read_raw_profiles(spark, path)) == sorted(ROWS + ROWS[:2])
    (tmp_path / "p" / "_lost.raw").write_bytes(b"half a file of a lost attempt")
    assert len(found(readers.read_raw_profiles(spark, path))) == len(ROWS) + 2
    sinks.write_raw_profile(frame(spark, ROWS[:5]), path, 32, "big")
    assert found(readers.read_raw_profiles(spark, path)) == sorted(ROWS[:5])
    sinks.write_raw_profile(frame(spark, []), path)
    assert readers.read_raw_profiles(spark, path).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    bad = frame(spark).select("fn", F.when(F.length("fn") > 0, F.col("hash")).alias("hash"), "counters")
    negative = frame(spark).select("fn", (-F.col("hash")).cast("decimal(20,0)").alias("hash"), "counters")
    for df in (bad, negative):
        with pytest.raises(PySparkException):
            sinks.write_raw_profile(df, path, mode="append")
        assert list((tmp_path / "p").glob("*.raw")) == []


def test_broken_files(spark, tmp_path):
    head = raw_profiles.magic("<", 64)
    record = struct.pack("<IIQQQ", 1, 1, 5, 0, 0)
    files = {
        "magic": b"nonsense", "empty": b"", "header": head + b"\0" * 40, "data": head + struct.pack("<6Q", 1, 9, 9, 9, 0, 0) + record, "huge": head + struct.pack("<6Q", 1, 2**63, 2**63, 9, 0, 0),
        "record": head + struct.pack("<6Q", 1, 2, 1, 1, 0, 0) + record + struct.pack("<IIQQQ", 1, 2, 6, 0, 0) + struct.pack("<Q", 7) + b"a",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = readers.read_raw_profiles(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/")[-1], r.error) for r in rows if r.error) == [
        ("data", "truncated data"), ("empty", "bad magic"), ("header", "truncated header"), ("huge", "truncated data"), ("magic", "bad magic"), ("record", "malformed record"),
    ]
    assert [(r.fn, r.counters) for r in rows if not r.error] == [("a", [7])]
