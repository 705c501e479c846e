"""Formats round trip; streams give what batches give."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import machine
from tidemark.plans import catalog
from tidemark.sources import formats
from tidemark.streaming import machine as streaming

RECORDS = [(0, 10, 1, 0, 100, True), (10, 5, 0, 100, 100, False), (2**53 - 1, 2**32 - 1, 2, 2**53 - 1, 0, True)]


def test_index_round_trip_and_scan(spark, tmp_path):
    data = formats.encode_index(RECORDS)
    assert len(data) == 16 + 48 * 3
    (tmp_path / "a.idx").write_bytes(data)
    (tmp_path / "b.idx").write_bytes(formats.encode_index([]))
    got = formats.read_indexes(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [tuple(r)[2:8] for r in got] == RECORDS


@pytest.mark.parametrize("bad", [lambda d: d[:-1], lambda d: b"XXXX" + d[4:], lambda d: d[:60] + b"\x01" + d[61:], lambda d: d[:48] + b"\x02" + d[49:], lambda d: d[:10], lambda d: d[:16] + struct.pack("<Q", 2**53) + d[24:]])
def test_bad_indexes_are_refused(bad):
    with pytest.raises(formats.FormatError):
        formats.decode_index(bad(formats.encode_index(RECORDS)))


def test_permissive_scan_gives_errors(spark, tmp_path):
    (tmp_path / "a.idx").write_bytes(b"no index")
    assert formats.read_indexes(spark, str(tmp_path), failfast=False).first()["error"]


@pytest.mark.parametrize("bad", [b'{"a":1,"a":2}', b'{"__proto__":1}', b'\xef\xbb\xbf{}', b'{"a":9007199254740992}', b'{"a":NaN}', b"{", b"\xff"])
def test_strict_json(bad):
    with pytest.raises(formats.FormatError):
        formats.parse_json(bad)


def test_canonical_json():
    assert formats.canonical_json({"é": 1, "z": [1.0, 2.5], "a": None}) == '{"a":null,"z":[1,2.5],"é":1}'.encode()
    assert formats.parse_canonical(b'{"a":1}') == {"a": 1}
    with pytest.raises(formats.FormatError):
        formats.parse_canonical(b'{ "a":1}')


def test_samples_csv(spark, tmp_path):
    schema = "refresh long, black boolean, value long"
    good = tmp_path / "good.csv"
    good.write_text("refresh,black,value\n1,true,\n2,false,7\n")
    assert [tuple(r) for r in formats.read_samples(spark, str(good), schema, {"value"}).orderBy("refresh").collect()] == [(1, True, None), (2, False, 7)]
    for text in ("refresh,value,black\n1,2,true\n", "refresh,black,value\n01,true,1\n", "refresh,black,value\n1,TRUE,1\n", "refresh,black,value\n,true,1\n"):
        bad = tmp_path / "bad.csv"
        bad.write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            formats.read_samples(spark, str(bad), schema, {"value"}).collect()


def test_probe_text_and_sequences(spark, tmp_path):
    (tmp_path / "probe.txt").write_text("stream|index=0|rate=30000/1001\nframe|pts=0\nframe|pts=1001\n")
    got = formats.read_probe(spark, str(tmp_path / "probe.txt")).collect()
    assert [(r["section"], r["fields"].get("pts")) for r in got] == [("stream", None), ("frame", "0"), ("frame", "1001")]
    pictures = tmp_path / "p"
    pictures.mkdir()
    for k in (3, 4, 6):
        (pictures / f"f{k:04d}.png").write_bytes(b"x")
    assert tuple(formats.numbered_files(spark, str(pictures)).first()) == ("f", 3, 6, 3, False)


def test_ivf():
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 2, 2, 30, 1, 2, 0)
    body = b"".join(struct.pack("<IQ", len(p), t) + p for t, p in ((0, b"abc"), (7, b"")))
    assert formats.demux_ivf(head + body) == [(0, b"abc"), (7, b"")]
    with pytest.raises(formats.FormatError):
        formats.demux_ivf(head + body[:-1])


def test_verified(spark):
    rows = [(b"a", hashlib.sha256(b"a").hexdigest()), (b"b", "0"), (b"c", None)]
    good, bad = formats.verified(spark.createDataFrame(rows, "content binary, digest string"), "content", "digest")
    assert (good.count(), bad.count()) == (1, 2)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, s, kind, value, s % 3 != 0) for k in range(4) for s, (kind, value) in enumerate([("begin", None)] + [x for n in range(40) for x in ((("send", ["view", "click", "error", "purchase"][(n * 7 + k) % 4]) if n % 3 else ("request", ["idle", "hover", "busy"][(n + k) % 3])), ("tick", None))])]
    schema = "key long, seq long, kind string, value string, ready boolean"
    all_rows = spark.createDataFrame(rows, schema)
    for part in range(3):
        all_rows.where((F.col("seq") >= part * 30) & (F.col("seq") < part * 30 + 30)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    graph = catalog.sample_graph()
    stream = streaming.run_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), graph)
    query = stream.writeStream.format("memory").queryName("effects").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["key"], r["seq"], r["pos"])
    batch = sorted(machine.run(all_rows, graph).collect(), key=key)
    assert sorted(spark.table("effects").collect(), key=key) == batch and len(batch) > 100


def test_ring():
    ring = {"generation": 0, "items": []}
    step = lambda op, generation=0, item=None: streaming.ring_step(ring, op, generation, item, 2)[0]
    assert [step("take"), step("put", 0, "a"), step("put", 0, "b"), step("put", 0, "c"), step("put", 1, "d"), step("next"), step("put", 0, "e"), step("put", 1, "f"), step("take"), step("take")] == ["underflow", "stored", "stored", "full", "future", "opened", "stale", "stored", "taken", "underflow"]


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp_ntz, event_type string, value double"
    spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 05:00:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT TIMESTAMP_NTZ'2024-01-05 05:00:00', 'a', 2.0D").coalesce(1).write.parquet(f"{tmp_path}/w")
    out = streaming.windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/w"))
    q = out.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["n"], r["total"]) for r in spark.table("windows").collect()] == [(1, 1.0)]


SCHEMA = {"version": str, "units": [{"id": str, "frames": int, "note?": str}]}


def test_closed_documents(spark, tmp_path):
    good = '{"version": "1", "units": [{"frames": 2, "id": "a"}]}'
    bad = ['{"version": "1"}', '{"version": "1", "units": [], "more": 1}', '{"version": 1, "units": []}', '{"version": "1", "units": [{"id": "a", "frames": true}]}', '{"version": "1", "version": "2", "units": []}']
    for k, text in enumerate([good, *bad]):
        (tmp_path / f"{k}.json").write_text(text)
    got = [(r["canonical"], r["error"] is None) for r in formats.read_documents(spark, str(tmp_path), SCHEMA).orderBy("path").collect()]
    assert got == [('{"units":[{"frames":2,"id":"a"}],"version":"1"}', True)] + [(None, False)] * 5


def test_fixed_point():
    grow = lambda v, data: {"size": len(data)}
    assert formats.stable({"size": 0}, formats.canonical_json, grow, 5) == ({"size": 11}, b'{"size":11}')
    with pytest.raises(formats.FormatError):
        formats.stable(0, formats.canonical_json, lambda v, d: v + 1, 5)
