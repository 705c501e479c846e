"""Asset files: round trips, metadata scans, refused files."""

import hashlib

import pytest

from tidemark.sources import assets
from tidemark.sources.formats import FormatError

CHUNKS = {"b": [(b"12345", 1, 0, 40, True), (b"67", 0, 40, 0, False)], "a": [(b"x" * 9, 2, 0, 80, True)]}


def test_round_trip_and_scan(spark, tmp_path):
    data = assets.write_asset({"canvas": {"width": 4}}, CHUNKS)
    assert data == assets.write_asset({"canvas": {"width": 4}}, dict(reversed(CHUNKS.items())))
    _, manifest, records = assets.front_index(data)
    assert manifest["units"] == [{"chunks": 1, "id": "a"}, {"chunks": 2, "id": "b"}]
    assert records[0][0] % 8 == 0 and records[1][0] % 8 == 0 and records[2][0] == records[1][0] + 5
    (tmp_path / "one.bin").write_bytes(data)
    got = assets.read_assets(spark, str(tmp_path), digests=True).orderBy("ordinal").collect()
    assert [(r["unit"], r["byte_length"], r["sha256"]) for r in got] == [("a", 9, hashlib.sha256(b"x" * 9).hexdigest()), ("b", 5, hashlib.sha256(b"12345").hexdigest()), ("b", 2, hashlib.sha256(b"67").hexdigest())]


def test_metadata_scan_needs_no_payload(spark, tmp_path):
    data = assets.write_asset({}, CHUNKS)
    h, _, records = assets.front_index(data)
    (tmp_path / "cut.bin").write_bytes(data[: records[0][0]])
    assert assets.read_assets(spark, str(tmp_path)).count() == 3
    with pytest.raises(FormatError):
        assets.validate(data[:-1])
    assert h.file_bytes == len(data)


@pytest.mark.parametrize("at", [0, 8, 12, 16, 20, 24, 32, 48, 60])
def test_a_changed_header_is_refused(at):
    data = bytearray(assets.write_asset({}, CHUNKS))
    data[at] ^= 1
    with pytest.raises(FormatError):
        assets.validate(bytes(data))


def test_padding_and_first_chunks_are_checked():
    data = bytearray(assets.write_asset({}, CHUNKS))
    _, _, records = assets.front_index(bytes(data))
    data[records[0][0] + 9] = 1
    with pytest.raises(FormatError):
        assets.validate(bytes(data))
    with pytest.raises(FormatError):
        assets.write_asset({}, {"a": [(b"1", 1, 0, 1, False)]})
