import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest

from cohera.llm import warc


def _pages(spark):
    big, other = "<p>" + "x" * 200, "<p>" + "y" * 200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "u3", big), (1, "u1", big), (2, "u2", other), (2, "u2", other), (5, "u5", "tiny"), (6, "u6", "tiny"), (7, None, None), (8, "u8", ""), (None, "u9", big), (10, "u\r\nX: 1", "é中" * 100)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string"), rows


def test_round_trip_and_revisits(spark, tmp_path):
    pages, rows = _pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.deduplicated_records(pages), path)
    back = {}
    for r in warc.read_warc(spark, path).collect():
        back.setdefault(r.record_id, []).append(r)
    assert sum(map(len, back.values())) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        for r in back[f"<urn:page:{'none' if i is None else i}>"]:
            assert r.payload_length == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
            assert bytes(r.payload or b"") == (raw if r.record_type == "response" else b"")
    kinds = {k: sorted(r.record_type for r in v) for k, v in back.items()}
    assert kinds["<urn:page:1>"] == ["response"] and kinds["<urn:page:3>"] == ["revisit"] and kinds["<urn:page:none>"] == ["revisit"]
    assert kinds["<urn:page:2>"] == ["response", "revisit"] and kinds["<urn:page:5>"] == kinds["<urn:page:6>"] == ["response"]
    assert back["<urn:page:3>"][0].refers_to == "<urn:page:1>"


def test_appending_keeps_earlier_archives(spark, tmp_path):
    pages, rows = _pages(spark)
    path = f"file://{tmp_path}/w"
    for _ in range(2):
        warc.write_warc(warc.deduplicated_records(pages), path)
    (tmp_path / "w" / "part-lost-attempt.warc.gz").write_bytes(b"left behind")
    assert warc.read_warc(spark, path).count() == 2 * len(rows)


def test_pushed_predicates_skip_payloads(spark, tmp_path):
    pages, _ = _pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.deduplicated_records(pages), path)
    df = warc.read_warc(spark, path).filter("record_type = 'revisit'")
    assert df.count() == 3
    assert "= revisit)" not in df._jdf.queryExecution().executedPlan().toString()  # the reader has taken it over
    assert warc.read_warc(spark, path, payload=False).filter("payload is not null").count() == 0
    tests = {"record_type": {"response"}}
    raw = warc.record({"record_id": "<a>", "record_type": "revisit", "target_uri": None, "payload_digest": None, "payload_length": 9, "refers_to": None, "payload": None})
    assert list(warc.read_members(_file(warc.member(raw)), tests, True, 0, len(warc.member(raw)))) == []


def test_a_large_archive_is_read_by_byte_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MARK_BYTES", 3_000)
    path = f"file://{tmp_path}/w"
    rows = [{"record_id": f"<{i}>", "record_type": "response" if i % 3 else "revisit", "target_uri": "u", "payload_digest": None, "payload_length": 700, "refers_to": None, "payload": random.Random(i).randbytes(700)} for i in range(100)]
    wrote = warc.WarcWriter(path, True).write([pa.RecordBatch.from_pylist(rows)])
    warc.WarcWriter(path, True).commit([wrote])
    assert len(wrote.marks) > 10
    reader = warc.WarcReader(path, 7_000, True)
    reader.tests = {"record_type": {"response"}}
    parts = reader.partitions()
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 5 and [(r["record_id"], r["payload"]) for r in got] == [(r["record_id"], r["payload"]) for r in rows if r["record_type"] == "response"]


def test_paths_take_the_scheme_that_spark_gives_them(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)).startswith("file:/")
    with pytest.raises(ValueError, match="scheme"):
        warc._store(str(tmp_path))


def test_payloads_are_not_shuffled(spark, sf_dir):
    """Verdicts come from narrow rows: the plan that writes the records exchanges none with a payload."""
    out = warc.deduplicated_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


class _file(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_other_layouts():
    rows = [{"record_id": f"<{i}>", "record_type": "response", "target_uri": "u", "payload_digest": None, "payload_length": 5000 * i, "refers_to": None, "payload": bytes(5000 * i)} for i in range(4)]
    raw = b"".join(map(warc.record, rows))
    for data, gz in ((raw, False), (gzip.compress(raw), True), (b"".join(gzip.compress(warc.record(r)) for r in rows), True), (b"".join(warc.member(warc.record(r)) for r in rows), True)):
        got = list(warc.records_of(_file(data), gz, {}, True)) if gz else list(warc.read_records(_file(data), {}, True, True, chunk=700))
        assert [r[-1] for r in got] == [r["payload"] for r in rows]
        none = list(warc.records_of(_file(data), gz, {}, False)) if gz else list(warc.read_records(_file(data), {}, False, True, chunk=700))
        assert [r[0] for r in none] == ["<0>", "<1>", "<2>", "<3>"] and all(r[-1] is None for r in none)


def test_empty(spark, tmp_path):
    pages, _ = _pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.deduplicated_records(pages.limit(0)), path)
    assert warc.read_warc(spark, path).count() == 0
