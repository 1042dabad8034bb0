import gzip
import hashlib
import uuid

import pyarrow.fs as pafs
import pytest

from llm_cases import save
from rebound.llm import warc
from rebound.session import checkpoint_dir

PAGES = "page_id long, url string, html string"


def page_rows():
    big = "<html>" + "x" * 300000 + "</html>"
    rows = [(i, f"http://h{i % 3}.example/p {i}\r\nX: y", f"<p>page {i}</p>" * 20, ) for i in range(40)]
    rows += [(50, None, None), (51, "", ""), (52, "u", "<p>é🙂\r\n\r\nWARC/1.1\r\n\r\n</p>" * 9), (53, "u", big), (60, "v", big), (49, "w", big),
             (70, "s", "short"), (71, "s", "short"), (72, "t", "y" * 99), (73, "t", "y" * 99), (74, "t", "y" * 100), (75, "t", "y" * 100),
             (75, "t", "y" * 100), (None, "n", "y" * 100), (None, None, None)]
    return rows


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        h = h or ""
        n = len(h.encode())
        again = n >= 100 and i is not None and i > first[h]
        out.append((i, n, hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(page_rows(), PAGES).select("*", F.lit("other").alias("digest"), F.lit(1).alias("refers_to"), F.lit(2).alias("bytes"))
    got = sorted((tuple(r) for r in warc.op8_member_index(spark, save(spark, df, tmp_path / "a", "pages")).collect()), key=repr)
    assert got == brute(page_rows())
    assert warc.op8_member_index(spark, save(spark, spark.createDataFrame([], PAGES), tmp_path / "e", "pages")).count() == 0


def test_every_member_is_a_record_of_its_own(spark):
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    done = warc.archive_pages(spark.createDataFrame(page_rows(), PAGES), folder).collect()
    fs, _ = pafs.FileSystem.from_uri(folder)
    seen = 0
    for r in done:
        data = fs.open_input_file(r["archive"]).read()
        at = 0
        for line in fs.open_input_file(r["idx"]).read().decode().splitlines():
            offset, length, name, kind = line.split()
            assert int(offset) == at
            record = gzip.decompress(data[at:at + int(length)])
            assert record.startswith(b"WARC/1.1\r\n") and b"\r\nWARC-Type: " + kind.encode() + b"\r\n" in record
            assert name.encode() in record and record.endswith(b"\r\n\r\n") and (kind == "response") == (b"WARC-Refers-To" not in record)
            at += int(length)
            seen += 1
        assert at == len(data)
    assert seen == len(page_rows())


def test_archives_roll_over(spark):
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    whole = warc.write_archives(spark.createDataFrame(page_rows(), PAGES).coalesce(1), folder, archive_bytes=2000).collect()
    by = {}
    for r in whole:
        by.setdefault(r["archive"], []).append(r["nth"])
    assert len(by) > 5 and len(whole) == len(page_rows()) and all(v == list(range(len(v))) for v in by.values())


def test_normaliser_reads_whole_and_member_streams_in_any_pieces():
    records = [warc.response(i, "http://a/", b"p" * (i * 37), "0" * 64) for i in range(30)]
    records = [r if i % 3 else warc.as_revisit(r, 0) for i, r in enumerate(records)]
    raw = b"".join(records)
    for data in (gzip.compress(raw), b"".join(map(gzip.compress, records))):
        for step in (1, 7, 1000, len(data)):
            pieces = (data[i:i + step] for i in range(0, len(data), step))
            assert [d for _, d in warc.split_records(warc.inflate(pieces))] == records


def test_damage_is_noticed():
    data = warc.response(1, "u", b"payload" * 30, "0" * 64)
    with pytest.raises(ValueError):
        list(warc.split_records(iter([data[:-9]])))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"junk\r\nContent-Length: 0\r\n\r\n\r\n\r\n"])))
