import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def time():
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0)))


def fixture():
    rng = random.Random(4)
    big = ["é" * 600, "x" * 1000, "y" * 999, "WARC/1.1\r\n\r\n\r\n" * 200, "z" * 300_000]
    urls = ["http://a.example.com/x?b=1#f", "https://B.example.com", None, "", "no scheme", "http://a.example.com/\r\nX: y"]
    rows = [(i, rng.choice(urls), rng.choice(big + [f"page {i}" * 200])) for i in range(200)]
    rows += [(200, "u", None), (201, "u", ""), (None, "u", "x" * 1000), (None, None, "only null ids " * 100)]
    rows += [rows[3]] * 3 + [(500, "u", "x" * 1000)] * 2
    return rows


def brute(rows):
    top = defaultdict(int)
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top[h or ""], i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and (h or "") in top and (i is None or i < top[h or ""])
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response",
                    top[h or ""] if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", 9) for r in rows],
                                 "page_id long, url string, html string, digest string, n int")


def test_round_trip_and_global_order(spark):
    rows = fixture()
    got = warc.archive_and_index(pages(spark, rows).repartition(5), time(), file_bytes=2000) \
        .orderBy("range", "seq").collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got],
                  key=str) == brute(rows)
    order = [(r.urlkey, r.timestamp, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order) and len({r.file for r in got}) > 5
    assert [r.position for r in got] == list(range(1, len(rows) + 1))
    assert sorted(str(r.url) for r in got) == sorted(
        str(u if u is None else u.replace("\r", "%0D").replace("\n", "%0A")) for _, u, _ in rows)


def test_empty_table(spark):
    assert warc.archive_and_index(pages(spark, []), time()).collect() == []


def test_files_are_warc(spark, tmp_path):
    warc.write(pages(spark, [(1, "http://a.b/", "hi"), (2, None, "ho")]).coalesce(1), f"{tmp_path}/w", time())
    [file] = (tmp_path / "w").glob("part-*")
    packed = file.read_bytes()
    raw = gzip.decompress(packed)
    entries = list(warc.parse(file.read_bytes(), "f"))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n")
    assert sum(e[-1] for e in entries) == len(packed) and len(entries) == 2
    for e, payload in zip(entries, [b"hi", b"ho"]):  # a reader seeks by the index
        own = gzip.decompress(packed[e[-2]:e[-2] + e[-1]])
        assert own.startswith(b"WARC/1.1") and own.endswith(payload + b"\r\n\r\n")
    first, second = (gzip.decompress(packed[e[-2]:e[-2] + e[-1]]) for e in entries)
    broken = gzip.compress(first.replace(b"hi\r\n", b"ha\r\n"))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse(broken, "f"))
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.parse(gzip.compress(first) + gzip.compress(second[:-7]), "f"))
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.parse(packed[:-9], "f"))
    with pytest.raises(ValueError, match="left in a member"):
        list(warc.parse(gzip.compress(raw), "f"))


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(rng.choices(range(30), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_archive_may_end_with_any_byte():
    """A member of 16 MB or more may not end with the zero byte that the line
    separator gives: an empty member follows it."""
    import pyarrow as pa
    big = "WARC/1.1\r\nA: " + "x" * (17 << 20)
    [out] = warc._bundles(1)([pa.RecordBatch.from_arrays([pa.array([big])], names=["value"])])
    packed = out.column(0)[0].as_py() + b"\0"
    assert packed.endswith(warc.EMPTY_MEMBER) and gzip.decompress(packed) == big.encode() + b"\r\n\r\n"
    stream = warc._Stream(packed)
    assert stream.member() and stream.until(b"\r\n\r\n") and stream.close() == len(packed) - len(warc.EMPTY_MEMBER)
    assert not stream.member()


def test_equal_keys_are_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    rows = [(None, "http://a.b/", f"text {k % 3}") for k in range(400)]
    got = warc.archive_and_index(pages(spark, rows).repartition(8), F.timestamp_seconds(F.lit(0)), file_bytes=500)
    sizes = [r["count"] for r in got.groupBy("range").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 200
    assert sorted(r.position for r in got.collect()) == list(range(1, 401))
