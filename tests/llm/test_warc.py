import gzip
import hashlib
import random

import pytest

from tidelog.llm import warc


def want(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= 100 else None
        again = f is not None and f != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 8, 30):
        runs = [sorted(((i * 100 + j, "u", rng.choice("abc"), rng.choice("xy"), 0, "", "", None, str(i), j, 0) for j in range(rng.randint(0, 9))), key=warc.order) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted((x for r in runs for x in r), key=warc.order)
    with pytest.raises(ValueError):
        list(warc.LoserTree([runs[-1] + runs[-1][:1], [*reversed(max(runs, key=len))]]))


def test_url_key():
    assert warc.url_key("https://m.Site.example:80/a?b=1#c") == "example,site,m:80)/a?b=1"
    assert warc.url_key("") == "" and warc.url_key("http://h") == "h)/"


def test_odd_pages(spark):
    big = "ä" * 60
    rows = [(5, "http://b.example/x", big), (2, "http://a.example/", big), (3, None, None), (4, "u r\nl", ""), (9, "http://a.example/", "WARC/1.1\r\n\r\nx\r\n\r\n" * 20), (2, "http://a.example/", big), (None, "http://n", big), (7, "", "s"), (8, "", "s")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.index(df)
    assert rows_of(got) == want(rows)
    keys = [(r.url_key, r.captured) for r in got.collect()]
    assert keys == sorted(keys)
    assert warc.index(df.limit(0)).count() == 0


ORDER = "url_key", "captured", "page_id"


def test_large_ids_odd_urls_and_large_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "MERGE_ROWS", 7)
    monkeypatch.setattr(warc, "DECODED", 2)
    urls = ["http://a.example/b%20c%2Fd", "http://a.example/100%25", "http://a.example/a b\t%zz+é\n", "%", "http://b.example/?q=%E4%BD%A0", " x ", "+", "a%0D%0Ab"]
    rows = [((-1) ** i * (2**62 + i), u, f"<p>{i}</p>") for i, u in enumerate(urls)]
    rows += [(2**63 - 1, "http://c.example", "y" * 5_000_000), (-(2**63), "http://c.example", "y" * 5_000_000), (10**13, None, "z" * 300_000), (253402300800, "u", None)]
    rows += [(i, f"http://h{i % 3}.example/{i % 5}", "w" * (i % 7) * 40) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/archives"
    out = warc.index(df, path)
    got = out.collect()
    assert rows_of(out) == want(rows)
    assert {(r.page_id, r.url) for r in got} == {(p, u or "") for p, u, _ in rows} and all(r.url_key == warc.url_key(r.url) for r in got)
    assert all(len(r.captured) == 20 and r.captured.startswith("20") for r in got)
    keys = [tuple(r[c] for c in ORDER) for r in got]
    assert keys == sorted(keys)
    packed = [len(gzip.decompress(bytes(r.content))) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()]
    assert max(packed) < 5_010_000 and len(packed) > 3


def test_capture_times_given(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "u", "a", 0), (2, "u", "b", -(10**12)), (3, "u", "c", None), (4, "t", "d", 86400)], "page_id long, url string, html string, s long")
    got = [(r.page_id, r.captured) for r in warc.index(df, captured=F.timestamp_seconds("s")).collect()]
    assert got == [(4, "1970-01-02T00:00:00Z"), (1, "1970-01-01T00:00:00Z"), (2, "1970-01-01T00:00:00Z"), (3, "1970-01-01T00:00:00Z")]


def test_damage():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parsed(good * 2))) == 2
    for bad in (good[:-3], good[5:], good + b"x"):
        with pytest.raises(ValueError):
            list(warc.parsed(bad))
    assert gzip.decompress(gzip.compress(good)) == good


def test_query(spark):
    from tidelog.llm import queries

    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(queries.QUERIES["op6_warc"](spark, path)) == want(rows)
