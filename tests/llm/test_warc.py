"""WARC round trips and index look-ups."""

import gzip
import hashlib
import os

from callweave.llm import warc

LONG, HTML = "<p>" + "é" * 60 + "</p>", "<html>" + "abc \r\n\r\n WARC/1.1\r\n" * 3000 + "</html>"
ROWS = [(5, "http://www.Example.com/a?b=1", LONG), (3, "http://example.com:8080/x", LONG), (3, "http://example.com:8080/x", LONG), (9, "http://example.com/x y\n\tz", "short"), (2, "http://example.com/s", "short"), (4, None, None), (6, "", ""), (None, "http://null.example/", LONG), (8, "http://a.example/", HTML), (7, "nonsense[://", HTML), (11, "http://bad.example:port/", "x" * 99), (12, "http://bad.example:port/", "x" * 99)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, digest string, size int").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    found = warc.read_archives(warc.read_captures(spark, path), path, payloads=True).collect()
    want = []
    for page_id, _, html in ROWS:
        raw = (html or "").encode()
        first = min((p for p, _, h in ROWS if h == html and p is not None), default=None) if len(raw) >= 100 else None
        revisit = first is not None and first != page_id
        want.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else raw))
    assert sorted([(*r[:5], r[5] and bytes(r[5])) if r[5] is None or r[5] else (*r[:5], b"") for r in map(tuple, found)], key=repr) == sorted(want, key=repr)
    files = [os.path.join(tmp_path, "w/archives", f) for f in os.listdir(tmp_path / "w/archives") if f.endswith(".gz")]
    assert sum(gzip.open(f).read().count(b"WARC-Record-ID: ") for f in files) == len(ROWS)

    urls = spark.createDataFrame([(u,) for _, u, _ in ROWS] + [("http://nowhere.example/",)], "url string")
    by_url = {}
    for r in warc.lookup(urls.distinct(), path).collect():
        by_url.setdefault(r["url"], []).append(r["page_id"])
    for url in {u for _, u, _ in ROWS}:
        assert sorted(by_url[url], key=str) == sorted((p for p, u, _ in ROWS if warc.key_of(u) == warc.key_of(url)), key=str)
    assert "http://nowhere.example/" not in by_url


def test_many_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 50}", f"page {i}") for i in range(600)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    captures = warc.read_captures(spark, path)
    warc.write_index(captures.selectExpr("key", "offset as page_id", "file", "offset", "length"), str(tmp_path / "small"), lines=10)
    got = warc.lookup(spark.createDataFrame([(u,) for u in {u for _, u, _ in rows}], "url string"), str(tmp_path / "small"))
    assert got.count() == 600
    assert captures.count() == 600
    by_key = lambda df: sorted(map(tuple, df.select("key", "file", "offset", "length").collect()))
    assert by_key(warc.captures_of(warc.keys_of(spark.createDataFrame(rows, "page_id long, url string, html string")), path)) == by_key(captures)


def test_a_key_over_many_blocks(spark, tmp_path):
    """Captures of one URL fill blocks of their own, and keys begin and end inside blocks."""
    rows = [(i, "http://often.example.com/" if i % 3 else f"http://h{i % 5}.example.com/{i % 11}", "same") for i in range(900)] + [(901, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    small = str(tmp_path / "small")
    captures = warc.read_captures(spark, path)
    warc.write_index(captures.selectExpr("key", "offset as page_id", "file", "offset", "length").repartition(3), small, lines=7)
    got = warc.captures_of(warc.keys_of(pages), small).select("key", "file", "offset").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, captures.select("key", "file", "offset").collect())) and len(got) == 901
    assert warc.captures_of(warc.keys_of(pages.where("url is null")), small).count() == 1
    assert warc.lookup(pages.where("false"), small).count() == 0


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(warc.read_captures(spark, path), path).count() == 0


def test_keys():
    assert warc.key_of("http://www.Example.com/A?b=1") == "com,example,www)/A?b=1"
    assert warc.key_of("https://example.com:443") == "com,example)/"
