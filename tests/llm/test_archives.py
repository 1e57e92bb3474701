"""ARC files to WARC files and back."""

import base64
import gzip
import hashlib

import pytest

from quarry.llm import warc

PAGES = "page_id long, url string, html string"
FAKE = "<p>x</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nhttp://a/ 0.0.0.0 20240101000000 text/html 4\nabcd\nfiledesc://f 1 2 t 0\n"
ROWS = [
    (1, "http://a/", "one"), (2, "http://b/", "one"), (3, None, None), (4, "", ""), (5, "http://c/ d\né", FAKE), (6, "http://d/", "é" * 70000), (7, "x y", "one"),
    (7, "x y", "one"), (None, "http://n/", "one"), (None, "http://n/", "alone"), (-9, "http://m/", "é" * 70000),
]


def both_ways(spark, df, tmp_path, **kw):
    old, new = (f"file://{tmp_path}/{k}" for k in ("arc", "warc"))
    warc.write_arc(df, old, **kw)
    warc.write_warc(warc.convert(warc.archives(spark, old)), new, archive_bytes=kw.get("archive_bytes", 1 << 20))
    return warc.read_warc(warc.archives(spark, new))


def plain(rows):
    """The contract by hand: (page, bytes, digest, type, refers to), equal page ids of a payload in any order."""
    groups, out = {}, []
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    for body, pages in groups.items():
        told = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        pages = sorted(pages, key=lambda p: (p is not None, p or 0), reverse=True)
        out += [(p, *told, "revisit" if i else "response", pages[0] if i else None) for i, p in enumerate(pages)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("version", [1, 2, None])
def test_pages_come_back(spark, tmp_path, version):
    df = spark.createDataFrame(ROWS, PAGES).repartition(3)
    back = both_ways(spark, df, tmp_path, version=version, archive_bytes=100_000).collect()
    records = [r for r in back if r["type"] != "warcinfo"]
    assert not [r for r in back if r["problem"]]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in records), key=repr) == plain(ROWS)
    assert sorted(bytes(r["payload"]) for r in records if r["type"] == "response") == sorted({(h or "").encode() for _, _, h in ROWS})
    ids = {r["record_id"]: r for r in records}
    assert len(ids) == len(ROWS)
    for r in records:
        if r["type"] == "revisit":
            first = ids[r["refers_to_id"]]
            assert (first["type"], first["page_id"], first["payload_digest"]) == ("response", r["refers_to"], r["payload_digest"])


def test_groups_beyond_the_broadcast_give_the_same_records(spark, tmp_path):
    path = f"file://{tmp_path}/arc"
    warc.write_arc(spark.createDataFrame(ROWS, PAGES), path)
    files = warc.archives(spark, path)
    wide, narrow = (warc.convert(files, broadcast_groups=n).select("record_id", "type", "first.page_id").collect() for n in (0, 100))
    assert sorted(map(repr, wide)) == sorted(map(repr, narrow))
    short = warc.convert(files, min_bytes=4).filter("type = 'revisit'").collect()
    assert [r["page_id"] for r in short] == [-9]


def test_no_pages_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([], PAGES)
    assert both_ways(spark, df, tmp_path).filter("type <> 'warcinfo'").count() == 0
    wide = spark.createDataFrame([(1, "http://a/", "t", "clash", b"x")], f"{PAGES}, type string, content binary")
    assert [r["page_id"] for r in both_ways(spark, wide, tmp_path).filter("type = 'response'").collect()] == [1]


def legacy(version=b"1", records=(b"http://a/ 1.2.3.4 19980101123456 text/html 5\nh\xff\n\xe9o\n",)):
    about = version + b" 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
    return b"filedesc://t.arc 0.0.0.0 19980101000000 text/plain %d\n%s\n%s" % (len(about), about, b"".join(records))


def parsed(content):
    return [r for r in warc.parse_arc("t.arc", content) if r.get("type") != "warcinfo"]


def test_foreign_archives():
    (r,) = parsed(legacy())
    assert (r["type"], r["date"], r["payload"], r["ip"], r["page_id"]) == ("resource", "1998-01-01T12:34:56Z", b"h\xff\n\xe9o", "1.2.3.4", None)
    http = b"HTTP/1.0 200 OK\nX-Page-Id: 8\n\nbody"
    two = b"http://b/ 1.2.3.4 199801011234 text/html 200 - - 0 t.arc %d\n%s\n\n" % (len(http), http)
    (r,) = parsed(legacy(b"2", [two]))
    assert (r["type"], r["date"], r["payload"], r["page_id"], r["version"]) == ("response", "1998-01-01T12:34:00Z", b"body", 8, 2)
    members = gzip.compress(legacy(records=())) + gzip.compress(b"http://a b/ 1.2.3.4 19980101123456 text/html 0\n\n")
    (r,) = parsed(members)
    assert (r["url"], r["payload"]) == ("http://a b/", b"")


@pytest.mark.parametrize(
    "content, says",
    [
        (legacy(records=[b"http://a/ 1.2.3.4 19980101123456 text/html 50\nshort"]), "body of 5 bytes, 50 declared"),
        (legacy(records=[b"http://a/ 1.2.3.4 19980101123456 text/html many\n"]), "header without a length"),
        (legacy(records=[b"a 1 text/html 2\nxx\n"]), "4 header fields in version 1"),
        (legacy(records=[b"http://a/ 1.2.3.4 never text/html 2\nxx\n"]), "no date"),
        (b"http://a/ 1.2.3.4 19980101123456 text/html 2\nxx\n", "5 header fields in version 0"),
        (gzip.compress(legacy())[:-12], "broken compression"),
    ],
)
def test_damage_is_told(content, says):
    assert parsed(content)[-1]["problem"].startswith(says)


def test_unknown_version_and_nothing():
    assert next(warc.parse_arc("t", legacy(b"9")))["problem"] == "unknown version 9"
    assert list(warc.parse_arc("t", b"")) == [] and list(warc.parse_warc("t", None)) == []
    assert list(warc.parse_warc("t", b"nothing of the kind\r\n\r\n"))[0]["problem"] == "header without a length"
    row = {"type": "resource", "record_id": "urn:uuid:1", "date": None, "archive": "t", "url": "u", "ip": "i", "payload_digest": "WRONG", "payload_bytes": 2, "page_id": None, "head": b"", "payload": b"xx", "content_type": None}
    assert list(warc.parse_warc("t", warc.warc_record(row)))[0]["problem"] == "payload digest differs"


def test_archives_are_bounded(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "y" * 1000 + str(i)) for i in range(100)], PAGES).coalesce(1)
    warc.write_arc(df, f"file://{tmp_path}/arc", archive_bytes=10_000)
    files = warc.archives(spark, f"file://{tmp_path}/arc").collect()
    assert len(files) == 10 and all(len(gzip.decompress(f["content"])) < 13_000 for f in files)
    assert {r["version"] for r in warc.read_arc(warc.archives(spark, f"file://{tmp_path}/arc")).collect()} == {1, 2}
