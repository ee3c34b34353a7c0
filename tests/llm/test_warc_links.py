import base64
import gzip
import hashlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from portolan.llm import links, warc

PAGES = "page_id long, url string, html string"


def read(data):
    return list(warc.records(io.BytesIO(data)))


def test_round_trip_of_records():
    blocks = [b"", b"hello", bytes(range(256)) * 1000, "é ü 😀".encode()]
    data = b"".join(warc.record(b, f"http://h/{i}", i) for i, b in enumerate(blocks))
    got = read(data)
    assert [r["block"] for r in got] == blocks and {r["status"] for r in got} == {"ok"}
    assert [r["page_id"] for r in got] == [0, 1, 2, 3] and got[1]["uri"] == "http://h/1" and got[0]["offset"] == 0
    again = [next(warc.records(io.BytesIO(data[r["offset"] :])))["block"] for r in got]
    assert again == blocks  # any record can be read from its offset


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_small_reads(size):
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(size)

    data = b"".join(warc.record(b"x" * n, None, None) for n in (0, 10, 1000))
    got = list(warc.records(Slow(data)))
    assert [r["content_length"] for r in got] == [0, 10, 1000] and all(r["status"] == "ok" and r["uri"] is None for r in got)


def member(text):
    return gzip.compress(text)


def test_faults_are_told_apart_and_reading_goes_on():
    good = warc.record(b"good", "http://g/", 1)
    wrong = member(b"WARC/1.0\r\nContent-Length: 3\r\nWARC-Block-Digest: sha1:AAAA\r\n\r\nabc\r\n\r\n")
    plain = member(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    short = member(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    long = member(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n")
    none = member(b"no header at all")
    got = read(wrong + plain + short + long + none + good)
    assert [r["status"] for r in got] == ["digest_mismatch", "no_digest", "length_mismatch", "length_mismatch", "malformed", "ok"]
    broken = bytearray(good)
    broken[len(good) // 2] ^= 0xFF
    got = read(bytes(broken) + good)
    assert got[0]["status"] == "corrupt" and got[-1]["status"] == "ok" and got[-1]["block"] == b"good"
    got = read(b"garbage" + good)
    assert [r["status"] for r in got] == ["corrupt", "ok"]
    got = read(good + good[:-9])
    assert [r["status"] for r in got] == ["ok", "truncated"]
    assert read(b"") == []


def test_digests_of_other_writers():
    """Payload digests, other algorithms and encodings, header names in any case."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    body = b"<p>hi</p>\r\n\r\nmore"

    def made(lines, block, kind="response"):
        head = "\r\n".join(["WARC/1.1", f"warc-type: {kind}", *lines, f"content-length: {len(block)}"])
        return member(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    b32 = lambda name, x: base64.b32encode(hashlib.new(name, x).digest()).decode()
    msg = "Content-Type: application/http; msgtype=response"
    whole = http + body
    cases = [
        (made([msg, f"WARC-Payload-Digest: sha1:{b32('sha1', body)}"], whole), "ok"), (made([msg, f"WARC-Payload-Digest: sha1:{b32('sha1', whole)}"], whole), "digest_mismatch"),
        (made([f"WARC-Block-Digest: sha256:{hashlib.sha256(whole).hexdigest()}"], whole), "ok"), (made([f"WARC-Block-Digest: SHA-256:{b32('sha256', whole)}"], whole), "ok"),
        (made([f"WARC-Block-Digest: sha1:{base64.b64encode(hashlib.sha1(whole).digest()).decode()}"], whole), "ok"), (made([f"WARC-Block-Digest: sha256:{'0' * 64}"], whole), "digest_mismatch"),
        (made([f"WARC-Block-Digest: blake9:{'0' * 64}"], whole), "no_digest"), (made([msg, f"WARC-Block-Digest: sha1:{b32('sha1', whole)}", f"WARC-Payload-Digest: md5:{'0' * 32}"], whole), "digest_mismatch"),
        (made([msg, f"WARC-Block-Digest: sha1:{b32('sha1', http)}", f"WARC-Payload-Digest: sha1:{b32('sha1', body)}"], http, "revisit"), "ok"), (made([f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest()}"], body, "resource"), "ok"),
    ]
    got = read(b"".join(x for x, _ in cases))
    assert [r["status"] for r in got] == [s for _, s in cases] and got[0]["block"] == whole


def test_members_without_an_end_of_header():
    long = member(b"WARC/1.0\r\n" + b"X: y\r\n" * 400_000)
    junk = member(b"\x00" * 50_000_000)
    assert [r["status"] for r in read(long + junk + warc.record(b"a", None, 1))] == ["malformed", "malformed", "ok"]


def test_table_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (1, "http://a/", "<p>é</p>"), (2, None, "x"), (None, "http://b/\r\nEvil: 1", "y"), (4, "http://c/", None), (5, "http://d/", "z" * 3_000_000), (6, "", ""), (2**60 + 1, "http://e/", "big")]
    df = spark.createDataFrame(rows, PAGES).withColumn("block", F.lit(1)).withColumn("status", F.lit("mine"))
    got = sorted(map(str, map(tuple, warc.round_trip(spark, df).select("page_id", "url", "html", "status").collect())))
    want = sorted(str((k, u, t or "", "ok")) for k, u, t in rows)
    assert got == want
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def page(i, url, *to):
    return (i, url, "".join(f'<a class=x href="{t}">t</a>' for t in to))


def brute(edges, seeds, p):
    """Scores by host in units of a seed's share, with plain dicts."""
    unit = 1 - p.damping
    out = {}
    for kind in (0, 1):
        e = edges if kind == 0 else [(b, a) for a, b in edges]
        start = {h: unit for h, k in seeds.items() if k == kind}
        score = dict(start)
        for _ in range(p.rounds):
            new = dict(start)
            for a in score:
                to = [y for x, y in e if x == a]
                for y in to:
                    new[y] = new.get(y, 0) + p.damping * score[a] / len(to)
            score = new
        for h, s in score.items():
            out.setdefault(h, [0.0, 0.0])[kind] = s / unit
    return out


def test_links_same_as_brute_force_and_sql(spark):
    rows = [
        page(1, "https://good.org/a", "https://friend.com/x", "http://other.net/", "/relative", "#top"), page(2, "http://friend.com:80/", "http://other.net/y", "//www.friend.com/z"), page(3, "http://bad-casino.com/", "http://good.org/"),
        page(4, "http://farm.com/", "http://bad-casino.com/1", "http://bad-casino.com/2"), page(5, "http://mixed.com/", "http://bad-casino.com/", "http://good.org/", "http://friend.com/"), page(6, "http://alone.com/"), page(7, "http://www.farm.com/p"),
        page(8, None, "http://good.org/"), (9, "http://farm.com/", None), page(10, "no url", "http://good.org"), page(4, "http://farm.com/", "http://bad-casino.com/1"),
    ]
    p = links.LinkParams()
    df = spark.createDataFrame(rows, PAGES)
    out = links.filter_urls(df.withColumn("src", F.lit(1)).withColumn("score", F.lit(2)).withColumn("kept", F.lit("old")))
    got = {r["page_id"]: r for r in out.collect()}
    edges = sorted({("good.org", "friend.com"), ("good.org", "other.net"), ("friend.com", "other.net"), ("friend.com", "www.friend.com"), ("www.friend.com", "friend.com"), ("bad-casino.com", "good.org"), ("farm.com", "bad-casino.com"), ("mixed.com", "bad-casino.com"), ("mixed.com", "good.org"), ("mixed.com", "friend.com"), ("www.farm.com", "farm.com"), ("farm.com", "www.farm.com")})
    want = brute(edges, {"good.org": 0, "bad-casino.com": 1}, p)
    for r in got.values():
        t, d = want.get(r["host"], (0.0, 0.0))
        assert r["trust"] == pytest.approx(t) and r["distrust"] == pytest.approx(d), r
        assert (r["src"], r["score"]) == (1, 2)
    assert [k for k, r in sorted(got.items()) if not r["kept"]] == [3, 4, 5, 7, 9]
    assert got[8]["host"] is None and got[10]["host"] is None and out.count() == 11
    db = duckdb.connect()
    db.register("pages", df.toPandas())
    theirs = db.execute(links.filter_urls_sql()).fetchall()
    mine = [(r["page_id"], r["url"], r["host"], round(r["trust"], 6), round(r["distrust"], 6), r["kept"]) for r in out.collect()]
    assert sorted(map(str, mine)) == sorted(map(str, theirs))


def test_long_ways_and_cycles(spark):
    """Scores are settled: a cycle, a chain of 30 links to a blocked seed, and joins that give what one task gives."""
    names = [f"c{i}.com" for i in range(30)] + ["x-casino.com"]
    rows = [page(i, f"http://{a}/", f"http://{b}/") for i, (a, b) in enumerate(zip(names, names[1:]))]
    ring = ["r0.com", "r1.com", "r2.com"]
    rows += [page(100 + i, f"http://{a}/", f"http://{b}/") for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))] + [page(200, "http://uni.edu/", "http://r0.com/")]
    df = spark.createDataFrame(rows, PAGES)
    score = lambda p: {r["host"]: (r["trust"], r["distrust"]) for r in links.filter_urls(df, p).collect()}
    got, joined = score(links.LinkParams()), score(links.LinkParams(local_links=0, save_every=10))
    assert got.keys() == joined.keys()
    for h in got:
        assert got[h] == pytest.approx(joined[h], abs=1e-6)
    assert got["r0.com"][0] == pytest.approx(0.85 / (1 - 0.85**3), abs=1e-3)  # the limit
    assert got["c0.com"][1] == pytest.approx(0.85**30, rel=1e-6) and got["c29.com"][1] == pytest.approx(0.85)
    db = duckdb.connect()
    db.register("pages", df.toPandas())
    theirs = {h: (t, d) for _, _, h, t, d, _ in db.execute(links.filter_urls_sql()).fetchall()}
    for h in got:
        assert theirs[h] == pytest.approx(got[h], abs=2e-6)


def test_links_of_very_long_pages(spark):
    rows = [(1, "http://a.com/", "<p>word</p>" * 300_000 + '<a href="http://x-casino.com/">'), (2, "http://x-casino.com/", "")]
    assert {r["page_id"]: r["kept"] for r in links.filter_urls(spark.createDataFrame(rows, PAGES)).collect()} == {1: False, 2: False}


def test_links_empty(spark):
    assert links.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
