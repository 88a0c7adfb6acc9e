import base64
import hashlib
import random

from sextant.llm import warc
from sextant.llm.queries import QUERIES


def expected(rows, least=0):
    top = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= least:
            top[b] = max(top.get(b, i), i)
    out = {}
    for i, url, html in rows:
        b = (html or "").encode()
        to = top.get(b, i)
        out[i] = (url, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to == i else "revisit", None if to == i else to)
    return out


def test_round_trip(spark):
    rnd = random.Random(4)
    bodies = [None, "", "<p>é\r\n\r\nü</p>", "x" * 300_000, *(f"<b>{rnd.random()}</b>" * rnd.randrange(1, 2000) for _ in range(30))]
    rows = [(i, None if i % 17 == 0 else f"http://h/{i}", rnd.choice(bodies)) for i in range(200)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, offset int")
    for least in (0, 50):
        index, folder = warc.write_archives(df, min_bytes=least, roll=100_000)
        got = warc.read_archives(index, folder, gap=1000, most=50_000, payload=True).collect()
        want = expected(rows, least)
        assert {r.page_id: (r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
        assert len(got) == len(rows)
        texts = {i: html or "" for i, _, html in rows}
        assert all(r.payload == (texts[r.page_id] if r.record_type == "response" else None) for r in got)
        some = index.filter("page_id % 50 = 3")
        assert {r.page_id for r in warc.read_archives(some, folder).collect()} == {3, 53, 103, 153}


def test_edges(spark):
    df = spark.createDataFrame([(None, "u", "a"), (1, "u\r\nv", "a"), (1, "u\r\nv", "a")], "page_id long, url string, html string")
    index, folder = warc.write_archives(df)
    assert [(r.page_id, r.url, r.record_type) for r in warc.read_archives(index, folder).collect()] == [(1, "u%0D%0Av", "response")]
    index, folder = warc.write_archives(df.limit(0))
    assert warc.read_archives(index, folder).collect() == []


def test_oracle(spark, same):
    sf = "/root/testdata/sf0.001"
    same(QUERIES["op3_warc"](spark, sf), warc.ORACLE, sf_dir=sf)
