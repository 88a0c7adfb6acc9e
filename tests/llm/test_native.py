import random

from sextant.llm import quality_rules, url_filter
from sextant.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \t\n", "one", "a b c d e f", "a b c d e a b c d e", "x " * 40, "l1 w\nl1 w\n\n \nl1 w\nL1 w\n", "é ü ß *** $$ | < > & % #",
    "tail \x0b\x0c\r end\u00a0kept", "w " * 3000 + "z", " ".join(f"k{i % 50}" for i in range(400)), "a b c d e f g h i j k l m n o p a b c d e q",
]


def test_oracles(spark, same):
    for name in ("op7_quality_rules", "op8_url_filters", "quality_ablations"):
        same(QUERIES[name](spark, SF), ORACLES[name], sf_dir=SF)


def test_rules_on_odd_texts(spark, same):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, words string")
    same(quality_rules.judge(quality_rules.ledger(df)), quality_rules.ORACLE, documents=("doc_id bigint, text varchar", rows))
    assert quality_rules.ledger(df.limit(0)).collect() == []
    assert quality_rules.ledger(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).count() == 2


def test_ablations(spark):
    rnd = random.Random(3)
    patterns = [rnd.randrange(32) for _ in range(500)]
    book = spark.createDataFrame([(p,) for p in patterns], "failed int")
    got = {(r.version, r.rule): (r.n_rejected, r.n_saved) for r in quality_rules.ablations(book).collect()}
    for v, mask in quality_rules.POLICIES.items():
        bad = [p for p in patterns if p & mask]
        assert got[v, None] == (len(bad), len(bad))
        for name, bit in quality_rules.BITS.items():
            if mask & bit:
                assert got[v, name] == (len(bad), sum(not p & mask & ~bit for p in bad))


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/7", "http://example.com/en/8", "https://a.Example.com/en/71?x#y", "http://example.net/de/8/", "http://sub.example.net/de/9",
    "http://xexample.net/de/8", "ftp://org/es/", "http://a.org?/es/", "http://a.org#x", "a://b://c/d", "http://www.q.io/p.html", "https://q.io/p/?utm_source=feed", "http://m.q.io/p", "http://q.io/P",
    "http://com/en/", "http://notcom/en/", "http://x.com/EN/",
]


def test_urls(spark, same):
    rows = list(enumerate(URLS)) + [(100, URLS[15]), (100, URLS[15])]
    df = spark.createDataFrame([(i, u, "c", "b") for i, u in rows], "page_id long, url string, canonical string, block string")
    expected = url_filter.ORACLE.replace("LEFT JOIN m ON c.page_id = m.page_id AND", "LEFT JOIN m ON c.page_id IS NOT DISTINCT FROM m.page_id AND")
    for blocks in (1, 1 << 16):  # with one block nearly all are possible hits; the join still decides
        same(url_filter.filter_urls(df, url_filter.feed_list(df), blocks=blocks), expected, pages=("page_id bigint, url varchar", rows))
    empty = df.limit(0)
    assert url_filter.filter_urls(empty, url_filter.feed_list(empty)).collect() == []
    assert url_filter.filter_urls(df, spark.createDataFrame([(None,)], "canonical string")).count() == len(rows)


def test_long_urls_and_a_hot_url(spark, same):
    long = "http://long.example.org/" + "a/" * 50_000
    rows = [(1, long), (2, long + "?utm_source=feed"), (3, long + "b")] + [(10 + i, "http://hot.io/p?utm_source=x" if i % 2 else "https://www.hot.io/p") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for blocks in (None, 4):
        got = url_filter.filter_urls(df, url_filter.feed_list(df), blocks=blocks)
        same(got, url_filter.ORACLE, pages=("page_id bigint, url varchar", rows))
