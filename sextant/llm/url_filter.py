"""URL filtering: rules on host and path first, then a list of canonical URLs.

The list is counted and turned into a blocked Bloom filter: one 64-bit word per block, four bits of
one word per URL, a block for every four URLs (about 1 false hit in 100), up to ``MOST`` words, which
is what the broadcast can reach (16 MB). Longer lists than four times that fill the words, and more
rows pass. URLs that it passes as possible hits go to an exact hash join with the list, which
removes false positives; the others never move. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); a rule fits its host and all subdomains
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
LEAST, MOST, SALTS = 1 << 10, 1 << 20, 8
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, canonical). The canonical URL has no scheme, ``www.`` or
    ``m.``, query, fragment, final slash or ``.html``; it is null where there is no host."""
    at = F.expr("instr(coalesce(url, ''), '://')")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    out = pages.select("page_id", "url", rest.alias("rest")).select(
        "page_id",
        "url",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), _UPPER, _LOW).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    name = F.concat(F.regexp_replace("host", r"^(www|m)\.", ""), F.regexp_replace("path", r"(\.html)?/*$", ""))
    return out.withColumn("canonical", F.when(F.col("host") != "", name))


def best_rule(rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. ``rules`` is a short list kept in the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _bits(name: str, blocks: int) -> tuple[Column, Column]:
    """Block and four-bit mask of a URL; the mask reads its hash from ``_h``."""
    block = F.pmod(F.xxhash64(F.lit("block"), name), F.lit(blocks))
    mask = None
    for k in range(4):
        bit = F.expr(f"shiftleft(1L, cast(shiftright(_h, {6 * k}) & 63 as int))")
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return block, mask


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word): ``blocks`` rows at most."""
    block, mask = _bits("canonical", blocks)
    hashed = listed.select("canonical", F.xxhash64(F.lit("bits"), "canonical").alias("_h"))
    return hashed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed), one row for each input row.

    ``listed`` has the blocked URLs in ``canonical``, repeats and nulls allowed. Verdicts: that
    of the longest rule that fits, else block if the canonical URL is listed, else allow. A null
    url, or one without ``://``, has an empty host and path and is allowed; page_id may be null
    or repeated; other columns are not read. ``blocks`` overrides the filter's size.
    """
    names = listed.select("canonical").filter("canonical is not null").distinct()
    blocks = blocks or min(MOST, max(LEAST, 1 << (names.count() // 4).bit_length()))
    rule, verdict = best_rule(rules)
    block, mask = _bits("canonical", blocks)
    rows = parsed(pages).withColumn("_h", F.xxhash64(F.lit("bits"), "canonical")).withColumn("block", block).withColumn("mask", mask)
    rows = rows.join(F.broadcast(bloom(names, blocks)), "block", "left")
    maybe = F.coalesce(F.expr("canonical is not null and word & mask = mask"), F.lit(False))
    keep = ["page_id", "host", "path", "canonical"]
    far = rows.filter(~maybe).select(*keep).withColumn("listed", F.lit(False))
    # a listed URL may be that of a third of all pages: its rows are dealt out over the salts
    salted = names.select("canonical", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("hit"))
    near = rows.filter(maybe).select(*keep, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    near = near.join(salted, ["canonical", "salt"], "left").select(*keep, F.coalesce("hit", F.lit(False)).alias("listed"))
    return far.unionByName(near).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed"
    )


def feed_list(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs that are also linked with a feed's tracking tag."""
    return parsed(pages.filter(F.col("url").contains("utm_source="))).select("canonical")


ORACLE = r"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') END AS canonical FROM b),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND contains(url, 'utm_source=')),
r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
      FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.rv, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.canonical = l.canonical LEFT JOIN m ON c.page_id = m.page_id AND c.host = m.host AND c.path = m.path
"""
