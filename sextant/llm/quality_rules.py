"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule. Policies are versioned masks over those bits, so a new policy, or an ablation of an
old one, reads the ledger and no text. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

#: rule -> condition over the measurements; the position is the bit
RULES: dict[str, str] = {
    "short": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
#: version -> mask of the rules that reject
POLICIES: dict[int, int] = {1: BITS["short"] | BITS["repeated_words"], 2: sum(BITS.values())}
BASE = 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, size: int) -> Column:
    """Words in windows of ``size`` words that occur twice or more. Each word is hashed once and
    a window's hash is that of its words' hashes; windows are compared by 64-bit hash, sorted
    with their places so that equals are neighbours."""
    n = F.size(words)
    places = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*(F.get(h, i + k) for k in range(size))).alias("h"), i.alias("i")))))
    found = let(
        hashed,
        lambda s: let(
            F.size(s),
            lambda m: F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1)["h"] == x["h"]) | (k < m - 1) & (F.get(s, k + 1)["h"] == x["h"])),
        ),
    )
    starts = F.array_sort(F.transform(found, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, p: F.struct((acc["total"] + size - F.greatest(F.lit(0).cast("long"), acc["end"] - p)).alias("total"), (p + size).cast("long").alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["total"])


def ledger(docs: DataFrame, window: int = 5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed).

    One row for each input row, in any order; ``failed`` has the bits of the failed rules. A null
    or empty text measures 0 everywhere and so fails the rule on length only; a null doc_id stays
    null; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    solid = F.length(F.translate("t", SPACES, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    measured = (
        docs.select("doc_id", text.alias("t"))
        .select(
            "doc_id",
            solid.cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), F.size(F.array_distinct(a)).cast("long").alias("own"))).alias("lines"),
            let(
                F.regexp_extract_all("t", F.lit(WORD), F.lit(0)),
                lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w, window).alias("again")),
            ).alias("words"),
        )
        .select(
            "doc_id",
            F.col("words.n").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.col("lines.n") - F.col("lines.own")).alias("n_dup_lines"),
            F.col("words.again").alias("n_repeat_words"),
            F.col("lines.n").alias("n_lines"),
        )
    )
    failed = None
    for name, rule in RULES.items():
        bit = F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0))
        failed = bit if failed is None else failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passes(mask: int, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask)) == 0


def judge(book: DataFrame, version: int = 2) -> DataFrame:
    """The ledger with ``base_failed`` and the verdict of one policy in ``kept``."""
    return book.withColumn("base_failed", ~passes(POLICIES[BASE])).withColumn("kept", passes(POLICIES[version]) & ~F.col("base_failed"))


def _cases() -> list[tuple[int, str | None, int, int]]:
    """(version, rule, mask, mask without the rule), and a case without a rule for each policy."""
    cases: list[tuple[int, str | None, int, int]] = [(v, name, mask, mask & ~BITS[name]) for v, mask in POLICIES.items() for name in RULES if mask & BITS[name]]
    return cases + [(v, None, mask, 0) for v, mask in POLICIES.items()]


def ablations(book: DataFrame) -> DataFrame:
    """(version, rule, n_rejected, n_saved): documents that a policy rejects, and those it would
    keep without the rule. Documents are counted per pattern of bits first, so what follows
    handles 2 ** rules rows at most. ``rule`` is null for the whole policy. An empty table has no
    rows."""
    patterns = book.groupBy("failed").count()
    struct = [F.struct(F.lit(v).alias("version"), F.lit(name).cast("string").alias("rule"), F.lit(mask).alias("mask"), F.lit(rest).alias("rest")) for v, name, mask, rest in _cases()]
    each = patterns.select("failed", "count", F.explode(F.array(*struct)).alias("c")).select("failed", "count", "c.*")
    rejected = F.expr("failed & mask <> 0")
    saved = rejected & F.expr("failed & rest = 0")
    zero = F.lit(0).cast("long")
    return each.groupBy("version", "rule").agg(F.sum(F.when(rejected, F.col("count")).otherwise(zero)).alias("n_rejected"), F.sum(F.when(saved, F.col("count")).otherwise(zero)).alias("n_saved"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS win
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
again AS (SELECT doc_id, win FROM g GROUP BY ALL HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM
          (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM g JOIN again USING (doc_id, win)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
      FROM w JOIN l USING (doc_id) LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        | (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) | (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
        | (CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END) AS INTEGER) AS failed FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f
"""

ABLATIONS = f"""
SELECT version, rule, count(*) FILTER (failed & mask <> 0) AS n_rejected, count(*) FILTER (failed & mask <> 0 AND failed & rest = 0) AS n_saved
FROM ({ORACLE}) CROSS JOIN (VALUES {", ".join(f"({v}, {'NULL' if name is None else repr(name)}, {mask}, {rest})" for v, name, mask, rest in _cases())}) c(version, rule, mask, rest)
GROUP BY version, rule
"""
