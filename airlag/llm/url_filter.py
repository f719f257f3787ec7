"""Verdicts on URLs: host rules first, then a list of canonical URLs.

The list is compiled into a blocked Bloom filter: a canonical URL belongs to
one block of eight 64-bit words and sets one bit in each.  The filter has a
fixed number of blocks, so its size does not depend on the list and it can be
broadcast.  URLs that pass it go to an exact hash join with the list, which
removes the false positives; all others are known not to be listed and are
never shuffled.  With a list much longer than the filter more URLs reach the
join, and the verdicts stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.llm.common import read_table

#: (host, path, verdict); a rule fits its host, all subdomains and paths that start with its path.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
              ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: 64 bytes a block: 2 MiB.
BLOCKS = 1 << 15
WORDS = 8
#: Hosts with a label that contains one of these words are listed by ``listed_urls``.
LISTED_WORDS = ("spam", "casino", "phish", "malware")
#: Query parameters that do not change what a URL shows.
TRACKING = "^(utm_.*|ref|fbclid|gclid)(=.*)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> dict[str, Column]:
    """host (ASCII lower case), path and query of a URL; all empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return {"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER),
            "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
            "query": F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1)}


def canonical_url(host: Column, path: Column, query: Column) -> Column:
    """Host without ``www.``, path without final slashes, the query's other
    than tracking parameters in order; neither scheme nor fragment."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(F.regexp_replace(host, "^www[.]", ""), F.regexp_replace(path, "/+$", ""),
                    F.lit("?"), F.array_join(kept, "&"))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            (F.shiftright(h, 6 * i).bitwiseAND(F.lit(63))).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def blocked_bloom(listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, w0 .. w7) of the keys: ``blocks`` rows at most, whatever the list's length."""
    bits = listed.select(_block(F.col(key), blocks).alias("block"),
                         *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_urls(pages: DataFrame, url_col: str = "url", words=LISTED_WORDS) -> DataFrame:
    """Canonical URLs of the pages whose host has a listed word: ``canonical``, distinct."""
    p = url_parts(F.col(url_col))
    return (pages.where(p["host"].rlike("|".join(words)))
            .select(canonical_url(**p).alias("canonical")).distinct())


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules=HOST_RULES, blocks: int = BLOCKS) -> DataFrame:
    """Verdict on the URL of every row: ``page_id, host, path, rule, verdict``.

    ``listed`` has a string column ``canonical``; its nulls and repeats count
    for nothing.  A rule decides if one fits, else the URL is blocked exactly
    if its canonical form is listed.  A null URL or one without ``://`` has an
    empty host and path and is allowed.  Repeated rows each get their verdict,
    an empty table gives no rows, an empty list blocks nothing, other columns
    are ignored whatever their names.
    """
    listed = listed.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    p = url_parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), *[c.alias(n) for n, c in p.items()])
    rule, ruled = host_rule(F.col("host"), F.col("path"), rules)
    seen = split.select(
        "page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"),
        canonical_url(F.col("host"), F.col("path"), F.col("query")).alias("canonical"))
    bloom = F.broadcast(blocked_bloom(listed, "canonical", blocks))  # a fixed number of rows
    seen = seen.withColumn("block", _block(F.col("canonical"), blocks)).join(bloom, "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(b) != 0)
    maybe = hit & F.col("ruled").isNull() & (F.col("host") != "")
    clear = seen.where(~maybe).select("page_id", "host", "path", "rule",
                                      F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    exact = listed.withColumn("found", F.lit(True))
    checked = seen.where(maybe).join(exact, "canonical", "left").select(
        "page_id", "host", "path", "rule",
        F.when(F.col("found"), "block").otherwise("allow").alias("verdict"))
    return clear.unionByName(checked)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    return judge_urls(pages, listed_urls(pages))


#: The same verdicts without the filter, in plain SQL.
OP10_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*[?]([^#]*)', 1) AS query FROM rest),
canon AS (
  SELECT page_id, host, path,
         regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') || '?' || array_to_string(list_sort(
           list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&') AS canonical
  FROM parts),
listed AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '{"|".join(LISTED_WORDS)}')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM canon)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
