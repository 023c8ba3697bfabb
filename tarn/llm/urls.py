"""URL filters: host and path rules, and a blocked Bloom filter before an exact join. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.bloom import bloom_filter, possible_hits

#: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_SAID = "tarn rule verdict"
PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
#: Query keys that only track visitors.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*"


def host_of(url: Column | str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column | str) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def bare_host(url: Column | str) -> Column:
    """host_of() without one leading www. or m."""
    return F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")


#: Host labels that the query's list is made of.
BAD_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def canonical_url(url: Column | str) -> Column:
    """host without www./m., path without trailing slashes, query without tracking keys; no scheme, no fragment."""
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(F.regexp_replace(query, "&+", "&"), "^&|&$", "")
    base = F.concat(bare_host(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.coalesce(F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does. Ties: the rule named first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """All columns of pages (url among them) and host, path, canon, rule, possible, listed, verdict.

    The longest rule that fits decides. Without one, the method does: a url whose canonical form is in `listed` (column
    url) is blocked, others are allowed. The blocked Bloom filter of the listed canonical urls passes possible hits to a
    hash join with the list itself, which removes false positives. Canonical urls of the list are distinct before the
    join, so rows aren't multiplied. Null urls and urls without :// have empty host and path, never match and are allowed;
    an empty list blocks nothing. Columns of pages that clash with the added ones are replaced.
    """
    keys = listed.select(canonical_url("url").alias("canon"), host_of("url").alias("h")).where("h <> ''")
    keys = keys.select("canon").distinct()
    n_keys = keys.count()
    added = ["host", "path", "canon", "rule", "possible", "listed", "verdict"]
    rows = pages.drop(*added).withColumns({"host": host_of("url"), "path": path_of("url"), "canon": canonical_url("url")})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, _SAID: verdict})
    rows = possible_hits(rows, "canon", bloom_filter(keys, "canon", n_keys), n_keys)
    doubtful = rows.where(F.col("possible") & F.col("rule").isNull())
    clear = rows.where(~(F.col("possible") & F.col("rule").isNull())).withColumn("listed", F.lit(False))
    sure = keys.withColumn("listed", F.lit(True))
    checked = doubtful.join(sure, "canon", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rows = clear.unionByName(checked.select(*clear.columns))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", F.coalesce(_SAID, method)).drop(_SAID)


_HOST = r"coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 2), '')"
SQL = rf"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path,
  regexp_replace(regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''),
    '(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*', '', 'g'), '&+', '&', 'g'), '^&|&$', '', 'g') AS query FROM pages),
c AS (SELECT *, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)({"|".join(BAD_LABELS)})\.')),
r AS (SELECT *, CASE
   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
   WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
   WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
   WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
   WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM c)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host <> '' AND canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def listed_urls(pages: DataFrame, labels: Sequence[str] = BAD_LABELS) -> DataFrame:
    """The rows of pages (url) on hosts of which a label, but the last, is one of labels."""
    return pages.where(host_of("url").rlike(rf"(^|\.)(?:{'|'.join(labels)})\."))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list is that of all urls of pages on hosts with a bad label, in any of their forms."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")
