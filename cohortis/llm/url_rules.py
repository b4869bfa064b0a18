"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small

# Fixed values. Host and path rules: verdict, host, path.
SITE_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Pattern rules: name, literal tokens, the pattern over the lower-cased url. In every match each literal stands as a whole
# token, with nothing but digits after it in that token; a literal the pattern leaves open on a side must not be given.
PATTERN_RULES = (
    ("gambling-casino", "casino win", r"^[a-z]+://[^/?#]*\bcasino-win\b"),
    ("gambling-bets", "free bets", r"^[a-z]+://[^/?#]*\bfree-bets\b"),
    ("pharmacy", "cheap pills", r"^[a-z]+://[^/?#]*\bcheap-pills\b"),
    ("link-farm", "spam farm", r"^[a-z]+://[^/?#]*\bspam-farm\b"),
    ("tracker", "ads track", r"^[a-z]+://[^/?#]*\bads-track\b"),
    ("ad-server", "adserver", r"^[a-z]+://([^/?#]*\.)?adserver[0-9]*\."),
    ("ad-path", "ads", r"^[a-z]+://[^?#]*/ads/[^?#]*banner"),
    ("click", "click", r"[?&]click=[^#]*redirect="),
    ("session", "phpsessid", r"[?&]phpsessid=[0-9a-f]{16,}"),
    ("adult", "xxx", r"^[a-z]+://([^/?#]*\.)?xxx[./-]"),
)
TOKEN = "([a-z0-9]+)"


def _tokens(url: Column) -> Column:
    """Distinct tokens of the lower-cased url, each also without the digits at its end."""
    tokens = F.regexp_extract_all(F.lower(url), F.lit(TOKEN), F.lit(1))
    bare = F.transform(tokens, lambda t: F.rtrim(t, F.lit("0123456789")))
    return F.filter(F.array_distinct(F.concat(tokens, bare)), lambda t: t != "")


def _parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def site_rule(host: Column, path: Column, rules=SITE_RULES) -> Column:
    """The longest host and path rule that fits, as ``(rule, verdict)``; null if none does."""
    best = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, found) if best is None else best.when(fits, found)
    return best


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(token, name, pattern)``: every rule under that of its literal tokens which the fewest urls hold.

    Tokens are counted over all urls; ties go to the first in alphabetical order. A rule without a literal token is
    refused: it would have to be tried on every url.
    """
    if not rules.where(F.size(F.filter(F.split("literals", " "), lambda x: x != "")) == 0).isEmpty():
        raise ValueError("a pattern rule needs a literal token")
    wanted = rules.select("name", "pattern", F.explode(F.split("literals", " ")).alias("token")).where("token <> ''")
    held = urls.select(F.explode(_tokens(F.col("url"))).alias("token"))
    counts = held.join(small(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("urls"))
    ranked = wanted.join(counts, "token", "left").select("name", "pattern", "token", F.coalesce("urls", F.lit(0)).alias("urls"))
    return (ranked.groupBy("name", "pattern").agg(F.min(F.struct("urls", "token")).alias("m"))
            .select(F.col("m.token").alias("token"), "name", "pattern"))


def matched_rules(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``(key, rules)``: names of the pattern rules that match, for the urls that match any.

    A url's distinct tokens, and those without their last digits, fetch the rules indexed under them; only their
    patterns are run. A rule is tried on every url it can match if its literals are as ``PATTERN_RULES`` states.
    """
    index = small(rule_index(urls, rules))
    tokens = urls.select(key, "url", F.explode(_tokens(F.col("url"))).alias("token"))
    fetched = tokens.join(index, "token").where(F.expr("rlike(lower(url), pattern)"))
    return fetched.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("rules"))


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, patterns)`` for each row of ``pages(page_id, url)``.

    The longest fitting host and path rule decides; without one, a url is blocked if a pattern rule matches it and
    allowed otherwise. Null urls and those without ``://`` have an empty host and path and are allowed unless a pattern
    matches. One result row per row, repeated rows too; other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(list(PATTERN_RULES), "name string, literals string, pattern string")
    rows = pages.select("page_id", "url")
    host, path = _parts(F.col("url"))
    named = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    hits = matched_rules(rows.select("url").where("url is not null").distinct(), rules, "url")
    hits = hits.select(F.col("url").alias("hit_url"), F.col("rules").alias("patterns"))
    out = named.join(hits, F.col("url") == F.col("hit_url"), "left").withColumn("site", site_rule(F.col("host"), F.col("path")))
    return out.select(
        "page_id", "host", "path", F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", F.when(F.col("patterns").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.coalesce(F.array_join("patterns", ","), F.lit("")).alias("patterns"),
    )
