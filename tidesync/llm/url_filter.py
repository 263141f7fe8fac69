"""URL filters: host rules, then pattern rules indexed by their rarest literal token.

Method: every pattern rule names literal tokens that any match must contain. One aggregate counts,
over all urls, how often each of these tokens occurs; a rule is filed under its rarest one. A url is
split into tokens, its tokens fetch the rules filed under them, and only those run their regular
expression, compiled when it is first fetched. A rule without a token is refused: it would run on every url.
The index has one entry per rule and goes to every task; the rule list is a parameter
of the operator (a table of ``name``, ``pattern``, ``tokens`` is read by ``rules_of``) and does not grow with the data.

A host rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting
rule decides the verdict, whatever pattern the url has.

Cases: a null url, or one without ``://``, has an empty host and path, no tokens, and is allowed.
Page ids may be null or repeat; rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` runs on the lower-cased url; ``tokens`` are whole tokens of every url it matches."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


# Host rules of the contract.
HOST_RULES = (
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)

# Pattern rules of unwanted hosts, paths and query strings.
PATTERN_RULES = (
    PatternRule("casino", r"://[^/?#]*\bcasino\b", ("casino",)),
    PatternRule("free-bets", r"://[^/?#]*\bfree[-.]bets?\b", ("free",)),
    PatternRule("adult", r"://[^/?#]*\badult\b", ("adult",)),
    PatternRule("porn", r"://[^/?#]*\bporn\b", ("porn",)),
    PatternRule("xxx", r"://[^/?#]*\bxxx\b", ("xxx",)),
    PatternRule("cheap-pills", r"://[^/?#]*\bcheap[-.]pills\b", ("cheap", "pills")),
    PatternRule("spam-farm", r"://[^/?#]*\bspam[-.]farm\b", ("spam", "farm")),
    PatternRule("ads-track", r"://[^/?#]*\bads[-.]track\b", ("ads", "track")),
    PatternRule("login-page", r"://[^/?#]*/(?:[^?#]*/)?login\b", ("login",)),
    PatternRule("signin-page", r"://[^/?#]*/(?:[^?#]*/)?signin\b", ("signin",)),
    PatternRule("cart-page", r"://[^/?#]*/(?:[^?#]*/)?cart\b", ("cart",)),
    PatternRule("calendar-trap", r"://[^/?#]*/[^?#]*\bcalendar/[0-9]{4}/[0-9]{2}\b", ("calendar",)),
    PatternRule("session-id", r"[?&]sessionid=[0-9a-f]+", ("sessionid",)),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """Name of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def rules_of(table: DataFrame) -> tuple[PatternRule, ...]:
    """Pattern rules from a rule table: name, pattern, tokens (array of lower-case tokens)."""
    return tuple(PatternRule(r["name"], r["pattern"], tuple(r["tokens"] or ())) for r in table.toLocalIterator())


def token_counts(urls: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """Urls that hold each of the rules' tokens: one row per such token reaches the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit(TOKEN), F.lit(0)))).alias("token"))
    named = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    counted = tokens.join(F.broadcast(named), "token").groupBy("token").agg(F.count("*").alias("n"))
    counts = {r["token"]: r["n"] for r in counted.toLocalIterator()}
    return {t: counts.get(t, 0) for t in wanted}


def rule_index(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[tuple[str, str]]]:
    """Rules by their rarest token. A token must be one that urls are split into, else the rule would never be fetched."""
    index: dict[str, list[tuple[str, str]]] = {}
    for rule in rules:
        if not rule.tokens or not all(re.fullmatch(TOKEN, t) for t in rule.tokens):
            raise ValueError(f"pattern rule {rule.name!r} needs tokens of the form {TOKEN}, not {rule.tokens}")
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
        index.setdefault(token, []).append((rule.name, rule.pattern))
    return index


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern (name of the pattern rule that blocks)."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    index = rule_index(tuple(pattern_rules), token_counts(rows, tuple(pattern_rules)))

    def first_pattern(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled: dict[str, list[tuple[str, re.Pattern]]] = {}
        token = re.compile(TOKEN)

        def fetch(t: str) -> list[tuple[str, re.Pattern]]:
            if t not in compiled:
                compiled[t] = [(n, re.compile(p)) for n, p in index[t]]
            return compiled[t]

        def judge(url: str | None) -> str | None:
            if url is None or "://" not in url:
                return None
            low = url.lower()
            fetched = set(token.findall(low)) & index.keys()
            return min((n for t in fetched for n, p in fetch(t) if p.search(low)), default=None)

        for urls in batches:
            yield urls.map(judge, na_action=None).astype(object)

    judged = rows.withColumn("rule", host_rule(F.col("host"), F.col("path"), tuple(host_rules)))
    judged = judged.withColumn("pattern", F.pandas_udf(first_pattern, "string")("url"))
    verdict = F.when(F.col("pattern").isNull(), "allow").otherwise("block")
    for rule in host_rules:
        verdict = F.when(F.col("rule") == rule.name, rule.verdict).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "pattern")


def oracle_sql() -> str:
    """DuckDB twin: every rule on every url, no index."""
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    )
    patterns = " ".join(
        f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.name}'" for r in sorted(PATTERN_RULES, key=lambda r: r.name)
    )
    verdicts = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in HOST_RULES)
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS u, lower(coalesce(url, '')) AS low FROM pages),
h AS (
  SELECT page_id, low, lower(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE {fits} END AS rule, CASE {patterns} END AS pattern FROM h)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN pattern IS NULL THEN 'allow' ELSE 'block' END AS verdict, pattern
FROM r
"""
