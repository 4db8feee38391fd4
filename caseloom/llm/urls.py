"""URL filter: host and path rules first, then weighted words found by one Aho-Corasick pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: One whole word of these rejects a URL.
STRICT = ("porn", "xxx", "casino", "malware", "phishing", "warez", "escort")
#: Several different ones of these reject it.
SOFT = ("ads", "track", "tracker", "banner", "promo", "sponsor", "affiliate", "click", "bet", "adult", "crack", "torrent", "free", "popup", "spam")
#: Rules (verdict, host, path) of the registered query: fixed values.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path, in characters) that fits, as struct (rule, verdict); NULL if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit).otherwise(found)
    return found


def term_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """Struct (strict, soft): how many different terms of each list stand in the URL as whole words.

    One automaton holds both lists and reads each URL once, lower-cased; a hit
    counts if no ASCII letter or digit stands directly before or after it. A term in
    both lists is strict. NULL and empty URLs have no hits.
    """
    weights = {t.lower(): 0 for t in soft if t} | {t.lower(): 1 for t in strict if t}

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        automaton.make_automaton()
        edge = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for urls in batches:
            rows = []
            for url in urls:
                low = url.lower() if url else ""
                seen = set()
                if weights:
                    for end, term in automaton.iter(low):
                        begin = end - len(term)
                        if (begin < 0 or low[begin] not in edge) and (end + 1 >= len(low) or low[end + 1] not in edge):
                            seen.add(term)
                hard = sum(weights[t] for t in seen)
                rows.append((hard, len(seen) - hard))
            yield pd.DataFrame(rows, columns=["strict", "soft"])

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(count, "strict int, soft int")(url)


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Iterable[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = 2,
) -> DataFrame:
    """Add host, path, rule, verdict, strict_hits and soft_hits to every page; nothing is shuffled.

    The verdict is the longest fitting rule's. Without one it is ``block`` from one
    strict term or ``soft_limit`` different soft terms on, else ``allow``. A NULL URL
    or one without ``://`` has an empty host and path, fits no rule, and is judged by
    its terms. Columns of the input that bear one of these names are replaced; all
    other columns are kept, and repeated rows stay repeated.
    """
    link = F.col(url)
    judged = pages.select(
        *[F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits") or c == url],
        host_of(link).alias("_host"),
        path_of(link).alias("_path"),
        term_hits(link, strict, soft).alias("_hits"),
    )
    rule = matching_rule(F.col("_host"), F.col("_path"), rules)
    bad = (F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= soft_limit)
    judged = judged.withColumn("_rule", rule)
    return judged.select(
        *[c for c in judged.columns if c not in ("_host", "_path", "_hits", "_rule")],
        F.coalesce("_host", F.lit("")).alias("host"),
        F.coalesce("_path", F.lit("")).alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.col("_hits.strict").alias("strict_hits"),
        F.col("_hits.soft").alias("soft_hits"),
    )
