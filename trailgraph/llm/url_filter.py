"""URL filters: pattern rules behind an index on their rarest literal token.

A rule is a pattern over ``host + path``: ``||`` anchors a host and its
subdomains, ``|`` an end, ``*`` matches anything, ``^`` a separator.  Each rule
is filed under the literal token of it that fewest rules have; rules without a
complete token are candidates everywhere.  A URL's tokens fetch its candidate
rules, and only those run regular expressions.  The index is a constant of the
plan while its size is below ``MAX_INDEX_BYTES``, so that one pass without
shuffle or join does it all; a larger set of rules is a table, and tokens fetch
their rules from it by a join, with the same results.

Defined cases
-------------
* null URL, or one without ``://``: host and path are empty and the default verdict holds;
* empty path: no rule with a path fits;
* ties: the longest rule wins; among equals the one listed first;
* repeated rows: judged alike; empty table: empty result;
* very long URLs: read whole; extra columns, with whatever names: kept by ``judge``; its own four replace those of their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: Bytes that the index may take as a constant of the plan.
MAX_INDEX_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """``pattern`` in filter syntax; ``name`` is what results show (None: shown as no rule); a higher ``tier`` beats any length."""

    pattern: str
    action: str
    name: str | None = None
    tier: int = 0


def host_rule(host: str, path: str, action: str) -> Rule:
    """A host with all its subdomains, and a prefix of the path."""
    return Rule(f"||{host}{path}*", action, f"{host}{path}", tier=1)


#: What the query judges by: the given host rules, before general patterns.
HOST_RULES = (
    host_rule("net", "/", "block"),
    host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"),
    host_rule("org", "/fr/", "allow"),
)
#: General patterns for pages that are no prose: adverts, trackers, carts, logins, downloads.
PATTERN_RULES = tuple(
    Rule(p, "block")
    for p in (
        "||ads-track.", "||ads.", "||adserver.", "||tracker.", "||doubleclick.", "/adserver/", "/banner-ads/", "/wp-login.php",
        "/cart/checkout", "/account/login", "/cgi-bin/", ".exe|", ".zip|", ".apk|", "||casino.", "||porn.", "-casino-",
    )
) + tuple(Rule(p, "allow") for p in ("/robots.txt|",))


def regex(pattern: str) -> str:
    """The regular expression of a pattern, for host and path put together."""
    start, end = "", ""
    if pattern.startswith("||"):
        start, pattern = r"^(?:[^/]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        start, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        end, pattern = r"\z", pattern[:-1]  # not $, which fits before a last line break too
    pattern = pattern.rstrip("*") if not end else pattern
    parts = {"*": r"[\s\S]*", "^": r"(?:[^0-9A-Za-z_.%-]|\z)"}
    return start + "".join(parts.get(c, re.sub(r"([^0-9A-Za-z/_ -])", r"\\\1", c)) for c in pattern) + end


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every URL which the pattern fits has as whole tokens: both neighbours in the pattern are fixed non-token characters."""
    bounded = pattern.replace("||", "/").lower()
    bounded = ("/" + bounded[1:]) if bounded.startswith("|") else bounded if pattern.startswith("||") else "*" + bounded
    bounded = bounded[:-1] + "/" if bounded.endswith("|") else bounded + "*"
    return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", bounded)


def build_index(rules: tuple[Rule, ...]) -> tuple[list[dict], list[dict], int]:
    """Rules by bucket and token, rules without token, number of buckets."""
    tokens = [literal_tokens(r.pattern) for r in rules]
    frequency = Counter(t for own in tokens for t in set(own))
    n = max(16, 2 * len(frequency))
    table: list[dict] = [{} for _ in range(n)]
    everywhere: list[dict] = []
    for order, (rule, own) in enumerate(zip(rules, tokens, strict=True)):
        entry = {"pattern": regex(rule.pattern), "tier": rule.tier, "length": len(rule.name or rule.pattern), "order": -order, "action": rule.action, "rule": rule.name}
        if own:
            token = min(own, key=lambda t: (frequency[t], -len(t), t))
            table[zlib.crc32(token.encode()) % n].setdefault(token, []).append(entry)
        else:
            everywhere.append(entry)
    return table, everywhere, n


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


ENTRY = "struct<pattern:string,tier:int,length:int,order:int,action:string,rule:string>"


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(place), "[^a-z0-9]+"))


def _ranked(c: Column) -> Column:
    return F.struct(c["tier"], c["length"], c["order"], c["action"], c["rule"])


def judge(urls: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, default: str = "allow", column: str = "url", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``urls`` with host, path, rule and verdict."""
    table, everywhere, n = build_index(rules)
    text, always = json.dumps(table), json.dumps(everywhere)
    places = urls.withColumns({"host": host(F.col(column)), "path": path(F.col(column))})
    best = fresh(places, "_best")[0]
    if len(text) + len(always) > max_index_bytes:
        judged = _by_join(places, table, everywhere, best)
    else:
        index = F.from_json(F.lit(text), f"array<map<string,array<{ENTRY}>>>")
        place = F.concat("host", "path")
        none = F.from_json(F.lit("[]"), f"array<{ENTRY}>")

        def fetch(token: Column) -> Column:
            return F.coalesce(F.try_element_at(F.get(index, F.pmod(F.crc32(token.cast("binary")), F.lit(n)).cast("int")), token), none)

        candidates = F.concat(F.flatten(F.transform(_tokens(place), fetch)), F.from_json(F.lit(always), f"array<{ENTRY}>"))
        fits = F.filter(candidates, lambda c: F.regexp_like(place, c["pattern"]))
        judged = places.withColumn(best, F.array_max(F.transform(fits, _ranked)))
    return judged.withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.action"), F.lit(default))}).drop(best)


def _by_join(places: DataFrame, table: list[dict], everywhere: list[dict], best: str) -> DataFrame:
    """``places`` with the best rule that fits, the rules being a table; rules without a token are tried on every place that differs."""
    spark = places.sparkSession
    rows = [(token, *(e[k] for k in ("pattern", "tier", "length", "order", "action", "rule"))) for bucket in table for token, own in bucket.items() for e in own]
    schema = "token string, pattern string, tier int, length int, order int, action string, rule string"
    filed = spark.createDataFrame(rows, schema)
    always = spark.createDataFrame([(None, *(e[k] for k in ("pattern", "tier", "length", "order", "action", "rule"))) for e in everywhere], schema)
    asked = places.select(F.concat("host", "path").alias("_place")).distinct()
    met = asked.select("_place", F.explode(_tokens(F.col("_place"))).alias("token")).join(filed, "token")
    tried = met.unionByName(asked.withColumn("token", F.lit(None).cast("string")).join(F.broadcast(always.drop("token")))) if everywhere else met
    fits = tried.where(F.regexp_like("_place", F.col("pattern"))).groupBy("_place").agg(F.max(F.struct("tier", "length", "order", "action", "rule")).alias("_found"))
    place, found = fresh(places, "_place", "_found")
    fits = fits.select(F.col("_place").alias(place), F.col("_found").alias(found))
    return places.join(fits, F.concat("host", "path") == F.col(place), "left").withColumnRenamed(found, best).drop(place)
