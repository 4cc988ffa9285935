"""URL filter rules indexed by their rarest literal token, as native column expressions.

A rule is a regular expression over ``host + path`` together with literal tokens that any address it fits must
contain. Each rule is filed under that literal which the fewest addresses contain (counted over all of them). An
address's tokens fetch candidate rules from the index, and only these run their expressions. The index is a constant
of the plan, spread over buckets by the token's CRC-32, so that a lookup costs the same for any number of rules; there
is no shuffle but the count of the rules' own literals, which is partial before it.

Addresses: the host runs from after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from
there to ``?``, ``#`` or the end. A null address, and one without ``://``, has an empty host and path, no rule and the
default verdict. Rows come out as they went in, repeats and very long addresses included; columns named host, path, rule or verdict, in any
case, are replaced, and all others stay. Of rules of one rank the longer name wins, then the smaller. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Rules beyond this are refused: the index is part of every task's plan.
MOST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    #: Listed rules outrank pattern rules; among listed ones that fit, the longest wins, then the smaller name.
    listed: bool = False


def host_rule(text: str, verdict: str) -> UrlRule:
    """A rule like ``example.net/en/``: fits the host and its subdomains where the path starts with the rule's."""
    host, slash, path = text.partition("/")
    whole = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", (slash + path).lower())
    return UrlRule(text, verdict, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(slash + path)}", tuple(dict.fromkeys(whole)), True)


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """A rule for hosts with the word as a whole part of a label."""
    return UrlRule(word, verdict, rf"^(?:[^/]*[.-])?{_quote(word)}(?:[.-][^/]*)?(?:/|$)", (word,))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def wildcard_rule(text: str, verdict: str = "block") -> UrlRule:
    """A rule over the whole of host and path in which ``*`` stands for anything; its literals are the runs of letters and digits that no ``*``
    touches. A text without such a run is refused, as nothing would find it."""
    runs = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", text.lower())
    if not runs:
        raise ValueError(f"no literal in {text!r}")
    return UrlRule(text, verdict, "^" + ".*".join(_quote(x) for x in text.split("*")) + "$", tuple(dict.fromkeys(runs)))


#: Pattern rules of the default filter: words that whole labels of unwanted hosts are made of.
WORDS = ("adult", "bets", "betting", "casino", "escort", "jackpot", "phishing", "pills", "poker", "porn", "sex", "spam", "torrent", "viagra", "warez", "xxx")
#: And addresses of logins, click counters and banners, whatever the host.
WILDCARDS = ("*/wp-admin/*.php", "*/track/click/*", "ads.*/banner/*")
PATTERN_RULES = (*(word_rule(w) for w in WORDS), *(wildcard_rule(w) for w in WILDCARDS))


def address(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise(F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))


def literal_counts(addresses: DataFrame, literals: Sequence[str]) -> dict[str, int]:
    """In how many rows of ``addresses`` (host, path) each literal is a token; at most one row a literal comes back."""
    wanted = F.from_json(F.lit(json.dumps(sorted(set(literals)))), "array<string>")
    found = addresses.select(F.explode(F.array_intersect(_tokens(F.concat("host", "path")), wanted)).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: Sequence[UrlRule], counts: dict[str, int]) -> tuple[Column, int]:
    """The index as a constant array of buckets, and the number of buckets."""
    buckets = 1 << max(4, len(rules)).bit_length()
    filed: list[list[dict]] = [[] for _ in range(buckets)]
    for r in rules:
        token = min(r.literals, key=lambda t: (counts.get(t, 0), t))
        filed[zlib.crc32(token.encode()) % buckets].append({"token": token, "listed": r.listed, "size": len(r.name), "name": r.name, "verdict": r.verdict, "pattern": r.pattern})
    kind = "array<array<struct<token:string,listed:boolean,size:int,name:string,verdict:string,pattern:string>>>"
    return F.from_json(F.lit(json.dumps(filed)), kind), buckets


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the listed rule that decided, else null) and verdict."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be part of a plan")
    # what came in is one struct, so that no name in it can clash
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url).alias("url"))
    host, path = address(F.col("url"))
    split = rows.select("row", host.alias("host"), path.alias("path"))
    counts = literal_counts(split, [t for r in rules for t in r.literals])
    index, buckets = rule_index(rules, counts)
    split = split.withColumn("tokens", _tokens(F.concat("host", "path")))
    fetched = F.flatten(F.transform("tokens", lambda t: F.filter(F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(buckets)).cast("int")), lambda r: r["token"] == t)))
    fits = F.filter(fetched, lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
    # the first of these: listed before patterns, long before short, then by name; of patterns, allow before block
    ranked = F.array_sort(F.transform(fits, lambda r: F.struct((~r["listed"]).alias("late"), (-r["size"]).alias("less"), r["name"].alias("name"), r["verdict"].alias("verdict"), r["listed"].alias("listed"))))
    best = split.withColumn("best", F.get(ranked, F.lit(0)))
    keep = [F.col(f"row.`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return best.select(*keep, "host", "path", F.when(F.col("best.listed"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
