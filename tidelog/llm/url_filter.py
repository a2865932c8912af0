"""URL filter: pattern rules indexed by their rarest literal token, with DataFrame functions only.

Rules are written like filter lists: ``||`` anchors at a host or a subdomain of it, ``~`` at a word of the host
(between dots and hyphens, and whole), ``|`` at the start (or end) of the address, ``*`` is any run, ``^`` a separator
or the end.  Each rule becomes one regular expression and the list
of literal tokens (runs of a-z, 0-9) that every address it matches must hold whole.  A rule is filed under the one
of those tokens that the fewest distinct addresses hold, counted over the whole table.  An address fetches only
the rules filed under its own tokens and runs only their expressions.  A rule without such a token is filed under
the empty token, which every address has.

The rule list is the operator's configuration: up to `MAX_RULES` rules the index is broadcast, longer lists are joined.

Addresses are judged once each.  Rows look the verdict up by their address; addresses that very many rows share,
such as the empty one of malformed rows, are salted for that.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import durable, hot_keys, lower_ascii, salted_join

MAX_RULES = 50_000
TOKEN_BREAK = r"[^a-z0-9]+"


class Rule(NamedTuple):
    pattern: str
    verdict: str  # allow or block
    #: Rules of a higher rank are asked first; within one rank the longest pattern wins, then block.
    rank: int = 0
    name: str | None = None


def host_rule(host: str, path: str, verdict: str, rank: int = 1) -> Rule:
    """A rule for a host, its subdomains and the paths that start with `path`."""
    return Rule(f"||{host}{path}", verdict, rank, f"{host}{path}")


#: The rules that the query must apply first.
BASE_RULES = (
    host_rule("org", "/", "allow"),
    host_rule("example.org", "/es/", "block"),
    host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"),
    host_rule("com", "/de/", "block"),
)
#: Words of hosts and parts of paths that seldom lead to prose.
METHOD_RULES = (
    Rule("~casino", "block"), Rule("~casinos", "block"), Rule("~bet", "block"), Rule("~bets", "block"), Rule("~betting", "block"), Rule("~poker", "block"),
    Rule("~gambling", "block"), Rule("~slots", "block"), Rule("~lottery", "block"), Rule("~pills", "block"), Rule("~viagra", "block"),
    Rule("~adult", "block"), Rule("~adult-education", "allow"), Rule("~porn", "block"), Rule("~xxx", "block"), Rule("~escorts", "block"),
    Rule("~spam", "block"), Rule("~spam-filter", "allow"), Rule("~warez", "block"), Rule("~phishing", "block"), Rule("~malware", "block"),
    Rule("~ads", "block"), Rule("~adserver", "block"), Rule("~tracker", "block"), Rule("~track", "block"), Rule("~clicks", "block"),
    Rule("/wp-admin/", "block"), Rule("/wp-login", "block"), Rule("/login^", "block"), Rule("/signin^", "block"),
    Rule("/signup^", "block"), Rule("/register^", "block"), Rule("/logout^", "block"), Rule("/cart^", "block"),
    Rule("/checkout^", "block"), Rule("/cgi-bin/", "block"), Rule("/search^", "block"), Rule("/tag/", "block"),
    Rule("/ads/", "block"), Rule("/banner/", "block"), Rule("/feed|", "block"), Rule("/rss|", "block"),
    Rule(".zip|", "block"), Rule(".exe|", "block"), Rule(".jpg|", "block"), Rule(".png|", "block"), Rule(".css|", "block"),
    Rule(".js|", "block"), Rule("/help/search^", "allow"),
)


def compile_rule(pattern: str) -> tuple[str, list[str]]:
    """The rule's regular expression over host + path, and the tokens that any match holds whole.

    A token counts only where the pattern itself shows what stands on both of its sides: an anchor, a separator or
    a literal that is no token character.  Letters of a rule match either case in the host only if written so; the
    host is lower-cased beforehand, the path is compared as it stands.
    """
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("~"):
        body, head, tail = body[1:], r"^(?:[^/]*[.-])?", r"(?:[-.:/]|$)"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    parts = {"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|$)"}
    regex = "(?s)" + head + "".join(parts.get(c) or re.sub(r"([^a-zA-Z0-9_ /-])", r"\\\1", c) for c in body) + tail
    tokens = []
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else ("" if not head else "^")
        after = body[m.end()] if m.end() < len(body) else ("$" if tail else "")
        if before not in ("", "*") and after not in ("", "*"):
            tokens.append(m[0].lower())
    return regex, tokens


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null or where no `://` stands."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = []
    for i, r in enumerate(rules):
        regex, tokens = compile_rule(r.pattern)
        rows.append((i, regex, r.verdict, r.rank, len(r.name or r.pattern), r.name, tokens))
    return spark.createDataFrame(rows, "rule_id int, regex string, verdict string, rank int, size int, name string, tokens array<string>")


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_broadcast: int = MAX_RULES
) -> DataFrame:
    """One row per input row: `id_col`, host, path, rule (name of the winning named rule, else null), verdict.

    Null, empty and malformed addresses have an empty host and path, match only rules that match the empty string,
    and otherwise get `default`.  Very long addresses are matched whole.  Repeated rows and equal addresses get equal
    verdicts.  Of several rules the highest rank wins, then the longest, then block before allow, then the order of
    the list.  An empty table gives an empty result; other columns are not read, so their names cannot clash.
    """
    small = F.broadcast if len(rules) <= most_broadcast else (lambda df: df)
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    places = durable(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_rows")).hint("rebalance"))
    held = F.array_distinct(F.split(lower_ascii(F.concat_ws("", "host", "path")), TOKEN_BREAK))
    tokens = places.select("host", "path", F.explode(F.array_union(held, F.array(F.lit("")))).alias("token"))

    table = _rules_frame(pages.sparkSession, rules)
    wanted = table.select("rule_id", F.explode("tokens").alias("token"))
    counts = tokens.join(small(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.join(small(counts), "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    index = table.join(small(rarest), "rule_id", "left").select(
        "rule_id", "regex", "verdict", "rank", "size", "name", F.coalesce("token", F.lit("")).alias("token")
    )
    fetched = tokens.join(small(index), "token").where(F.expr("regexp_like(concat(host, path), regex)"))
    order = F.struct("rank", "size", (F.col("verdict") == "block").alias("blocks"), (-F.col("rule_id")).alias("turn"))
    best = fetched.groupBy("host", "path").agg(F.max_by(F.struct("name", "verdict"), order).alias("best"))
    judged = salted_join(rows, best, ["host", "path"], hot_keys(places, ["host", "path"], "n_rows"), "id", "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def oracle(rules: Sequence[Rule] = BASE_RULES + METHOD_RULES, default: str = "allow") -> str:
    """The same verdicts in SQL: every rule is tried on every address."""
    quote = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    values = ", ".join(
        f"({i}, {quote(compile_rule(r.pattern)[0])}, {quote(r.verdict)}, {r.rank}, {len(r.name or r.pattern)}, {quote(r.name)})" for i, r in enumerate(rules)
    )
    return f"""
WITH r(rule_id, regex, verdict, rank, size, name) AS (VALUES {values}),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT page_id, name, verdict, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, size DESC, verdict DESC, rule_id) AS k
  FROM q JOIN r ON regexp_matches(host || path, regex))
SELECT q.page_id, host, path, m.name AS rule, coalesce(m.verdict, '{default}') AS verdict
FROM q LEFT JOIN m ON q.page_id = m.page_id AND m.k = 1
"""
