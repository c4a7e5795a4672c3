"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Rules in one literal index; more rules make more indexes, each a further expression over the same row.
INDEX_RULES = 5000
INDEX_BINS = 512
RULE = "array<map<string,array<struct<length:int,allow:int,rule:string,pattern:string>>>>"


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with all its subdomains where the path starts with path."""

    host: str
    path: str
    allow: bool

    @classmethod
    def parse(cls, text: str, allow: bool) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), slash + path, allow)

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        quoted = re.sub(r"([^A-Za-z0-9_/\-])", lambda m: f"\\x{{{ord(m[1]):x}}}", self.text)
        return rf"^(?:[^/?#]*\x{{2e}})?{quoted}"

    @property
    def tokens(self) -> list[str]:
        """What every url that the rule fits has as whole tokens: the host's labels, and path segments closed by a slash."""
        return [f"h:{x}" for x in self.host.split(".")] + [f"p:{x}" for x in self.path.split("/")[1:-1]]


#: The rules of the query op1_url_filter.
RULES = [
    Rule.parse("org/", True),
    Rule.parse("example.org/es/", False),
    Rule.parse("example.org/en/1", False),
    Rule.parse("com/fr/", True),
    Rule.parse("com/de/", False),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: from the first :// up to / ? # or the end, and then up to ? # or the end; without :// both are empty."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, shape, k), F.lit("")) for k in (1, 2))
    return ascii_lower(host), path


def url_tokens(host: Column, path: Column) -> Column:
    """The tokens of a url as Rule.tokens names them; the empty token, which every url has, comes last."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(""))))


def token_counts(urls: DataFrame, host: str, path: str, rules: list[Rule]) -> dict[str, int]:
    """How many urls have each token of the rules. Only tokens of rules are counted, so the result is bounded by them."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = urls.select(F.explode(F.array_intersect(url_tokens(F.col(host), F.col(path)), F.from_json(F.lit(json.dumps(wanted)), "array<string>"))).alias("token"))
    return dict.fromkeys(wanted, 0) | {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token, the first of equally rare ones; one without tokens under the empty token."""
    held = defaultdict(list)
    for rule in rules:
        held[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return held


def _bin(token: str) -> int:
    import zlib

    return zlib.crc32(token.encode()) % INDEX_BINS


def best_rule(host: Column, path: Column, tokens: Column, held: dict[str, list[Rule]]) -> Column:
    """The longest rule that fits, an allowing one before a blocking one of the same length; null without one.

    The index is one literal: an array of small maps, so that a token meets only the few keys of its bin. Each token of
    the url fetches its rules, and only those patterns run.
    """
    bins = [{} for _ in range(INDEX_BINS)]
    for token, rules in held.items():
        bins[_bin(token)][token] = [{"length": len(r.text), "allow": int(r.allow), "rule": r.text, "pattern": r.pattern} for r in rules]
    literal = F.from_json(F.lit(json.dumps(bins)), RULE)
    fetched = F.flatten(F.filter(F.transform(tokens, lambda t: literal[F.pmod(F.crc32(t), F.lit(INDEX_BINS)).cast("int")][t]), lambda x: x.isNotNull()))
    whole = F.concat(host, path)
    return F.array_max(F.filter(fetched, lambda r: F.rlike(whole, r["pattern"])))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block) from the rules on the url.

    Rules are given by the caller and go into the plan as literals, INDEX_RULES in each; their rarest tokens are found by
    counting, over all urls, the tokens that rules have. Beside that count nothing is shuffled or joined: a hot host, repeated
    urls or keys and ties cost nothing more. A null url, or one without ://, has empty host and path, fits no rule and gets
    the default verdict. Columns of pages named like a result's give way to it; all others stay.
    """
    host, path = parts(F.col(url))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    unique = list(dict.fromkeys(rules))
    counts = token_counts(split, "host", "path", unique)
    found = [best_rule(F.col("host"), F.col("path"), url_tokens(F.col("host"), F.col("path")), index(unique[i : i + INDEX_RULES], counts)) for i in range(0, len(unique), INDEX_RULES)]
    best = found[0] if len(found) == 1 else F.greatest(*found) if found else F.lit(None).cast("struct<length:int,allow:int,rule:string,pattern:string>")
    out = [F.col(f"`{c}`") for c in split.columns]
    judged = split.select(*out, best.alias("rule"))
    verdict = F.when(F.col("rule").isNull(), default).otherwise(F.when(F.col("rule.allow") == 1, "allow").otherwise("block"))
    return judged.select(*out, F.col("rule.rule").alias("rule"), verdict.alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all pages by the fixed rules."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_FITS = " UNION ALL ".join(
    f"SELECT '{r.host}' AS rule_host, '{r.path}' AS rule_path, '{'allow' if r.allow else 'block'}' AS verdict" for r in RULES
)
OP1_SQL = f"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules AS ({_FITS}),
urls AS (SELECT DISTINCT host, path FROM split),
fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (host, path)
"""
