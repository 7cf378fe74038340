"""URL filters: rules are indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` with literal tokens
that each URL it matches must hold.  Token frequencies are counted over all
URLs, each rule is filed under its rarest token, and a URL runs only the rules
filed under its own tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import told

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``rank`` orders the rules that fit one URL: the highest wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: tuple


def path_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains whose path starts with ``path``."""
    whole = host + path
    # A token that the path cuts off may be longer in the URL: it is no literal.
    bounded = whole if not whole[-1:].isalnum() else re.sub(r"[A-Za-z0-9]+\Z", "", whole)
    return Rule(whole, verdict, r"(?:[^/]*\.)?" + re.escape(whole), tuple(TOKEN.findall(bounded.lower())),
                (1, len(whole), whole))


def pattern_rule(verdict: str, name: str, pattern: str, *tokens: str) -> Rule:
    """A rule by regular expression over host and path; ranks below every path rule."""
    return Rule(name, verdict, pattern, tokens, (0, len(tokens), name))


#: The list of the contract.
PATH_RULES = (
    path_rule("allow", "com", "/"), path_rule("block", "example.com", "/en/"),
    path_rule("allow", "www.example.com", "/en/"), path_rule("block", "net", "/es/"),
    path_rule("block", "net", "/fr/"),
)
#: Hosts that sell, bet, track or breed links.
PATTERN_RULES = tuple(pattern_rule("block", f"host:{w}", rf"(?:[^/]*[^a-z0-9/])?{w}(?![a-z0-9])", w)
                      for w in ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx"))


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2])
    return m[1].translate(_LOWER), m[2]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _tokens(text: str) -> set[str]:
    return set(TOKEN.findall(text.translate(_LOWER)))


class Index:
    """Rules by rarest token; rules without tokens run for every URL."""

    def __init__(self, rules, counts: dict[str, int]):
        self.filed: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = [(r.name, r.verdict, re.compile(r.pattern), r.rank) for r in rules]
        for i, r in enumerate(rules):
            if r.tokens:
                rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
                self.filed.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def candidates(self, where: str) -> list[int]:
        out = list(self.always)
        for t in _tokens(where):
            out += self.filed.get(t, ())
        return out

    def judge(self, where: str):
        """(name, verdict, is path rule) of the winning rule, or None."""
        best = None
        for i in self.candidates(where):
            name, verdict, pattern, rank = self.rules[i]
            if (best is None or rank > best[0]) and pattern.match(where):
                best = rank, name, verdict
        return best and (best[1], best[2], best[0][0] == 1)


def token_counts(pages: DataFrame, rules, url_col: str = "url") -> dict[str, int]:
    """Number of URLs that hold each literal token of the rules (one row a token)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = pages.select(F.explode(F.array_intersect(
        F.regexp_extract_all(F.lower(F.coalesce(F.col(url_col), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)),
        F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>"))).alias("t"))
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules=PATH_RULES + PATTERN_RULES, id_col: str = "page_id",
                url_col: str = "url", default: str = "allow", max_rules: int = 10_000) -> DataFrame:
    """Rows (id, host, path, rule, matched, verdict), one per input row.

    ``matched`` names the winning rule of any kind, ``rule`` only a path rule;
    the verdict is the winner's, else ``default``.  Null URLs and URLs without
    ``://`` have empty host and path.  Repeated rows stay repeated, an empty
    table gives no rows, other columns are ignored.  The rules travel to every
    task: more than ``max_rules`` are refused.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are sent to every task")
    index = Index(rules, token_counts(pages, rules, url_col))

    def run(batches):
        for b in batches:
            rows = []
            for url in b["url"]:
                host, path = host_path(url)
                won = index.judge(host + path)
                name, verdict, by_path = won or (None, default, False)
                rows.append((host, path, name if by_path else None, name, verdict))
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "matched", "verdict"], index=b.index)
            out.insert(0, "id", b["id"])
            yield out

    return told(pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url")).mapInPandas(
        run, "id string, host string, path string, rule string, matched string, verdict string"))


def oracle() -> str:
    """DuckDB SQL of the registered query."""
    rules = sorted(PATH_RULES, key=lambda r: -len(r.name))
    split = [(r, r.name.partition("/")) for r in rules]
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')", r) for r, (h, _, p) in split]
    method = " OR ".join(f"regexp_matches(host || path, '^(?:{r.pattern.replace('(?![a-z0-9])', '(?:[^a-z0-9]|$)')})')"
                         for r in PATTERN_RULES)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM a),
c AS (SELECT *, CASE {" ".join(f"WHEN {t} THEN '{r.name}'" for t, r in fits)} END AS rule FROM b)
SELECT page_id, host, path, rule, CASE rule {" ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in rules)}
  ELSE CASE WHEN {method} THEN 'block' ELSE 'allow' END END AS verdict FROM c
"""
