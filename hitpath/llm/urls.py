"""URL filters by pattern rules indexed under their rarest literal token.

A rule is a regular expression over host and path with the literal tokens it
cannot match without. It is filed under the one of them that is rarest among
the URLs at hand. The tokens of a URL fetch candidate rules, and only those run.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
_token = re.compile(TOKEN)


class Rule(NamedTuple):
    """``name`` is what a verdict cites, null for patterns; the longest name of the fitting rules wins."""

    action: str
    name: str | None
    pattern: str
    tokens: tuple[str, ...]


def site_rule(action: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and the paths that begin with ``path``."""
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # The last token of a path may go on in a URL, unless something ends it.
    ended = path[: path.rfind("/") + 1]
    return Rule(action, host + path, pattern, tuple(_token.findall((host + " " + ended).lower())))


def word_rule(word: str) -> Rule:
    """A pattern that blocks a word standing alone in host or path."""
    return Rule("block", None, rf"(?i)(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", tuple(_token.findall(word.lower())))


#: The rules of the query.
RULES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)
#: Words of hosts and paths that tell junk where no rule fits.
JUNK_WORDS = tuple("adult ads bets betting casino cheap-pills doubleclick poker porn pills spam viagra xxx".split())
JUNK = tuple(word_rule(w) for w in JUNK_WORDS)


def host_of(url: str = "url") -> Column:
    return F.translate(
        F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(parts: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; as many entries as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = parts.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit(TOKEN), F.lit(0))))
        .alias("token")
    )
    return {r["token"]: r["count"] for r in found.where(F.col("token").isin(wanted)).groupBy("token").count().collect()}


def index(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; those without any are under the empty token, which every URL has."""
    filed = defaultdict(list)
    for rule in rules:
        filed[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(filed)


def verdict(host: str, path: str, filed: dict[str, list[tuple]], default: str = "allow") -> tuple[str | None, str]:
    """The rule and the verdict for one URL; a named rule comes before any pattern, a longer one before a shorter."""
    subject = host + path
    tokens = {"", *_token.findall(host), *_token.findall(path.lower())}
    fits = [(r.name is not None, len(r.name or ""), r) for t in tokens for r, p in filed.get(t, ()) if p.search(subject)]
    if not fits:
        return None, default
    best = max(fits, key=lambda f: (*f[:2], f[2].name or "", f[2].action))[2]
    return best.name, best.action


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES + JUNK, default: str = "allow") -> DataFrame:
    """Host, path, rule and verdict of every page's URL.

    The host follows the first ``://``, up to ``/``, ``?`` or ``#``, A-Z in
    lower case; the path goes from there up to ``?`` or ``#``. A null URL and
    one without ``://`` have neither, no rule fits them, and they are allowed. Each row is judged by
    itself, so repeated ids and rows, and those with null ids, stay as they are;
    an empty table gives an empty one, and columns other than id and URL are
    not read. Of named rules of the same length the last by name wins, of equal
    ones and of patterns blocking does. The rules are an argument and travel
    with the tasks.
    """
    parts = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    filed = index(rules, token_counts(parts, rules))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {t: [(r, re.compile(r.pattern)) for r in rs] for t, rs in filed.items()}
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [verdict(h, p, ready, default) for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return parts.mapInArrow(work, "page_id long, host string, path string, rule string, verdict string")
