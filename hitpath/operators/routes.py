"""Grouping of request paths by an ordered list of route patterns."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Routes of a table that may become conditions of a plan.
MOST_IN_PLAN = 500

# POSIX class names and their Java spelling.
_POSIX = {
    "alnum": "\\p{Alnum}",
    "alpha": "\\p{Alpha}",
    "ascii": "\\p{ASCII}",
    "blank": "\\p{Blank}",
    "cntrl": "\\p{Cntrl}",
    "digit": "\\p{Digit}",
    "graph": "\\p{Graph}",
    "lower": "\\p{Lower}",
    "print": "\\p{Print}",
    "punct": "\\p{Punct}",
    "space": "\\p{Space}",
    "upper": "\\p{Upper}",
    "word": "\\w",
    "xdigit": "\\p{XDigit}",
}

# What may stand in a pattern, as far as groups are concerned: an escape, a
# bracketed class, a named group, any other "(?" construct, a plain group; and
# the end of the text.
_PIECE = re.compile(
    r"(?P<escape>\\Q.*?(?:\\E|$)|\\.)"
    r"|(?P<cls>\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\])"
    r"|(?P<named>\(\?P?<(?P<name>\w+)>)"
    r"|(?P<special>\(\?)"
    r"|(?P<plain>\()"
    r"|(?P<end>\$)",
    re.S,
)


def _java_class(text: str) -> str:
    """A bracketed class for Java, where ``[`` and ``&&`` inside would mean nesting and intersection."""

    def piece(m: re.Match) -> str:
        if m["name"] in _POSIX:
            found = _POSIX[m["name"]]
            return f"[^{found}]" if m["not"] else found
        return {"[": "\\[", "&&": "&\\&"}.get(m[0], m[0])

    return "[" + re.sub(r"\\.|\[:(?P<not>\^?)(?P<name>\w+):\]|\[|&&", piece, text[1:], flags=re.S)


class Route:
    """One pattern: its text, its Java form, and the names of its groups.

    The Java form takes only a newline for the end of a line, and ``$`` for
    the very end of the path unless the pattern asks for lines.
    """

    def __init__(self, text: str):
        self.text = text
        self.groups: list[str] = []
        self._end = "$" if re.search(r"\(\?[a-zA-Z]*m", text) else "\\z"
        self.java = "(?d)" + _PIECE.sub(self._piece, text)

    def _piece(self, m: re.Match) -> str:
        if m["cls"]:
            return _java_class(m["cls"])
        if m["named"]:
            self.groups.append(m["name"])
            return "("
        if m["end"]:
            return self._end
        if m["special"] and re.match("[a-zA-Z]*U", m.string[m.end() :]):
            raise ValueError(f"pattern {self.text!r}: the ungreedy flag U has another meaning in Java; use lazy repetition")
        if m["plain"]:
            self.groups.append("")
        return m[0]


class Routes:
    """An ordered list of route patterns; the first match wins."""

    def __init__(self, patterns: Iterable[str] = ()):
        self.routes = [Route(text) for text in patterns]
        for route in self.routes:
            if not route.groups:
                warnings.warn(f"pattern {route.text!r} captures nothing", stacklevel=2)

    @classmethod
    def from_table(cls, table: DataFrame, pattern: str = "pattern", order: str = "route_id") -> Routes:
        """Take the patterns from a configuration table, in ``order``.

        The list becomes part of the plan, so it must be short: of more than
        ``MOST_IN_PLAN`` make an index, see :mod:`hitpath.operators.routeindex`.
        """
        found = table.select(order, pattern).orderBy(order).limit(MOST_IN_PLAN + 1).collect()
        if len(found) > MOST_IN_PLAN:
            raise ValueError(f"more than {MOST_IN_PLAN} routes would be part of the plan; use write_route_index")
        return cls(row[1] for row in found)

    def __len__(self) -> int:
        return len(self.routes)

    def match(self, path: Column) -> Column:
        """Index of the first pattern found anywhere in ``path``, or NULL."""
        return self._choose([path.rlike(r.java) for r in self.routes], list(range(len(self)))).cast("int")

    def by_id(self, route_id: Column, values: list) -> Column:
        """The entry of ``values`` for a route id; NULL for unrouted rows."""
        return self._choose([route_id == i for i in range(len(self))], values)

    @staticmethod
    def _choose(tests: list[Column], values: list) -> Column:
        if not tests:
            return F.lit(None)
        chain = F
        for test, value in zip(tests, values, strict=True):
            chain = chain.when(test, value)
        return chain


def apply_routes(entries: DataFrame, routes: Routes | Iterable[str]) -> DataFrame:
    """Set ``route_id`` and replace ``uri`` by the text of the matching pattern.

    The match is a chain of conditions over constant patterns: no join and no
    shuffle, and each pattern is compiled once per task.
    """
    if not isinstance(routes, Routes):
        routes = Routes(routes)
    if not len(routes):
        return entries
    texts = [r.text for r in routes.routes]
    return entries.withColumn("route_id", routes.match(F.col("path"))).withColumn(
        "uri", F.coalesce(routes.by_id(F.col("route_id"), texts), F.col("path"))
    )
