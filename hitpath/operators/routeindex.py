"""Grouping of request paths by long lists of routes, through an index of the literals that routes require.

A short list is a chain of conditions (:mod:`hitpath.operators.routes`). A list
of thousands would test every pattern on every path, in a plan as long as the
list. Here each route is filed under one literal path segment that every path
it matches must have: the rarest one of the list. A path looks its own segments
up, and only the routes it finds are tested. Several may match; the first of
the list wins.

The index is a stored table, whose size is counted when it is opened. Of up to
``MOST_BY_PLACE`` routes each row of a log looks up one place after the other;
below ``spark.sql.autoBroadcastJoinThreshold`` these joins are broadcasts, and
the log is neither shuffled nor sorted. Of more, the different paths of the log
look all their segments up in one join, and the rows then join their path's
route, so the log is shuffled as often whatever the number of places. Neither
routes nor index pass through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitpath.operators.routes import Route

#: Places in a path, counted by the slashes before them, that are looked up; paths beyond are caught by DEEP.
PLACES = 8
#: Filed under every place, because the route may begin anywhere in a path.
ANYWHERE = -1
#: Routes of an index that each row looks up place by place; longer ones are looked up by different paths.
MOST_BY_PLACE = 20_000
#: Looked up by all paths, and by all paths of more than PLACES segments.
ALWAYS, DEEP = 0, PLACES + 1

_ENTRY = "struct<route_id:int,pattern:string,java:string,names:array<string>>"
_ROUTE = f"route_id int, entry {_ENTRY}, place int, segment string"

# What a pattern is made of, as far as literals are concerned.
_ATOM = re.compile(
    r"(?P<literal>[^\\\[\](){}|^$.*+?])"
    r"|\\(?P<quoted>[^0-9A-Za-z])"
    r"|\\[dw]"
    r"|(?P<cls>\[(?:\\.|\[:\^?\w+:\]|[^\]\\])+\])",
    re.S,
)
_REPEAT = re.compile(r"[*+?]|\{[0-9]*,?[0-9]*\}")
#: Classes that cannot match a slash: ranges of letters or digits and characters other than it, or the negation of one that names it.
_WITHOUT_SLASH = re.compile(
    r"\[(?:-?(?:[A-Za-z0-9]-[A-Za-z0-9]|\\[dw.-](?!-)|[A-Za-z0-9_%~:,;=@!.](?!-[^\]]))*-?|\^/[^\]\\\[]*)\]"
)


def _group_end(text: str, at: int) -> int:
    """Where the group that opens at ``at`` ends, or -1 if that is not plain to see."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == "[":
            m = _ATOM.match(text, i)
            if not m:
                return -1
            i = m.end()
            continue
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def _slashless(text: str) -> bool:
    """Whether nothing in a group's text can match a slash."""
    i = 0
    while i < len(text):
        m = _ATOM.match(text, i)
        if m:
            if m["literal"] == "/" or m["quoted"] == "/" or (m["cls"] and not _WITHOUT_SLASH.fullmatch(m["cls"])):
                return False
            i = m.end()
        elif text[i] in "()|*+?{}":
            # Braces of a repetition; what stands in them are literals to the loop.
            i += 1
        else:
            return False
    return True


_GROUP_HEAD = re.compile(r"\((?:\?:|\?P?<\w+>)?")


def required_segments(pattern: str) -> list[tuple[int, str]]:
    """The whole path segments that every match of a route needs, as ``(place, segment)``.

    The place is the number of slashes before it, or ``ANYWHERE``. Nothing is
    found where the pattern leaves it open, and then only a test can tell.
    """
    if "(?" in re.sub(r"\(\?(?::|P?<\w+>)", "", pattern) or "\\Q" in pattern or "/" not in pattern:
        return []
    found: list[tuple[int, str]] = []
    anchored = pattern.startswith("^")
    i = 1 if anchored else 0
    # Slashes so far, if that is certain; the literal since the last one, if there is nothing else.
    slashes: int | None = 0 if anchored else None
    run: str | None = "" if anchored else None

    def close() -> None:
        if run is not None and (slashes or slashes is None):
            found.append((ANYWHERE if slashes is None else slashes, run))

    while i < len(pattern):
        m = _ATOM.match(pattern, i)
        if m:
            end, literal = m.end(), m["literal"] or m["quoted"]
            plain = literal is not None or not m["cls"] or bool(_WITHOUT_SLASH.fullmatch(m["cls"]))
        elif pattern[i] == "(":
            end, literal = _group_end(pattern, i), None
            if end < 0:
                return []
            plain = _slashless(pattern[_GROUP_HEAD.match(pattern, i).end() : end - 1])
        elif pattern[i] == ".":
            end, literal, plain = i + 1, None, False
        elif pattern[i] == "$" and i + 1 == len(pattern):
            close()
            return found
        else:
            # An alternative of the whole pattern, or something unknown.
            return []
        repeat = _REPEAT.match(pattern, end)
        while repeat:
            end, literal = repeat.end(), (None if literal != "/" else "")
            repeat = _REPEAT.match(pattern, end)
        if literal == "/":
            close()
            slashes = None if slashes is None else slashes + 1
            run = ""
        elif literal == "":
            # A slash that repeats, or may be missing.
            slashes, run = None, None
        elif literal is not None:
            run = None if run is None else run + literal
        else:
            run = None
            if not plain:
                slashes = None
        i = end
    return found


def _read_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per route and segment it requires, or one without."""
    for batch in batches:
        found = []
        for route_id, text in zip(*(column.to_pylist() for column in batch.columns)):
            route = Route(text)
            entry = {"route_id": route_id, "pattern": text, "java": route.java, "names": route.groups}
            keys = [(place, segment) for place, segment in required_segments(text) if place <= PLACES]
            for place, segment in keys or [(ALWAYS, "")]:
                found.append({"route_id": route_id, "entry": entry, "place": place, "segment": segment})
        yield pa.RecordBatch.from_pylist(found, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [
        ("route_id", pa.int32()),
        ("entry", pa.struct([("route_id", pa.int32()), ("pattern", pa.string()), ("java", pa.string()), ("names", pa.list_(pa.string()))])),
        ("place", pa.int32()),
        ("segment", pa.string()),
    ]
)


def write_route_index(table: DataFrame, path: str, pattern: str = "pattern", order: str = "route_id", mode: str = "errorifexists") -> None:
    """Store the index of a table of routes, whose first match by ``order`` is to win.

    Each route is filed under the rarest of its segments, or under none if it
    requires none; all paths test those. A null pattern is no route. Routes of
    equal order are taken by their pattern. Routes that may begin anywhere are
    stored once, and for a short list under every place as well.
    """
    rows = table.where(F.col(pattern).isNotNull()).select(F.col(order).cast("int").alias("route_id"), F.col(pattern).alias("pattern"))
    # Patterns are read in as many tasks as their number needs, whatever files they lie in; Spark cannot know how
    # many rows come of it, so it is told not to broadcast them.
    read = rows.repartition("route_id", "pattern").mapInArrow(_read_routes, _ROUTE)
    often = read.groupBy("place", "segment").agg(F.count("*").alias("routes"))
    rarest = F.min_by(F.struct("place", "segment"), F.struct("routes", "place", "segment"))
    filed = (
        read.join(often.hint("merge"), ["place", "segment"])
        .groupBy("route_id", F.col("entry.pattern").alias("pattern"))
        .agg(F.first("entry").alias("entry"), rarest.alias("key"))
        .select("entry", "key.place", "key.segment")
    )
    everywhere = F.col("place") == ANYWHERE
    short = rows.limit(MOST_BY_PLACE + 1).count() <= MOST_BY_PLACE
    places = F.when(everywhere & F.lit(short), F.sequence(F.lit(1), F.lit(DEEP))).otherwise(F.array("place"))
    spread = filed.select("entry", F.explode(places).alias("place"), "segment")
    (
        # A deep path's further segments are not looked up: it tests all routes that may begin there.
        spread.withColumn("segment", F.when(F.col("place") == DEEP, F.lit("")).otherwise(F.col("segment")))
        .groupBy("place", "segment")
        .agg(F.array_sort(F.collect_list("entry")).alias("routes"))
        .repartition("place", *([] if short else ["segment"]))
        .write.mode(mode)
        .partitionBy("place")
        .parquet(path)
    )


class RouteIndex:
    """A stored index; only the places in use, at most ``PLACES`` + 3 numbers, and how many routes each has are read when it is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = spark.read.schema(f"segment string, routes array<{_ENTRY}>, place int").parquet(path)
        found = dict(map(tuple, self.table.groupBy("place").agg(F.sum(F.size("routes"))).collect()))
        self.places = sorted(found)
        #: Whether rows look up place by place, as they can where routes of any place are filed under each of them.
        self.by_place = ANYWHERE not in found and (DEEP in found or max(found.values(), default=0) <= MOST_BY_PLACE)

    def _lookup(self, place: int, parts: Column, path: Column) -> Column:
        """The segment of a path that a place is looked up by; null if there is none."""
        if place == ALWAYS:
            return F.left(path, F.lit(0))
        if place == DEEP:
            return F.when(F.size(parts) > DEEP, F.left(path, F.lit(0)))
        return F.get(parts, place)

    def _filed(self, place: int) -> DataFrame:
        """What a place is to be looked up in."""
        here = self.table.where(F.col("place") == place).select("segment", "routes")
        if place == ALWAYS or ANYWHERE not in self.places:
            return here
        segment = F.lit("") if place == DEEP else F.col("segment")
        anywhere = self.table.where(F.col("place") == ANYWHERE).select(segment.alias("segment"), "routes")
        return here.unionByName(anywhere).groupBy("segment").agg(F.flatten(F.collect_list("routes")).alias("routes"))

    def match(self, entries: DataFrame, path: str = "path") -> DataFrame:
        """``entries`` with ``route``, the first matching route as a struct, or NULL."""
        return self._by_place(entries, path) if self.by_place or entries.isStreaming else self._by_path(entries, path)

    def _by_place(self, entries: DataFrame, path: str) -> DataFrame:
        parts = F.split(F.col(path), "/")
        rows, lists = entries.withColumn("_parts", parts), []
        places = self.places if ANYWHERE not in self.places else sorted({*self.places, *range(1, DEEP + 1)} - {ANYWHERE})
        for place in places:
            key, found = f"_key{place}", f"_found{place}"
            side = self._filed(place).select(F.col("segment").alias(key), F.col("routes").alias(found))
            rows = rows.join(side, self._lookup(place, F.col("_parts"), F.col(path)) == F.col(key), "left")
            lists.append(F.coalesce(found, F.array().cast(f"array<{_ENTRY}>")))
        none = F.lit(None).cast(_ENTRY)
        route = F.array_min(_hits(F.concat(*lists), F.col(path))) if lists else none
        return rows.select(*entries.columns, route.alias("route"))

    def _by_path(self, entries: DataFrame, path: str) -> DataFrame:
        """One join of the segments of all different paths, at any depth, and one of the rows with the routes found."""
        paths = entries.select(F.col(path).alias("_path")).where("_path IS NOT NULL").distinct()
        segments = paths.select("_path", F.posexplode(F.split("_path", "/")).alias("_at", "segment")).where("_at > 0")
        filed = self.table.where(F.col("place") != ALWAYS)
        found = segments.join(filed, "segment").where((F.col("place") == ANYWHERE) | (F.col("place") == F.col("_at")))
        if ALWAYS in self.places:
            always = paths.join(self._filed(ALWAYS), self._lookup(ALWAYS, None, F.col("_path")) == F.col("segment"))
            found = found.select("_path", "routes").unionByName(always.select("_path", "routes"))
        hits = found.select("_path", F.array_min(_hits(F.col("routes"), F.col("_path"))).alias("_route"))
        first = hits.groupBy("_path").agg(F.min("_route").alias("_route"))
        rows = entries.join(first, F.col(path) == F.col("_path"), "left")
        return rows.select(*entries.columns, F.col("_route").alias("route"))


def _hits(routes: Column, path: Column) -> Column:
    return F.filter(routes, lambda r: F.rlike(path, r["java"]))


def apply_route_index(entries: DataFrame, index: RouteIndex) -> DataFrame:
    """Set ``route_id`` and replace ``uri`` by the text of the matching route, as ``apply_routes`` does."""
    kept = [c for c in entries.columns if c != "route"]
    return index.match(entries.select(*kept)).withColumns(
        {"route_id": F.col("route.route_id"), "uri": F.coalesce("route.pattern", "path")}
    ).select(*kept)


def route_params(entries: DataFrame, index: RouteIndex) -> DataFrame:
    """How often each value of each group of a route occurs: ``(method, uri, position, name, value, count)``.

    The groups are read by the pattern of the row's own route.
    """
    rows = entries.select("method", "path")
    if index.by_place or entries.isStreaming:
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy("method", "path").agg(F.count("*").alias("_n"))
    routed = index.match(rows).where("route IS NOT NULL")
    names = F.col("route.names")
    values = F.transform(
        names,
        lambda name, i: F.struct(
            (i + 1).alias("position"),
            name.alias("name"),
            F.call_function("regexp_extract", F.col("path"), F.col("route.java"), i + 1).alias("value"),
        ),
    )
    rows = routed.select("method", F.col("route.pattern").alias("uri"), "_n", F.inline(values))
    return rows.groupBy("method", "uri", "position", "name", "value").agg(F.sum("_n").alias("count"))
