"""Columns derived from the raw request line: method, path and query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_after(text: Column, mark: str) -> Column:
    """The part of ``text`` behind the first ``mark``; empty without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + F.lit(1))).otherwise(F.lit(""))


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with their columns fixed as computed values.

    A predicate on a derived column is normally moved below the projection
    and repeats its expressions there. For columns made by chains of regular
    expressions that costs more than it saves, and exploding the row as one
    struct keeps such predicates above.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


# The request target taken apart, one projection per step: each step reads
# columns of the steps before it, so no expression is repeated in the plan.
_STEPS = (
    {"_rest_of_line": "CASE WHEN instr(_line, ' ') > 0 THEN substr(_line, instr(_line, ' ') + 1) ELSE '' END"},
    {"_target": "substring_index(_rest_of_line, ' ', 1)"},
    {
        "_body": "substring_index(_target, '#', 1)",
        "_fragment": "CASE WHEN instr(_target, '#') > 0 THEN substr(_target, instr(_target, '#') + 1) ELSE '' END",
    },
    {"_scheme": "NOT startswith(_body, '/') AND _body RLIKE r'^[A-Za-z][A-Za-z0-9+.-]*:'"},
    {"_rest": "CASE WHEN _scheme THEN substr(_body, instr(_body, ':') + 1) ELSE _body END"},
    {"_before": "substring_index(_rest, '?', 1)"},
    {
        "_rooted": "startswith(_before, '/')",
        "_has_host": "startswith(_before, '//') AND (_scheme OR NOT startswith(_before, '///'))",
    },
    {
        "_port": r"""CASE WHEN _has_host THEN regexp_extract(regexp_replace(
                regexp_extract(_before, r'^//([^/]*)', 1), r'^.*@', ''), r'(:[^:\]]*)$', 1) ELSE '' END""",
        "_encoded": """CASE WHEN _has_host THEN regexp_replace(_before, r'^//[^/]*', '')
                WHEN _rooted OR NOT _scheme THEN _before ELSE '' END""",
    },
    {
        "_valid": r"""instr(_line, ' ') > 0
                AND NOT _target RLIKE r'[\x00-\x1f\x7f]'
                AND (_rooted OR _scheme OR instr(substring_index(_before, '/', 1), ':') = 0)
                AND (_port = '' OR _port RLIKE r'^:[0-9]*$')
                AND (_fragment = '' OR NOT _fragment RLIKE r'%(?![0-9A-Fa-f]{2})')
                AND (instr(_encoded, '%') = 0 OR NOT _encoded RLIKE r'%(?![0-9A-Fa-f]{2})')""",
    },
    # A plus sign stands for itself in a path.
    {
        "_path": """CASE WHEN NOT _valid THEN NULL WHEN instr(_encoded, '%') = 0 THEN _encoded
                ELSE try_url_decode(replace(_encoded, '+', '%2B')) END""",
    },
    {
        "method": "CASE WHEN _path IS NULL THEN '' ELSE substring_index(_line, ' ', 1) END",
        "path": "coalesce(_path, '')",
        "query": """CASE WHEN _path IS NULL OR instr(_rest, '?') = 0 THEN ''
                ELSE substr(_rest, instr(_rest, '?') + 1) END""",
    },
)


def with_request_parts(df: DataFrame, req: str = "req") -> DataFrame:
    """Add ``method``, ``path`` and ``query`` parsed from the request line.

    A line with no space, or with a target that is not a valid URL, yields
    three empty strings. The path is percent-decoded, the query is not. Finish
    with :func:`computed_once` where callers may filter on the result.
    """
    kept = df.columns
    df = df.withColumn("_line", F.col(req))
    for step in _STEPS:
        df = df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in step.items()))
    return df.select(*kept, "method", "path", "query")


def endpoint() -> Column:
    """The key every analysis groups by: method, space, URI."""
    return F.concat_ws(" ", "method", "uri")
