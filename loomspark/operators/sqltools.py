"""Table functions for SQL users: the tools of a review, called as ``FROM files, LATERAL search_pattern(text, 'eval')``.

They are SQL functions, so Catalyst unfolds them into the calling query: no Python and no join is left in its plan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Fixed patterns: lines that define a function, method or class.
DEFINITIONS = (
    r"^\s*(async\s+def|def|class)\s+\w",
    r"^\s*(export\s+)?(async\s+)?function\s+\w",
    r"^\s*(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s*)?\(",
    r"^\s*(export\s+)?(default\s+)?class\s+\w",
    r"^\s*func\s+(\(\w+\s+\*?\w+\)\s+)?\w+\s*\(",
    r"^\s*(public|private|protected|static|override|abstract).*\s+\w+\s*\(",
    r"^\s*(pub(\(.*\))?\s+)?(async\s+)?fn\s+\w",
)
#: Hits that a search tells of a text.
HITS = 30

_LINES = r"transform(split(body, '\n'), (b, i) -> struct(i + 1 AS line, b AS shown))"
_SHOWN = r"regexp_replace(h.shown, '\\s+$', '')"
_TOOLS = {
    # Lines that match, in either case, with numbers from 1.
    "search_pattern": (
        f"body STRING, pattern STRING, most INT DEFAULT {HITS}",
        "line INT, shown STRING",
        f"SELECT h.line, {_SHOWN} FROM inline(slice(filter({_LINES}, x -> x.shown rlike concat('(?i)', pattern)), 1, most)) AS h(line, shown)",
    ),
    # Lines that define something, cut to 80 characters.
    "function_list": (
        "body STRING",
        "line INT, shown STRING",
        f"SELECT h.line, left({_SHOWN}, 80) FROM inline(filter({_LINES}, x -> x.shown rlike {{definitions}})) AS h(line, shown)",
    ),
    # One row of counts for a text.
    "complexity_indicators": (
        "body STRING",
        "total_lines INT, long_lines INT, todo_comments INT, magic_numbers INT",
        r"""SELECT size(split(body, '\n')), size(filter(split(body, '\n'), x -> length(x) > 120 and not x rlike '^\\s*$')),
            size(filter(split(body, '\n'), x -> x rlike '(?i)\\b(TODO|FIXME|HACK)\\b')),
            size(filter(split(body, '\n'), x -> trim(x) rlike '(?<![=\\w])\\b[0-9]{2,}\\b(?!\\s*[=\\w])'))""",
    ),
}


def registered(spark: SparkSession) -> SparkSession:
    """The session with the table functions as temporary ones of it.

    search_pattern(body, pattern, most = 30) gives (line, shown); a pattern that is no regular expression is an error.
    function_list(body) gives (line, shown); complexity_indicators(body) gives one row of counts. A null text has no lines
    and null counts.
    """
    literal = "'" + "|".join(f"(?:{p})" for p in DEFINITIONS).replace("\\", "\\\\").replace("'", "\\'") + "'"
    for name, (takes, gives, body) in _TOOLS.items():
        body = body.replace("{definitions}", literal)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
    return spark
