"""Texts that hold records: imports, manifests, citations, markers. Columns in, arrays out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What names an imported module, by language.
IMPORTS = {
    "py": (r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b", r"(?m)^[ \t]*import[ \t]+([.\w]+)"),
    "js": (r"""\bfrom[ \t]+['"]([^'"]+)['"]""", r"""\brequire\([ \t]*['"]([^'"]+)['"]""", r"""(?m)^[ \t]*import[ \t]+['"]([^'"]+)['"]"""),
    "go": (r"""(?m)^[ \t]*(?:import[ \t]+)?(?:\w+[ \t]+)?"([^"]+)"[ \t]*$""",),
    "rs": (r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)", r"(?m)^[ \t]*mod[ \t]+(\w+)[ \t]*;"),
    "java": (r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;",),
}
#: Fixed patterns: file:3-9, and "lines 3-9 in file".
CITED = r"(?<![\w/])([A-Za-z0-9_][A-Za-z0-9_.\-]*(?:/[A-Za-z0-9_.\-]+)*\.[A-Za-z0-9_]+):(\d+)(?:\s*[-–—]\s*(\d+))?"
IN_WORDS = r"(?i)\bLines?\s+(\d+)(?:\s*[-–—]\s*(\d+))?[*_\s]*\s*(?:in|from|of)\s+`?([A-Za-z0-9_][A-Za-z0-9_.\-]*(?:/[A-Za-z0-9_.\-]+)*\.[A-Za-z0-9_]+)`?"


def imported(text: Column, language: str) -> Column:
    """Distinct modules that a text of the language imports."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in IMPORTS[language]]
    return F.array_distinct(F.concat(*found))


def stem(module: Column) -> Column:
    """The last part of a path or dotted module (:: counts as a dot), without an extension of a path, in lower case."""
    module = F.replace(module, F.lit("::"), F.lit("."))
    tail = F.substring_index(F.substring_index(module, "/", -1), "\\", -1)  # leading dots stand before the last slash
    bare = F.when(tail.contains("."), F.regexp_replace(tail, r"\..*$", "")).otherwise(tail)
    return F.lower(F.when(module.contains("/"), bare).otherwise(F.substring_index(module, ".", -1)))


def requirements(text: Column) -> Column:
    """Array of (name, version): lines of a requirements file; a version only where one is pinned."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s*#.*$", ""))), lambda x: x.rlike(r"^[A-Za-z0-9]"))
    version = lambda x: F.nullif(F.regexp_extract(x, r"==\s*([A-Za-z0-9.]+)", 1), F.lit(""))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9._\-]+)", 1).alias("name"), version(x).alias("version")))


def package_json(text: Column) -> Column:
    """Array of (name, version) of dependencies and devDependencies; a version only where x.y.z remains without its range sign."""
    parsed = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    both = [F.coalesce(F.map_entries(parsed[k]), F.array().cast("array<struct<key:string,value:string>>")) for k in ("dependencies", "devDependencies")]
    version = lambda v: F.nullif(F.regexp_extract(v, r"^[\^~=v]*(\d+\.\d+\.\d+)", 1), F.lit(""))
    return F.transform(F.concat(*both), lambda e: F.struct(e["key"].alias("name"), version(e["value"]).alias("version")))


def claims(text: Column) -> Column:
    """Array of (file, start, end) cited as file:3-9 or "lines 3-9 in file", in the order of the text, each once; the end is the
    start where none is given."""
    found = F.regexp_extract_all(text, F.lit(f"(?:{IN_WORDS})|(?:{CITED})"), F.lit(0))

    def read(m: Column) -> Column:
        worded = m.rlike("(?i)^lines?\\s")
        part = lambda words, cited: F.when(worded, F.regexp_extract(m, IN_WORDS, words)).otherwise(F.regexp_extract(m, CITED, cited))
        start = part(1, 2).try_cast("int")
        return F.struct(part(3, 1).alias("file"), start.alias("start"), F.coalesce(part(2, 3).try_cast("int"), start).alias("end"))

    return F.array_distinct(F.transform(found, read))


def without_thoughts(text: Column) -> Column:
    """Without <think> blocks; an orphan closing tag goes too, an unfinished block stays."""
    return F.replace(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), F.lit("</think>"), F.lit(""))


def markers(text: Column) -> Column:
    """Array of (kind, body) of __KIND__body__KIND_END__ marks."""
    p = r"(?s)__([A-Z]+)__(.*?)__\1_END__"
    rows = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("body"))
    return rows


def cited_as(name: Column, start: Column, end: Column) -> Column:
    """f.py:3-9, f.py:3 or f.py."""
    return F.when(start.isNull(), name).when(end.isNull() | (start == end), F.concat_ws(":", name, start.cast("string"))).otherwise(F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def sections(text: Column) -> Column:
    """Array of (file, body) of FILE: name ... END FILE blocks."""
    p = r"(?sm)^FILE: ([^\n]+)\n(.*?)^END FILE"
    return F.arrays_zip(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.trim(x)).alias("file"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("body"))


def go_modules(text: Column) -> Column:
    """Array of (name, version) that a go.mod requires, on lines of their own or in a block."""
    pattern = r"(?m)^[ \t]*(?:require[ \t]+)?([a-z0-9.\-]+\.[a-z]+/[^\s]+)[ \t]+v(\d+\.\d+\.\d+)"
    take = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.zip_with(take(1), take(2), lambda n, v: F.struct(n.alias("name"), v.alias("version")))


#: The comments of a review, as they stand in JSON between fences.
COMMENTS = "array<struct<file:string,line:int,quote:string,comment:string>>"


def comments(text: Column, most: int = 12) -> Column:
    """Array of (file, line, quote, comment) of the fenced JSON blocks of a text, the first so many; a block that isn't such JSON has none."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))
    read = F.transform(blocks, lambda b: F.coalesce(F.from_json(b, COMMENTS), F.array().cast(COMMENTS)))
    return F.slice(F.filter(F.flatten(read), lambda c: c["quote"].isNotNull() & c["comment"].isNotNull()), 1, most)
