"""URL filters: host and path rules by longest match, and glob rules run all at once by a bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Glob rules that block: * any characters, ? one character; they are held against the whole canonical URL.
BLOCK_GLOBS = (
    "*://*adult*", "*://*porn*", "*://*xxx*", "*://*casino*", "*://*free-bets*", "*://*betting*", "*://*-pills*", "*://*pharma-deal*",
    "*://*spam-*", "*://*link-farm*", "*://ads-*", "*://*.ads-*", "*://*doubleclick*", "*://*phish*", "*://*warez*", "*://*torrent*",
    "*://*/wp-login*", "*://*/cgi-bin/*", "*://*.exe", "*://*.apk", "*://*.zip",
)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty for null or where there is no ://."""
    from loomspark.llm.words import lowered

    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or where there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host_col: Column, path_col: Column, rules=HOST_RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null; of equally long ones the first named."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def canonical(url: str | None) -> str:
    """Scheme and host in lower case, no user, default port or fragment, percent signs decoded; null gives ''."""
    head, sep, rest = (url or "").strip().partition("://")
    if not sep:
        return unquote(head.partition("#")[0])
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    name = rest[:end].rpartition("@")[2].lower().removesuffix(":80").removesuffix(":443").removesuffix(".")
    tail = rest[end:].partition("#")[0]
    return f"{head.lower()}://{name}{unquote(tail) if '%' in tail else tail}"


class GlobAutomaton:
    """Shift-And over words of 64 bits: a bit for each character of each pattern, set while the text read so far
    ends in a match of the pattern up to it. A star after a character keeps its bit set; a star at the front lets the
    pattern start anywhere. One step of a text moves all patterns; rows of a batch step side by side in numpy."""

    def __init__(self, globs):
        chars, starts, free, loops, ends = [], [], [], [], []
        self.always, self.blank, self.n = [], [], len(globs)
        for g, glob in enumerate(globs):
            begin = len(chars)
            for i, c in enumerate(glob):
                if c == "*":
                    if len(chars) > begin:
                        loops.append(len(chars) - 1)
                    continue
                if len(chars) == begin:
                    starts.append(begin)
                    if glob[:i].count("*"):
                        free.append(begin)
                chars.append(c)
            if len(chars) == begin:
                (self.always if glob else self.blank).append(g)  # only stars, or nothing, in it
            else:
                ends.append((len(chars) - 1, g))
        self.words = max(1, -(-len(chars) // 64))
        self.start, self.free, self.loop = (self._mask(x) for x in (starts, free, loops))
        self.ends = ends
        self.accept = self._mask([bit for bit, _ in ends])
        self.code = {c: k + 1 for k, c in enumerate(sorted(set(chars) - {"?"}))}
        self.table = np.array([self._mask([i for i, x in enumerate(chars) if x in ("?", c)]) for c in ["", *sorted(self.code)]])

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix, texts by patterns. Rows run longest first, so that those still running are a prefix."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        top = max(map(ord, self.code), default=0) + 1
        lookup = np.zeros(top + 1, np.uint8 if len(self.code) < 255 else np.uint32)
        for c, k in self.code.items():
            lookup[ord(c)] = k
        codes = lookup[np.minimum(points, top)]
        begin = (np.cumsum(lengths) - lengths)[order]
        running = lengths[order]
        state = np.zeros((len(texts), self.words), np.uint64)
        alive = len(texts)
        for t in range(int(lengths.max(initial=0))):
            while alive and running[alive - 1] <= t:
                alive -= 1
            now = state[:alive]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= ~self.start  # no pattern goes on into the next one
            moved |= self.start if t == 0 else self.free
            state[:alive] = (moved & self.table[codes[begin[:alive] + t]]) | (now & self.loop)
        out = np.zeros((len(texts), self.n), bool)
        out[:, self.always] = True
        out[np.ix_(lengths == 0, self.blank)] = True
        for bit, g in self.ends:
            out[order, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def matched_globs(url: Column, globs=BLOCK_GLOBS) -> Column:
    """The globs that fit the canonical URL, in the order given, as an array."""
    automaton = GlobAutomaton(globs)

    @F.pandas_udf("array<string>")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            hits = automaton.match([canonical(u) for u in urls])
            yield pd.Series([[globs[g] for g in np.flatnonzero(row)] for row in hits], dtype=object)

    return matched(url)


def judged(pages: DataFrame, rules=HOST_RULES, globs=BLOCK_GLOBS) -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule (or null), verdict, globs (those that fit).

    A host rule decides if one fits; else a url is blocked if any glob fits its canonical form. A null url has an
    empty host and path, fits no rule and is held against the globs as ''. Equal rows give equal rows; other columns
    of pages are not read.
    """
    found = pages.select("page_id", F.col("url").cast("string").alias("url"))
    found = found.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), matched_globs(F.col("url"), globs).alias("globs"))
    found = found.select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("fit"))
    own = F.when(F.size("globs") > 0, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "globs")
