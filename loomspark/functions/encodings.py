"""Which encoding the bytes of a file are in, and their text: marks first, then statistics of bytes, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.arrays import let, let_all

#: Share of zero bytes in one half of all byte pairs from which, and in the other half up to which, unmarked bytes are UTF-16.
ZEROS, OTHERS = 0.3, 0.05
#: Windows-1252 has characters of its own where Latin-1 has control codes, but for five bytes that stand for nothing.
WINDOWS = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_CODES = "".join(map(chr, WINDOWS))
_CHARACTERS = "".join(WINDOWS.values())


def _pairs(big: bool) -> str:
    """One UTF-16 character right after the last one, over bytes read as Latin-1."""
    plain, high, low = r"[\x00-\xD7\xE0-\xFF]", r"[\xD8-\xDB]", r"[\xDC-\xDF]"
    return rf"(?s)\G(?:{plain}.|{high}.{low}.)" if big else rf"(?s)\G(?:.{plain}|.{high}.{low})"


def _whole(latin: Column, big: bool) -> Column:
    """Whether the bytes are whole UTF-16 characters. Without a byte of a surrogate any pairs are; else characters are taken out one
    after the other, and nothing may be left."""
    even = F.length(latin) % 2 == 0
    return even & (~latin.rlike(r"[\xD8-\xDF]") | (F.regexp_replace(latin, _pairs(big), "") == ""))


def _wide(latin: Column) -> Column:
    """'utf-16le' or 'utf-16be' if zero bytes fill one half of the pairs and hardly any of the other, else null."""
    zeros = lambda x: F.length(x) - F.length(F.translate(x, "\0", ""))

    def judged(v: Column) -> Column:
        pairs = F.length(v["odd"])
        odd, even = zeros(v["odd"]) / pairs, (zeros(v["latin"]) - zeros(v["odd"])) / pairs
        little = (odd >= ZEROS) & (even <= OTHERS) & _whole(v["latin"], False)
        big = (even >= ZEROS) & (odd <= OTHERS) & _whole(v["latin"], True)
        return F.when(little, "utf-16le").when(big, "utf-16be")

    def halved(text: Column) -> Column:
        return let_all({"latin": text, "odd": F.regexp_replace(text, r"(?s)(.)(.)", "$2")}, judged)

    return F.when(latin.contains("\0") & (F.length(latin) % 2 == 0), halved(latin))


def decoded(content: Column) -> Column:
    """Struct (text, encoding) of a binary column.

    utf-8 (a mark is taken off), utf-16le, utf-16be (marked, or told by where the zero bytes are), else windows-1252 if it has
    bytes of 0x80 to 0x9F that mean something there, else iso-8859-1, which any bytes are. Bytes with a zero that are none of
    the first three are binary, with a null text. Empty content is an empty utf-8 text, null stays null. UTF-32 isn't told apart.
    Each step is linear in the bytes and none can fail, so one broken file never ends a job.
    """

    def told(v: Column) -> Column:
        latin, bytes_, wide = v["latin"], v["bytes"], v["wide"]
        marked = lambda mark: latin.startswith(mark)
        behind = lambda n: F.substring(bytes_, F.lit(n + 1), F.length(latin) - n)
        after = lambda n: F.substring(latin, F.lit(n + 1), F.length(latin) - n)
        result = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("encoding"))
        as_utf8 = lambda b: F.try_validate_utf8(b.cast("string"))
        return (
            F.when(marked("\xef\xbb\xbf") & as_utf8(behind(3)).isNotNull(), result(as_utf8(behind(3)), "utf-8"))
            .when(marked("\xff\xfe") & _whole(after(2), False), result(F.decode(behind(2), "UTF-16LE"), "utf-16le"))
            .when(marked("\xfe\xff") & _whole(after(2), True), result(F.decode(behind(2), "UTF-16BE"), "utf-16be"))
            .when(wide == "utf-16le", result(F.decode(bytes_, "UTF-16LE"), "utf-16le"))
            .when(wide == "utf-16be", result(F.decode(bytes_, "UTF-16BE"), "utf-16be"))
            .when(as_utf8(bytes_).isNotNull(), result(as_utf8(bytes_), "utf-8"))
            .when(latin.contains("\0"), result(F.lit(None).cast("string"), "binary"))
            .when(latin.rlike(f"[{_CODES}]"), result(F.translate(latin, _CODES, _CHARACTERS), "windows-1252"))
            .otherwise(result(latin, "iso-8859-1"))
        )

    def read_as(c: Column) -> Column:
        return let(F.decode(c, "ISO-8859-1"), lambda latin: let_all({"bytes": c, "latin": latin, "wide": _wide(latin)}, told))

    read = let(content, read_as)
    return F.when(content.isNotNull(), read)
