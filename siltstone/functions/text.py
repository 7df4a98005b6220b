"""Lines of a text, and matches in a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two code points that Unicode reserves for use inside a program
_OPEN, _CLOSE = "﷐", "﷑"


def lines(text: Column) -> Column:
    """Array of lines: one trailing line feed goes; what is then empty has no line."""
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(body != "", F.split(body, "\n", -1)).otherwise(F.array().cast("array<string>"))


def without_cr(line: Column) -> Column:
    """For display, after matching."""
    return F.regexp_replace(line, r"\r\z", "")


def _marked(line: Column, java: str) -> Column:
    return F.regexp_replace(line, java, f"{_OPEN}$0{_CLOSE}")


def spans(line: Column, java: str) -> Column:
    """Non-empty matches in order: array of (start, end, text), in characters."""
    parts = F.split(_marked(line, java), _OPEN)
    first = F.length(parts[0])
    start = F.struct(first.alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found"))

    def step(a: Column, part: Column) -> Column:
        text = F.substring_index(part, _CLOSE, 1)
        size = F.length(text)
        span = F.struct(a["at"].alias("start"), (a["at"] + size).alias("end"), text.alias("text"))
        return F.struct((a["at"] + F.length(part) - 1).alias("at"), F.when(size > 0, F.array_append(a["found"], span)).otherwise(a["found"]).alias("found"))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda a: a["found"])


def highlighted(line: Column, java: str, opening: str = "[", closing: str = "]") -> Column:
    """The line with marks around its non-empty matches."""
    marked = F.replace(_marked(line, java), F.lit(_OPEN + _CLOSE), F.lit(""))
    return F.replace(F.replace(marked, F.lit(_OPEN), F.lit(opening)), F.lit(_CLOSE), F.lit(closing))
