"""Light clean-up of Markdown documents that changes no wording and no code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import chain, strip

FENCE = r"(?m)^```[\s\S]*?^```"


def cleaned_prose(text: Column) -> Column:
    """No spaces at line ends, at most one blank line in a row, bullets as "- ", a blank line before headings."""
    return chain(text, (r"(?m)[ \t]+$", ""), (r"\n[ \t]*(?:\n[ \t]*)+\n", "\n\n"), (r"(?m)^(\s*)[*+]\s", "$1- "), (r"(?m)(?<=\n)(?<!\n\n)(?<!^#{1,3}\s.{0,200}\n)(?=#{1,3}\s)", "\n"))


def conservative(text: Column) -> Column:
    """cleaned_prose() of what stands outside fenced code, with a line end at the end; empty for blank texts."""
    code = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    prose = F.split(text, FENCE, -1)
    mark = "\x02"
    whole = cleaned_prose(F.array_join(prose, mark))
    pieces = F.split(whole, mark, -1)
    filled = F.array_join(F.flatten(F.zip_with(pieces, F.concat(code, F.array(F.lit(""))), lambda p, c: F.array(p, c))), "")
    return F.when(strip(text) == "", "").when(F.endswith(filled, F.lit("\n")), filled).otherwise(F.concat(filled, F.lit("\n")))
