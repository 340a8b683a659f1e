"""Scalar text primitives as columns. Regular expressions of the analyzer are Unicode-aware: rx() adds Java's flag for it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF


def rx(pattern: str, flags: str = "") -> str:
    r"""\w, \d, \s and \b by Unicode, as the analyzer's expressions mean them."""
    return f"(?U{flags}){pattern}"


ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def plain_rx(pattern: str, flags: str = "iu") -> str:
    r"""An expression that means ASCII by \w, \d and \s; \b, which Java takes by Unicode before version 19, is written out."""
    return f"(?{flags})" + pattern.replace(r"\b", ASCII_EDGE)


def alternation(words: Iterable[str]) -> str:
    """One expression for any of some literal words, longer ones first."""
    special = ".^$*+?()[]{}|\\-"
    quoted = ("".join("\\" + c if c in special else c for c in w) for w in words)
    return "(?:" + "|".join(sorted(quoted, key=len, reverse=True)) + ")"


def stripped(text: Column, parts: Column) -> Column:
    """strip() of each part of a text, whose parts have no line ends; where it has no other white space than those and spaces, by less work."""
    return F.when(text.rlike(r"(?U)[\s&&[^ \n]]"), F.transform(parts, strip)).otherwise(F.transform(parts, lambda p: F.trim(p)))


def sentences(text: Column) -> Column:
    """Pieces between . ! ? and line ends; without headings and rules."""
    parts = stripped(text, F.split(text, "[.!?\n]", -1))
    return F.filter(parts, lambda s: (s != "") & ~F.startswith(s, F.lit("#")) & ~s.rlike(r"^[-*_=~]{3,}$"))


def router_sentences(text: Column) -> Column:
    """As sentences(), also cut at semicolons, with structural lines."""
    return F.filter(stripped(text, F.split(text, "[.!?;\n]", -1)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda s: s != "")


#: What the expression (?U)\s stands for.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x: Column) -> Column:
    """Without white space at either end, by Unicode."""
    return F.btrim(x, F.lit(WHITE_SPACE))


def placeholders(text: Column) -> Column:
    """Distinct names in braces, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rx(r"\{(\w+)\}")), F.lit(1)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def content_tokens(text: Column, stopwords: Iterable[str]) -> Column:
    """Tokens of four bytes or more that are neither numbers nor stopwords."""
    # What begins with a letter is no number.
    return F.filter(tokens(text), lambda t: (F.octet_length(t) >= 4) & ~t.isin(*sorted(stopwords)) & (((t >= "a") & (t < "{")) | ~t.rlike(r"^\p{Nd}+$")))


def is_substantive(text: Column) -> Column:
    """More than 25 bytes, or a token of five bytes or more of letters and digits that isn't a number."""
    return (F.octet_length(text) > 25) | F.exists(F.split(text, r"(?U)\s+", -1), lambda t: (F.octet_length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) >= 5) & ~t.rlike(r"^\p{Nd}+$"))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return F.lower(text).rlike(alternation(w.lower() for w in words))


def contains_word(text: Column, words: Iterable[str]) -> Column:
    """Any of the words with no letter or digit beside it; a plural s is allowed."""
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}_]){alternation(w.lower() for w in words)}s?(?![\p{{L}}\p{{N}}_])")


def line_of(text: Column, start: Column) -> Column:
    """1-based line of a 0-based place in code points."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """1-based byte in its line of a 0-based place in code points."""
    return F.octet_length(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)) + 1


def mask_secret(x: Column) -> Column:
    return F.when(F.octet_length(x) <= 8, "***").otherwise(F.concat(F.left(x, F.lit(4)), F.lit("..."), F.right(x, F.lit(4))))


def squeeze(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def truncate_bytes(x: Column, most: int) -> Column:
    """The longest prefix of whole characters within `most` bytes."""
    data = F.substring(F.encode(x, "UTF-8"), 1, most + 1)
    # A character is cut if the byte after the prefix continues it; then its up to three bytes before go too.
    cut = F.regexp_replace(F.hex(data), f"^((?:..){{{most}}})[89AB].*$", "$1!")
    whole = F.when(F.endswith(cut, F.lit("!")), F.regexp_replace(cut, "(?:[C-F].(?:[89AB].){0,3})!$", "")).otherwise(F.left(cut, F.lit(2 * most)))
    return F.when(F.octet_length(x) <= most, x).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def code_units(x: Column) -> Column:
    """UTF-16 code units of a text, as numbers."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(x, "UTF-16BE")), F.lit("(....)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("bigint"))


def utf8_bytes(x: Column) -> Column:
    """Bytes of a text, as numbers; of ASCII texts without the way through hex digits."""
    plain = F.transform(F.split(x, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.when((F.octet_length(x) == F.length(x)) & (x != ""), plain).otherwise(_hex_bytes(x))


def _hex_bytes(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(F.encode(x, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("bigint"))


def utf16_length(x: Column) -> Column:
    """UTF-16 code units: a character beyond the basic plane counts twice."""
    return F.length(x) + F.regexp_count(x, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def fnv1a64(x: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as a signed number. The prime is 2^40 + 435; products are taken by halves, so nothing overflows."""

    def step(h: Column, b: Column) -> Column:
        h = h.bitwiseXOR(b)
        low = h.bitwiseAND(U32) * 435
        high = F.shiftrightunsigned(h, 32) * 435 + F.shiftright(low, 32) + F.shiftleft(h.bitwiseAND(0xFFFFFF), 8)
        return F.shiftleft(high.bitwiseAND(U32), 32).bitwiseOR(low.bitwiseAND(U32))

    return F.aggregate(utf8_bytes(x), F.lit(0xCBF29CE484222325 - (1 << 64)).cast("bigint"), step)


def djb2_hex(x: Column) -> Column:
    """hash * 33 xor unit over UTF-16 code units from 5381, 32 bits, as eight upper-case hex digits."""
    return F.lpad(F.hex(F.aggregate(code_units(x), F.lit(5381).cast("bigint"), lambda h, c: (h * 33).bitwiseAND(U32).bitwiseXOR(c))), 8, "0")


def fingerprint(x: Column) -> Column:
    """Length in UTF-16 units and the 31-based hash of them, as length:hex; "empty" for empty and null."""
    units = code_units(x)
    value = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(U32))
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, "empty").otherwise(F.concat_ws(":", F.size(units).cast("string"), F.lower(F.lpad(F.hex(value), 8, "0"))))


def band(score: Column) -> Column:
    """Quality band of a score from 0 to 100."""
    return F.when(score >= 85, "EXCELLENT").when(score >= 70, "GOOD").when(score >= 55, "FAIR").when(score >= 40, "POOR").otherwise("BROKEN")


def half_up(x: Column) -> Column:
    """To the next whole number, halves up."""
    return F.floor(x + 0.5)


def each(df: DataFrame, array: str | Column, name: str, *keep: str) -> DataFrame:
    """A row for each element of an array, with seq, its place from 0. By an outer explode, as Spark would push the filter that it infers for an inner one
    below the array's own expressions and evaluate them twice and more."""
    return df.select(*keep, F.posexplode_outer(array).alias("seq", name)).where(F.col(name).isNotNull())


def pinned(column: str, x: Column) -> Column:
    """x, which names an array column once, inside a lambda: with a second mention, which isn't known to hold before it runs, Spark keeps the column
    instead of evaluating its expression for each element."""
    return F.when(F.size(column) >= 0, x)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once, however often f names it; Spark evaluates what stands in a branch of CASE anew for each mention."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def chain(x: Column, *steps: tuple[str, str] | Callable[[Column], Column]) -> Column:
    """Replacements (expression, replacement) or functions, one after another."""
    for step in steps:
        x = F.regexp_replace(x, step[0], step[1]) if isinstance(step, tuple) else step(x)
    return x
