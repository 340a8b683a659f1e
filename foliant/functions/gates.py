"""Gates before expensive expressions: words of which any match contains at least one.

An expression of many alternatives is tried at every place of a text, while a search for a plain word is a scan of bytes. literals() finds, for
an expression, words that no match is without; may_match() looks for them in folded(), a text's small letters, once for a document. Where
none is there, the expression need not run."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.word_search import Words, slices

#: Letters that count as i and s when case doesn't matter, besides those that become so in lower case.
FOLDED = ("ſıİK", "siik")


def folded(text: Column) -> Column:
    return F.lower(F.when(plain(text), text).otherwise(F.translate(text, *FOLDED)))


def plain(text: Column) -> Column:
    """Whether folded() is the text in lower case."""
    return ~text.rlike(f"[{FOLDED[0]}]")


class Form(NamedTuple):
    """A word that alone makes a match, if it begins (left) or ends (right) at a word's edge."""

    word: str
    left: bool = False
    right: bool = False


Need = str | tuple | None


def all_of(parts: list[Need]) -> Need:
    known = [p for p in dict.fromkeys(parts) if p]
    # A single letter says little beside a word.
    telling = [p for p in known if shortest(p) > 1] or known
    return telling[0] if len(telling) == 1 else ("and", *telling) if telling else None


def any_of(parts: list[Need]) -> Need:
    if not all(parts):
        return None
    flat = dict.fromkeys(q for p in parts for q in (p[1:] if isinstance(p, tuple) and p[0] == "or" else (p,)))
    return next(iter(flat)) if len(flat) == 1 else ("or", *flat)


def shortest(need: Need) -> int:
    return len(need) if isinstance(need, str) else (max if need[0] == "and" else min)(map(shortest, need[1:]))


def need_of(every: frozenset[str]) -> Need:
    """Any of some texts, but for those that hold another."""
    return any_of(sorted(w for w in every if not any(o != w and o in w for o in every)))


def words_in(need: Need) -> set:
    return {need} if not is_list(need) else set().union(*map(words_in, need[1:])) if need else set()


def is_list(need) -> bool:
    return isinstance(need, tuple) and not isinstance(need, Form)


def with_forms(need: Need):
    """What is needed with forms in place of words."""
    return (need[0], *map(with_forms, need[1:])) if is_list(need) else Form(need)


@dataclass
class Found:
    """What is known of the matches of a part of an expression: the text, if there is only one, and words of which each match has one, if any are known."""

    exact: str | None
    words: frozenset[str] | None
    #: All that is known of what a match has: a word, or ("and", ...) or ("or", ...) of such; None for nothing.
    needs: Need = None
    #: All texts of the part, if they are few, with white space as one space.
    every: frozenset[str] | None = None

    def best(self) -> frozenset[str] | None:
        return self.words if not self.exact else frozenset([self.exact])


def exactly(text: str) -> Found:
    return Found(text, None, None, frozenset([" " if text.isspace() else text]))


UNKNOWN = Found(None, None)
NOTHING = Found(None, None, None, frozenset([""]))
BLANK = Found(None, None, " ", frozenset([" "]))
#: Texts of a part that are told apart.
FEW = 64
#: Escapes that stand for more than one character, or for none.
CLASSES = "wWdDsSbBAzZGhHvVRXpP"


class Reader:
    """Reads an expression once, from left to right."""

    def __init__(self, pattern: str, ascii_blanks: bool = True):
        self.p, self.at, self.ascii_blanks = pattern, 0, ascii_blanks

    def peek(self) -> str:
        return self.p[self.at : self.at + 1]

    def alternatives(self) -> Found:
        found = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            found.append(self.sequence())
        if len(found) == 1:
            return found[0]
        words = [f.best() for f in found]
        every = frozenset().union(*(f.every for f in found)) if all(f.every is not None for f in found) else None
        return Found(None, None if any(not w for w in words) else frozenset().union(*words), any_of([f.needs for f in found]), every if every and len(every) <= FEW else None)

    def sequence(self) -> Found:
        run, runs, inner, needs = "", [], [], []
        every: frozenset[str] = frozenset([""])
        only = whole = True
        while self.at < len(self.p) and self.peek() not in "|)":
            item = self.quantified()
            if item.every is not None and len(every) * len(item.every) <= FEW:
                every = frozenset((a + b).replace("  ", " ") for a in every for b in item.every)
            else:
                whole = False
                needs.append(need_of(every))
                needs.append(item.needs if item.every is None else None)
                every = item.every or frozenset([""])
            if item.exact is not None:
                run += item.exact
                continue
            only = False
            runs.append(run)
            run = ""
            if item.words:
                inner.append(item.words)
        needs.append(need_of(every))
        if only:
            return Found(run, frozenset([run]) if run else None, all_of(needs), every if whole else None)
        choices = [frozenset([r]) for r in [*runs, run] if r] + inner
        # Longer words are rarer, and fewer are cheaper to look for.
        return Found(None, max(choices, key=lambda c: (min(map(len, c)) > 1, -len(c), min(map(len, c))), default=None), all_of(needs), every if whole else None)

    def quantified(self) -> Found:
        item = self.atom()
        least, marks = 1, ""
        while self.peek() and self.peek() in "?*+{":
            c = self.peek()
            marks += c
            if c == "{":
                end = self.p.index("}", self.at)
                least = min(least, int(self.p[self.at + 1 : end].split(",")[0] or 0))
                self.at = end + 1
            else:
                least = least if c == "+" else 0
                self.at += 1
        if not marks:
            return item
        every = item.every if item.every == BLANK.every else None if marks != "?" else item.every
        every = every | {""} if every is not None and not least else every
        return Found(None, item.best() if least else None, item.needs if least else None, every)

    def atom(self) -> Found:
        c = self.peek()
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == "\\":
            c = self.peek()
            self.at += 1
            if c in "sbAzZ":
                return NOTHING if c != "s" else BLANK if self.ascii_blanks else UNKNOWN
            if c in CLASSES or c.isdigit() or c in "xukc":
                if self.peek() == "{":
                    self.at = self.p.index("}", self.at) + 1
                elif c in "xu" or c in "pP":
                    self.at += {"x": 2, "u": 4}.get(c, 1)
                return Found(None, None)
            return exactly({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))
        return UNKNOWN if c == "." else NOTHING if c in "^$" else exactly(c.lower())

    def group(self) -> Found:
        if self.peek() == "?":
            end = self.at + 1
            while self.p[end] not in ":)=!><":
                end += 1
            if self.p[end] == ")":  # flags for what follows
                self.at = end + 1
                return exactly("")
            look = self.p[self.at + 1] in "=!<"
            self.at = end + 1
            if self.p[end] == "<" and self.p[self.at] in "=!":
                self.at += 1
            found = self.alternatives()
            self.at += 1
            # What is looked at from outside is no part of the match, and between two parts nothing else need stand.
            return NOTHING if look else found
        found = self.alternatives()
        self.at += 1
        return found

    def char_class(self) -> Found:
        begin = self.at
        depth = 1
        if self.peek() == "^":
            self.at += 1
        if self.peek() == "]":
            self.at += 1
        while depth:
            c = self.peek()
            if c == "\\":
                self.at += 1
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
            self.at += 1
        inside = self.p[begin : self.at - 1]
        letters = inside.lower()
        if inside.isalnum() and len(inside) <= 4:
            return Found(None, frozenset(letters), any_of(sorted(set(letters))), frozenset(letters))
        return UNKNOWN


def literals(pattern: str) -> tuple[str, ...] | None:
    """Words in small letters, of which any match of the expression has one when case doesn't matter; None if none are known. A word that contains another is left out."""
    words = Reader(pattern).alternatives().best()
    if not words:
        return None
    return tuple(sorted(w for w in words if not any(o != w and o in w for o in words)))


def may_match(low: Column, *patterns: str) -> Column:
    """Whether a text whose folded() form is low may match any of the expressions."""
    words: set[str] = set()
    for p in patterns:
        found = literals(p)
        if found is None:
            return F.lit(True)
        words.update(found)
    return may_contain(low, words)


def may_contain(low: Column, words) -> Column:
    """Whether any of some words stands in a text in its folded() form."""
    small = {fold(w) for w in words}
    least = sorted(w for w in small if not any(o != w and o in w for o in small))
    out = F.contains(low, F.lit(least[0]))
    for w in least[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def need(gated: str | tuple[str, ...], ascii_blanks: bool = True) -> Need:
    """What a text that an expression matches has, or that holds one of some words, where runs of white space are one space. ascii_blanks: by \\s the expression means ASCII."""
    return Reader(gated, ascii_blanks).alternatives().needs if isinstance(gated, str) else any_of([fold(w) for w in gated])


#: A group of alternatives with what may stand around it, and an alternative: a word of plain characters, some of them with a question mark.
GROUP = re.compile(r"(?:\(\?(?P<flags>[a-zA-Z]+)\))?(?P<left>\\b)?\(\?:(?P<inner>.*)\)(?P<tail>\w\?)?(?P<more>\\w\*)?(?P<right>\\b)?", re.DOTALL)
CHARACTER = r"(?:[^\\()\[\]{}?*+.^$|]|\\[^\w\s])"
ALTERNATIVE = re.compile(rf"(?P<left>\\b)?(?P<word>(?:{CHARACTER}\??)+)(?P<more>\\w\*)?(?P<right>\\b)?")


def forms(pattern: str, ascii_edges: bool) -> tuple[list[Form], bool]:
    """Forms of an expression that is a group of alternatives, and whether they are all that it matches. ascii_edges: words are ASCII to its edges."""
    group = GROUP.fullmatch(pattern)
    if not group or not balanced(group["inner"]):
        return [], False
    found, whole = [], True
    for alternative in outer_alternatives(group["inner"]):
        a = ALTERNATIVE.fullmatch(alternative)
        # A word that ends before the group's tail isn't followed further.
        if not a or (a["more"] or a["right"]) and group["tail"]:
            whole = False
            continue
        marked = re.findall(rf"({CHARACTER})(\??)", a["word"] + (group["tail"] or ""))
        more, left, right = a["more"] or group["more"], bool(a["left"] or group["left"]), bool(a["right"] or group["right"])
        for chosen in product(*(((c[-1], "") if mark else (c[-1],)) for c, mark in marked)):
            word = fold("".join(chosen))
            # After a run of word characters, which is taken whole, there is always an edge.
            own = Form(word, left, right and not more)
            letter = lambda c: (c.isalnum() or c == "_") and (c.isascii() or not ascii_edges)
            if not word or (left and not letter(word[0])) or ((right or more) and not letter(word[-1])):
                whole = False
            else:
                found.append(own)
    return list(dict.fromkeys(found)), whole


def parted(pattern: str) -> list[str]:
    """An expression as several, one of which matches where it does: the alternatives that forms() knows, and each other one."""
    group = GROUP.fullmatch(pattern)
    if not group or not balanced(group["inner"]):
        return [pattern]
    alone = lambda a: pattern[: group.start("inner")] + a + pattern[group.end("inner") :]
    known, others = [], []
    for a in outer_alternatives(group["inner"]):
        (known if forms(alone(a), False)[1] else others).append(a)
    return [*([alone("|".join(known))] if known else []), *map(alone, others)]


def balanced(inner: str) -> bool:
    """Whether the group that inner is taken from ends where inner does."""
    return all(depth >= 0 for depth, _ in depths(inner))


def depths(pattern: str):
    """How deep in groups each character is, and whether it is one of the expression's own bars. Escapes and classes count as inside."""
    depth, skip, inside = 0, False, False
    for c in pattern:
        if skip or c == "\\":
            skip = not skip
            yield depth, False
            continue
        inside = (inside or c == "[") and c != "]"
        depth += 0 if inside else (c == "(") - (c == ")")
        yield depth, c == "|" and depth == 0 and not inside


def outer_alternatives(pattern: str) -> list[str]:
    out = [""]
    for c, (_, bar) in zip(pattern, depths(pattern), strict=True):
        if bar:
            out.append("")
        else:
            out[-1] += c
    return out


#: Small letters of bytes: of ASCII, and of the second bytes of À to Þ.
SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SMALL_SECOND = np.array([b + 32 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256)], np.uint8)
#: Letters that fold() makes others of, besides.
RARE = dict(zip(*FOLDED, strict=True)) | {"\u1e9e": "ß"}


def small_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """slices() of texts as folded() makes them, but for letters beyond Latin-1, which no word has."""
    texts = texts.cast(pa.large_string())
    data = texts.buffers()[2]
    data = data.to_pybytes() if data else b""
    for letter, other in RARE.items():
        if letter.encode() in data:
            texts = pc.replace_substring(texts, letter, other)
    for data, offsets in slices(texts):
        low = SMALL[data]
        second = 1 + np.flatnonzero(data[:-1] == 0xC3)
        low[second] = SMALL_SECOND[data[second]]
        yield low, offsets


def kept(udf, x: Column) -> Column:
    """udf of x as a column that later steps read. Spark would otherwise move what reads it up to them, and evaluate it there for each mention, as it does for no other function."""
    return udf.asNondeterministic()(x)


class Gates:
    """Gates of many expressions, and of tuples of words, that a text passes if it may match them: what they need is looked for in one walk through the text.

    Of an expression that ignores case, and of words that are looked for in small letters, the walk often tells that it does match, too: see holds()."""

    def __init__(self, *gated: str | tuple[str, ...], ascii_blanks: bool = True):
        self.needs = {x: n for x in dict.fromkeys(gated) if (n := need(x, ascii_blanks))}
        self.at = {x: i for i, x in enumerate(self.needs)}
        #: Of each gate: what its text needs, as forms, and forms that are enough.
        self.gates = [self._gate(x, n, ascii_blanks) for x, n in self.needs.items()]
        if any(c > "ÿ" for x in self.needs for w in ([x] if isinstance(x, str) else x) for c in w):
            raise ValueError("words of gates have letters of Latin-1 only")
        self.forms = sorted({f for needed, enough in self.gates for f in (*words_in(needed), *enough)})

    @staticmethod
    def _gate(x: str | tuple[str, ...], needed: Need, ascii_edges: bool):
        own, whole = (forms(x, ascii_edges)) if isinstance(x, str) else ([Form(fold(w)) for w in x], True)
        # An expression that minds case isn't told by small letters.
        told = not isinstance(x, str) or re.match(r"\(\?[a-zA-Z]*i", x)
        return (("or", *own) if whole else with_forms(needed)), own if told else []

    def passed(self, text: Column) -> Column:
        """Of a text, folded() or not: whether it passes each gate, for may()."""
        return self._column(text, False)

    def told(self, text: Column) -> Column:
        """As passed(), for holds() too."""
        return self._column(text, True)

    def passed_each(self, texts: Column) -> Column:
        """Of an array of texts: for each, in order, whether it passes each gate, as passed() gives it."""
        return self._columns(texts, False)

    def told_each(self, texts: Column) -> Column:
        """As passed_each(), for holds() too."""
        return self._columns(texts, True)

    def _column(self, low: Column, told: bool) -> Column:
        run = self._search(told)
        run.__annotations__ = {"a": pa.Array, "return": pa.Array}
        return kept(F.arrow_udf(run, "array<boolean>"), low)

    def _columns(self, lows: Column, told: bool) -> Column:
        search = self._search(told)

        def run(a):
            a = a.cast(pa.list_(pa.string()))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(a), 0), dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), search(a.flatten()))

        run.__annotations__ = {"a": pa.Array, "return": pa.Array}
        return kept(F.arrow_udf(run, "array<array<boolean>>"), lows)

    def _search(self, all_told: bool):
        """A function of an Arrow array of texts, for tasks. all_told: what passes each gate is followed by what surely matches."""
        own, gates = self.forms, self.gates
        searched: list[Words] = []

        def run(a):
            if not searched:
                searched.append(Words([tuple(f) for f in own]))
            column = {f: i for i, f in enumerate(own)}
            parts = [np.zeros((0, (1 + all_told) * len(gates)), bool)]
            for data, offsets in small_slices(a):
                may, sure = searched[0].told(data, offsets)
                holds = lambda n: may[column[n]] if not is_list(n) else (np.logical_and if n[0] == "and" else np.logical_or).reduce([holds(x) for x in n[1:]])  # noqa: B023, E731
                told = [sure[[column[f] for f in enough]].any(axis=0) for _, enough in gates] if all_told else []
                parts.append(np.array([*(holds(n) for n, _ in gates), *told], bool).reshape((1 + all_told) * len(gates), -1).T)
            whole = np.concatenate(parts)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * whole.shape[1], pa.int32()), pa.array(whole.ravel()))

        return run

    def may(self, passed: Column, x: str | tuple[str, ...]) -> Column:
        """Whether a text may match the expression, or hold one of the words."""
        if x not in self.at:
            return F.lit(True)
        return F.get(passed, F.lit(self.at[x]))

    def holds(self, walk: Column, x: str | tuple[str, ...], match: Column, trusted: Column | None = None) -> Column:
        """match, which says whether the text matches the expression x, or has one of the words x in small letters, evaluated only where the walk, of told(), leaves it open.

        trusted: whether the walk may say so; for words, whether the text is plain()."""
        if x not in self.at:
            return match
        sure = F.get(walk, F.lit(len(self.at) + self.at[x]))
        return (sure if trusted is None else sure & trusted) | (self.may(walk, x) & match)


def fold(word: str) -> str:
    return word.translate(str.maketrans(*FOLDED)).lower()
