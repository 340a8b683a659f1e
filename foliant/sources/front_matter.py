"""Front matter: the part of YAML that stands at the head of documents, as JSON.

Lines are read once, with a stack of the open maps and lists by their indentation. Known are nested maps and lists, flow lists and maps
on one line, block scalars (| and >, with - and +), quoted strings, anchors, aliases and comments; on anything else ValueError is raised,
so that the text stays content."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{}#&*!|>%@`,?:-](?:[^:#]|:(?!\s|$)|(?<!\s)#)*?|[-?:](?=\S)(?:[^:#]|:(?!\s|$)|(?<!\s)#)*?))\s*:(?=\s|$)""")
NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9]*)\Z")
DECIMAL = re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?\Z")
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0"}


class Flow:
    """Values on one line: scalars, [lists] and {maps}."""

    def __init__(self, text: str, anchors: dict[str, object]):
        self.text, self.at, self.anchors = text, 0, anchors

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1
        if self.text[self.at : self.at + 1] == "#" and (self.at == 0 or self.text[self.at - 1] in " \t"):
            self.at = len(self.text)

    def whole(self) -> object:
        value = self.value("")
        self.blank()
        if self.at < len(self.text):
            raise ValueError(self.text)
        return value

    def value(self, stops: str) -> object:
        self.blank()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            return self.items("]", lambda: self.value(",]"), list)
        if c == "{":
            return self.items("}", self.pair, dict)
        if c in ('"', "'"):
            return self.quoted(c)
        if c == "*":
            return self.anchors_at(self.word(stops)[1:])
        if c and c in "&!|>%@`":
            raise ValueError(self.text)
        return scalar(self.word(stops))

    def anchors_at(self, name: str) -> object:
        if name not in self.anchors:
            raise ValueError(f"unknown alias {name}")
        return self.anchors[name]

    def word(self, stops: str) -> str:
        begin = self.at
        while self.at < len(self.text):
            c = self.text[self.at]
            ends = c in stops or (c == "#" and self.at > begin and self.text[self.at - 1] in " \t") or (c == ":" and (self.text[self.at + 1 : self.at + 2] in ("", " ", "\t") or ("}" in stops and self.text[self.at + 1] in ",}")))
            if ends:
                if c == ":" and "}" not in stops:
                    raise ValueError(self.text)
                break
            self.at += 1
        return self.text[begin : self.at].strip()

    def quoted(self, mark: str) -> str:
        out, i = [], self.at + 1
        while i < len(self.text):
            c = self.text[i]
            if c == mark and mark == "'" and self.text[i + 1 : i + 2] == "'":
                out.append("'")
                i += 2
            elif c == mark:
                self.at = i + 1
                return "".join(out)
            elif c == "\\" and mark == '"':
                code = self.text[i + 1 : i + 2]
                size = {"x": 2, "u": 4, "U": 8}.get(code)
                out.append(chr(int(self.text[i + 2 : i + 2 + size], 16)) if size else ESCAPES.get(code) or self.bad())
                i += 2 + (size or 0)
            else:
                out.append(c)
                i += 1
        return self.bad()

    def bad(self) -> str:
        raise ValueError(self.text)

    def items(self, end: str, item: Callable[[], object], kind: type) -> object:
        self.at += 1
        found = []
        while True:
            self.blank()
            if self.text[self.at : self.at + 1] == end:
                self.at += 1
                return kind(found)
            found.append(item())
            self.blank()
            c = self.text[self.at : self.at + 1]
            if c == ",":
                self.at += 1
            elif c != end:
                self.bad()

    def pair(self) -> tuple[str, object]:
        key = self.value(",}")
        self.blank()
        if self.text[self.at : self.at + 1] != ":":
            return as_key(key), None
        self.at += 1
        self.blank()
        return as_key(key), (None if self.text[self.at : self.at + 1] in (",", "}") else self.value(",}"))


def scalar(x: str) -> object:
    if x in WORDS:
        return WORDS[x]
    if NUMBER.match(x):
        return int(x)
    return float(x) if DECIMAL.match(x) else x


def as_key(x: object) -> str:
    if isinstance(x, (dict, list)):
        raise ValueError("a key must be a scalar")
    return x if isinstance(x, str) else json.dumps(x)


class Lines:
    """The lines of a text, read forwards, with what is open by indentation."""

    def __init__(self, text: str):
        #: Whether the last line has an end.
        self.ended = text.endswith("\n")
        self.lines, self.at, self.anchors = (text[:-1] if self.ended else text).split("\n"), 0, {}

    def skip(self) -> None:
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1

    def indent(self) -> int:
        self.skip()
        if self.at == len(self.lines):
            return -1
        line = self.lines[self.at]
        body = line.lstrip(" ")
        if body.startswith("\t"):
            raise ValueError("a tab in the indentation")
        return len(line) - len(body)

    def node(self, least: int) -> object:
        """What stands from here on at `least` columns or more."""
        n = self.indent()
        if n < least:
            return None
        body = self.lines[self.at][n:]
        if body == "-" or body.startswith("- "):
            return self.collection(n, [])
        if KEY.match(body):
            return self.collection(n, {})
        self.at += 1
        return self.inline(body, least - 1)

    def collection(self, n: int, out: dict | list) -> object:
        while self.indent() == n:
            body = self.lines[self.at][n:]
            if isinstance(out, list):
                if not (body == "-" or body.startswith("- ")):
                    break
                rest = body[1:].lstrip(" ")
                if KEY.match(rest) or rest == "-" or rest.startswith("- "):
                    # A map or list that begins on the dash's own line, as if the dash were a blank.
                    inner = n + len(body) - len(rest)
                    self.lines[self.at] = " " * inner + rest
                    out.append(self.node(inner))
                else:
                    self.at += 1
                    out.append(self.inline(rest, n))
            else:
                found = KEY.match(body)
                if not found:
                    raise ValueError(body)
                key = as_key(Flow(found[1], self.anchors).whole())
                if key in out:
                    raise ValueError(f"repeated key {key}")
                self.at += 1
                out[key] = self.inline(body[found.end() :].strip(" \t"), n, own_list=True)
        if self.indent() > n:
            raise ValueError(self.lines[self.at])
        return out

    def inline(self, rest: str, n: int, own_list: bool = False) -> object:
        """The value that begins with `rest`, after a key or dash at column n. own_list: a list may stand at the key's own column."""
        name = re.match(r"&(\S+)\s*", rest)
        if name:
            rest = rest[name.end() :]
        if re.match(r"[|>][-+1-9]*\s*(?:#.*)?\Z", rest):
            value = self.block(rest, n)
        elif not rest or rest.startswith("#"):
            least = n if own_list and self.indent() == n and re.match(r"-(?: |\Z)", self.lines[self.at][n:]) else n + 1
            value = self.node(least)
        else:
            value = self.flow(rest, n)
        if name:
            self.anchors[name[1]] = value
        return value

    def flow(self, rest: str, n: int) -> object:
        """A scalar, list or map that may go on in the lines below, further in."""
        while True:
            try:
                value = Flow(rest, self.anchors).whole()
                open_ = isinstance(value, str) and rest[:1] not in "\"'[{" and "#" not in rest
            except ValueError:
                if rest[:1] not in tuple("\"'[{"):
                    raise
                value, open_ = None, True
                if self.indent() <= n:
                    raise
            if not (open_ and self.indent() > n):
                return value
            rest = f"{rest} {self.lines[self.at].strip()}"
            self.at += 1

    def block(self, head: str, n: int) -> str:
        """A literal (|) or folded (>) block: - drops the last line end, + keeps all."""
        digits = re.search(r"[1-9]", head)
        lines: list[str] = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > n):
            lines.append(self.lines[self.at])
            self.at += 1
        full = [x for x in lines if x.strip()]
        width = n + int(digits[0]) if digits and n >= 0 else min((len(x) - len(x.lstrip(" ")) for x in full[:1]), default=0)
        if any(x[:width].strip() for x in full):
            raise ValueError(head)
        body = [x[width:] if x.strip() else "" for x in lines]
        tail = 0
        while body and not body[-1]:
            body.pop()
            tail += 1
        if head[0] == ">":
            # Lines are joined by blanks; n empty ones between are n line ends, and lines further in stay lines.
            out, last, empty = "", None, 0
            for x in body:
                if not x:
                    empty += 1
                    continue
                deep = last is not None and (x[0] in " \t" or last[0] in " \t")
                out += "\n" * (empty + deep) + ("" if last is None or empty or deep else " ") + x
                last, empty = x, 0
        else:
            out = "\n".join(body)
        ends = tail + (1 if body else 0) - (self.at == len(self.lines) and not self.ended)
        return out + "\n" * max(0, ends if "+" in head else 0 if "-" in head or not body else min(ends, 1))


def parse(text: str) -> object:
    """The value of a document; None if it has none."""
    lines = Lines(text)
    if lines.indent() < 0:
        return None
    value = lines.node(0)
    if lines.indent() >= 0:
        raise ValueError(lines.lines[lines.at])
    return value


def as_json(text: str) -> str | None:
    """A JSON object: of what is no map, {"_raw": ...}, of nothing, {}; null for what can't be read."""
    try:
        found = parse(text)
        found = {} if found is None else found if isinstance(found, dict) else {"_raw": found}
        return json.dumps(found, ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError, OverflowError):
        return None


@F.pandas_udf(StringType())
def yaml_as_json(column: pd.Series) -> pd.Series:
    return column.map(lambda text: None if text is None else as_json(text))
