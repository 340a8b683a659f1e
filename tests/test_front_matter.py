import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.sources import files
from foliant.sources.front_matter import as_json, parse

NESTED = """title: "A: title"   # comment
tags: [one, 'two, three', "f\\u00fcnf"]
author:
  name: Ada
  links:
    - https://a.example/x#y
    - {kind: mail, to: ada@example.org, tags: [a, b]}
  active: true
steps:
- do: first
  with:
    n: 1
- do: second
-
  - 1
  - 2.5
- - nested
  - list
text: |
  line one
    further in

  line three

folded: >-
  these lines
  are one

  and these
  another
    indented
  end
kept: |+
  a

base: &base {x: 1}
copy: *base
empty:
nothing: ~
plain text: goes
  on here
date: 2024-05-01
version: 2.0
url: http://x:80/y
"""


def test_nested_values():
    got = parse(NESTED)
    assert got["author"] == {"name": "Ada", "links": ["https://a.example/x#y", {"kind": "mail", "to": "ada@example.org", "tags": ["a", "b"]}], "active": True}
    assert got["steps"] == [{"do": "first", "with": {"n": 1}}, {"do": "second"}, [1, 2.5], ["nested", "list"]]
    assert got["text"] == "line one\n  further in\n\nline three\n" and got["folded"] == "these lines are one\nand these another\n  indented\nend" and got["kept"] == "a\n\n"
    assert got["copy"] == {"x": 1} and got["empty"] is None and got["nothing"] is None and got["plain text"] == "goes on here" and got["date"] == "2024-05-01"
    assert got["title"] == "A: title" and got["tags"] == ["one", "two, three", "fünf"] and got["url"] == "http://x:80/y" and got["version"] == 2.0


@pytest.mark.parametrize("bad", ["a: b: c", "a: [1, 2", "a: *none", "key\n  other: 1", "a: 1\na: 2", "a: 'x", "\tx: 1", "a: @x", "a:\n  b: 1\n c: 2", "- a\nb: 1", "a: {b: 1", "a: \"\\q\""])
def test_what_cannot_be_read(bad):
    assert as_json(bad) is None


@pytest.mark.parametrize(("text", "value"), [("", {}), ("# only a comment", {}), ("just text", {"_raw": "just text"}), ("- a\n- b", {"_raw": ["a", "b"]}), ("~", {}), ("a: [ ]\nb: { }", {"a": [], "b": {}}), ("1: x\ntrue: y", {"1": "x", "true": "y"}), ("k:\n- 1\n- 2\nm: 3", {"k": [1, 2], "m": 3}), ("a: |2\n    x\n   y", {"a": "  x\n y"})])
def test_small_documents(text, value):
    assert json.loads(as_json(text)) == value


def test_against_a_full_reader():
    """Random documents of the forms front matter has, where a full YAML library is installed."""
    yaml = pytest.importorskip("yaml")
    rng = random.Random(4)
    scalars = ["x", "two words", "'it''s'", '"a\\tb"', "3", "-4", "2.5", "true", "null", "~", "a-b_c", "http://h/p", "[1, b, 'c']", "{k: v, n: 2}", "x # note", "1.0.2", "e#f"]

    def value(depth, indent):
        kind = rng.randrange(6) if depth < 3 else 0
        pad = "  " * indent
        if kind <= 1:
            return " " + rng.choice(scalars)
        if kind == 2:
            return "".join(f"\n{pad}k{i}:{value(depth + 1, indent + 1)}" for i in range(rng.randrange(1, 4)))
        if kind == 3:
            return "".join(f"\n{pad}-{value(depth + 1, indent + 1)}" for _ in range(rng.randrange(1, 4)))
        head = rng.choice(["|", ">", "|-", ">-", "|+", ">+"])
        return f" {head}" + "".join(f"\n{pad}{rng.choice(['', '', '  '])}{rng.choice(['line', 'w w'])}" if i == 0 or rng.random() < 0.7 else "\n" for i in range(rng.randrange(1, 5)))

    tried = 0
    for _ in range(1500):
        text = "\n".join(f"key{i}:{value(0, 1)}" for i in range(rng.randrange(1, 5))) + "\n"
        try:
            expected = yaml.load(text, yaml.BaseLoader)
        except yaml.YAMLError:
            continue
        try:
            got = parse(text)
        except ValueError:
            continue  # what is not known stays content
        plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x
        same = lambda a, b: (
            a.keys() == b.keys() and all(same(a[k], b[k]) for k in a) if isinstance(b, dict) else len(a) == len(b) and all(map(same, a, b)) if isinstance(b, list) else (a is None and b in ("", "~", "null")) or (isinstance(a, bool) and str(a).lower() == b) or (isinstance(a, (int, float)) and not isinstance(a, bool) and float(b) == a) or a == b
        )
        assert same(got, plain(expected)), text
        tried += 1
    assert tried > 1000


def test_documents_use_typed_values(spark):
    raw = lambda head: f"---\n{head}\n---\nBody\n"
    rows = [
        ("/v/a/one.md", raw("title: 5\nversion: 2\ntags: [x, 3, y]\ncreated: 2024-01-01\nnested:\n  deep: [1, {k: v}]")),
        ("/v/a/two.md", raw("title: T\nversion: 1.50\ntags: solo\ncategory: c\ndescription: |\n  long\n  text")),
        ("/v/a/three.md", raw("title: [unclosed")),
        ("/v/a/four.md", raw("version: 2.0\ntags: {a: 1}\ncategory: 7")),
        ("/v/a/five.txt", "---\n---\nRest"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "file_path string, raw string, modified timestamp")
    got = {r.file_name: r for r in files.documents(df).collect()}
    one, two, three, four, five = (got[n] for n in ("one.md", "two.md", "three.md", "four.md", "five.txt"))
    assert (one.title, one.version, one.tags, one.created_at, one.category) == ("one", "2", ["x", "y"], "2024-01-01", "a")
    assert (two.title, two.version, two.tags, two.category, two.description) == ("T", "1.5", ["solo"], "c", "long\ntext")
    assert three.title == "three" and three.content == rows[2][1] and three.raw_frontmatter == "{}"
    assert (four.version, four.tags, four.category) == ("2", [], "a") and five.content == "Rest"
    deep = files.with_front_matter(files.documents(df)).select("file_name", F.try_variant_get("front_matter", "$.nested.deep[1].k", "string").alias("k")).where("k is not null").collect()
    assert [tuple(r) for r in deep] == [("one.md", "v")]
