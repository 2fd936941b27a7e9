"""Text, markup, code and corpus functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import code, docstrings, rst, text
from lodestone.operators import corpus, sections
from lodestone.plans import samples


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "source, want",
    [
        ("Title\n=====", "### Title"),
        ("Sub\n---", "###### Sub"),
        ("a\n}", "### a"),
        ("====\nOver\n====", "### Over"),
        (":class:`Foo` and `x <u>`_", "Foo and x"),
        (".. note:: hi\n\n   body", "body"),
        (".. image:: a.png\n   :alt: b\n\nend", "end"),
        (".. code-block:: python\n   :linenos:\n\n   x = 1", "```python\nx = 1\n```"),
        ("after::\n\n    lit", "after:\n```\n\nlit\n```"),
        ("no block::\nend", "no block:\nend"),
        (":orphan:\n\n.. _x:\n\nt", "t"),
        ("a |s| ``b``", "a b"),
        ("a\n\n\n\nb", "a\n\nb"),
        (None, ""),
    ],
)
def test_rst(spark, source, want):
    assert one(spark, source, lambda c: rst.clean_rst(c)["text"]) == want


def test_rst_code_blocks(spark):
    blocks = one(spark, samples.RST[3][1], lambda c: rst.clean_rst(c)["code_blocks"])
    assert [(b["lang"], b["code"].strip()) for b in blocks] == [("python", "x = 1"), ("text", "literal")]


def test_sections(spark):
    body = "before\n## A\n" + "w " * 12 + "\n#### B\nx\n### \n##C\n  ### D  \n\none\n"
    got = one(spark, body, sections.sections_of)
    assert [s["title"] for s in got] == ["A", "D"]
    assert got[0]["text"].endswith("#### B\nx\n### \n##C") and got[1]["text"] == "one"
    docs = spark.createDataFrame([(5, "f", body)], "index long, file string, text string")
    kept = sections.split_sections(docs).collect()
    assert [(r["title"], r["parent_index"], r["file"]) for r in kept] == [("A", 5, "f")]


def test_titles_and_cleanup(spark):
    assert one(spark, "Intro¶  x", text.sanitize_title) == "Intro x"
    assert one(spark, None, text.sanitize_title) == ""
    assert one(spark, "a  :x:`b`\n```\n c  :x:`d`\n```\n\n\nz ", text.clean_lines) == "a b\n```\n c  :x:`d`\n```\n\nz"
    assert one(spark, ":orphan:\na\n .. _l.x-1: \nb", text.strip_orphans) == "a\nb"


def test_links_and_paths(spark):
    join = lambda base, link: spark.range(1).select(text.url_join(F.lit(base), F.lit(link)).alias("y")).first()["y"]
    assert join("https://h/a/b.html", "c.html") == "https://h/a/c.html"
    assert join("https://h/a/b.html", "../c.html") == "https://h/c.html"
    assert join("https://h/a/b.html", "/c") == "https://h/c"
    assert join("https://h", "c") == "https://h/c"
    assert join("https://h/a", "http://x/y") == "http://x/y"
    assert one(spark, "<h1>A <b>&amp;</b></h1><title>t</title>", text.html_title) == "A &"
    assert one(spark, "<title> t </title>", text.html_title) == "t"
    assert one(spark, "src/distributed.py", lambda c: text.path_excluded(c, ("dist",))) is False
    assert one(spark, "src/distributed.py", lambda c: text.path_excluded(c, ("dist",), substring=True)) is True
    assert one(spark, "https://r/a/b.html", lambda c: text.rel_path(c, "https://r/")) == "a/b"


def test_tokens(spark):
    assert one(spark, 'x = "a b" + \'c\' # no\ny()', text.code_tokens) == ["x", "=", "STR", "+", "STR", "y", "(", ")"]
    assert one(spark, "Été à l'ÉCOLE", text.text_tokens) == ["été", "à", "l", "école"]
    assert len(one(spark, "w " * 600, text.text_tokens)) == 512
    assert one(spark, None, text.word_count) == 0


def test_verbs(spark):
    made = lambda name, kind="function", owner=None, params=(): spark.range(1).select(
        docstrings.function_doc(F.lit(name), F.lit(kind), F.lit(owner).cast("string"), F.array(*[F.lit(p) for p in params]).cast("array<string>")).alias("y")
    ).first()["y"]
    assert made("setup") == "Sets up."
    assert made("on_train_start") == "Starts on train."
    assert made("get") == "Retrieves the operation."
    assert made("__len__", "method", "Bag") == "Returns the length/size of the Bag."
    assert made("__odd__", "method", None) == "Special method __odd__ for object."
    assert made("maxSpeed", "property", "Car") == "Property that returns the max speed."
    assert made("frob", "function", None, "abcd") == "Performs frob operation. Takes parameters: a, b, c, and 1 more."


def test_entities(spark):
    files = spark.createDataFrame(list(samples.SOURCES), "path string, content string")
    rows = {r["func_name"]: r for r in code.entities(files, "repo", "https://x/").collect()}
    assert set(rows) == {"Base", "Base.make", "Base.size", "Base.run", "Nested", "Nested.go", "late"}
    assert rows["Base.make"]["entity_type"] == "static_method" and rows["Base.size"]["entity_type"] == "property"
    assert rows["Base.make"]["parameters"] == ["x", "y"] and rows["Base.make"]["return_type"] == "int"
    assert rows["Base.make"]["complexity"] == 4  # if, and two operators
    assert rows["Base.run"]["docstring"].startswith("Runs it all.") and rows["Base.run"]["docstring_summary"] == "Runs it all."
    assert rows["Base.run"]["parameters"] == ["a", "b", "args", "kw"]
    assert rows["Nested"]["parent_classes"] == ["Base", "abc.ABC"]
    assert rows["late"]["is_synthetic_docstring"] is True or rows["late"]["docstring"] == "Too late."
    errors = code.extract(files).where("error IS NOT NULL").collect()
    assert [e["path"] for e in errors] == ["pkg/broken.py"]
    few = code.entities(files, "repo", "https://x/", code.Settings(include_undocumented=False, include_classes=False))
    assert {r["func_name"] for r in few.collect()} == {"Base.run"}


def test_structured_text_in_either_spelling(spark):
    body = "--- {} ---\nPath: a.py\n{}: f\n\n--- {} ---\nDoc.\nMore\n\n--- Code ---\ndef f(): pass"
    rows = [(0, body.format("Meta Data", "Function Name", "Docstring")), (1, body.format("Metadata", "Name", "Documentation")), (2, "nothing")]
    df = spark.createDataFrame(rows, "index long, text string")
    got = corpus.parse_source(df).orderBy("index").collect()
    assert [r["func_name"] for r in got] == ["f", "f", ""] and got[2]["error"]
    assert got[0]["text"] == got[1]["text"] == "f f Doc. Doc.\nMore def f(): pass"
    strict = corpus.parse_source(df, strict_headers=True).orderBy("index").collect()
    assert [bool(r["error"]) for r in strict] == [False, True, True]


def test_discussions(spark):
    rows = [("t", "b", ("a",), None), ("t", "b", None, [("first",)]), (None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, bodyText string, answer struct<bodyText: string>, answers array<struct<text: string>>")
    assert [r["text"] for r in corpus.parse_discussion(df).collect()] == ["t\n b \n Answer: a", "t\n b \n Answer: first", "Answer:"]


def test_answered(spark):
    rows = [(1, "yes", ["still unsolved"]), (2, None, ["solved"]), (3, "yes", ["no"]), (4, "yes", None)]
    df = spark.createDataFrame(rows, "id int, answer string, comments array<string>")
    keys = ("worked", "thank you", "good answer", "fixed", "solved")
    assert [r["id"] for r in corpus.answered(df, "comments", "answer", keys).collect()] == [1]
