"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"^[\s]+|[\s]+$"


def strip(text: Column) -> Column:
    """Without white space at either end (not blanks only, as ``trim``)."""
    return F.regexp_replace(text, _EDGES, "")


def words(text: Column) -> Column:
    """The stretches between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def lower_words(text: Column) -> Column:
    """The search tokeniser: lower case, cut at white space, punctuation kept."""
    return words(F.lower(text))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def text_tokens(text: Column, most: int = 512) -> Column:
    """The first word-character runs of the lower-cased text, Unicode-wide."""
    return F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), 1), 1, most)


def code_tokens(code: Column, most: int = 512) -> Column:
    """Code tokens: strings become STR, comments go, words and single signs stay."""
    for pattern in (r'(?s)""".*?"""', r"(?s)'''.*?'''", r'"[^"]*"', r"'[^']*'"):
        code = F.regexp_replace(code, pattern, "STR")
    code = F.regexp_replace(code, r"(?m)#.*$", "")
    return F.slice(F.regexp_extract_all(code, F.lit(r"((?U)\w+|[^\w\s])"), 1), 1, most)


def strip_orphans(text: Column) -> Column:
    """Without ``:orphan:`` lines and link-target lines."""
    marks = r"^(:orphan:|\.\.\s*_[A-Za-z0-9_.-]+:)$"
    kept = F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: ~F.regexp_replace(line, _EDGES, "").rlike(marks))
    return F.array_join(kept, "\n")


def sanitize_title(title: Column) -> Column:
    """ASCII only, single blanks, trimmed; '' for null."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def inline_cleanup(line: Column) -> Column:
    """One line outside a fence: roles, links, literals and substitutions to
    their text, in this order, then single blanks."""
    for pattern, to in (
        (r":\w+:`([^`]+)`", "$1"),
        (r"`([^`<]+?)\s*<[^>`]+>`_", "$1"),
        (r"`([^`]+?)`_", "$1"),
        (r"``([^`]+)``", "$1"),
        (r"\|[^|\s]+\|", ""),
        (r"\s+", " "),
    ):
        line = F.regexp_replace(line, pattern, to)
    return F.trim(line)


def clean_lines(text: Column) -> Column:
    """``inline_cleanup`` on every line outside fences, then runs of blank lines
    to one, then without outer white space."""
    lines = F.split(text, r"\r\n|\r|\n")
    is_fence = lambda s: F.startswith(F.ltrim(s), F.lit("```"))
    # The running state costs a copy a line; only texts with a fence pay it.
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        fence = is_fence(line)
        kept = F.when(fence | state["inside"], line).otherwise(inline_cleanup(line))
        return F.struct((state["inside"] != fence).alias("inside"), F.concat(state["out"], F.array(kept)).alias("out"))

    fenced = F.aggregate(lines, start, step, lambda s: s["out"])
    out = F.when(F.contains(text, F.lit("```")), fenced).otherwise(F.transform(lines, inline_cleanup))
    before = lambda i: F.get(out, i - 1)
    return strip(F.array_join(F.filter(out, lambda s, i: (s != "") | (i == 0) | (before(i) != "")), "\n"))


def summary(text: Column, most: int = 256) -> Column:
    """The first line that is not blank, trimmed and cut."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: strip(s) != "")
    return F.when(F.size(lines) > 0, F.substring(strip(F.get(lines, F.lit(0))), 1, most)).otherwise(F.lit(""))


def first_line(text: Column, most: int = 256) -> Column:
    return F.substring(strip(F.get(F.split(text, "\n"), F.lit(0))), 1, most)


def normal_path(path: Column) -> Column:
    return strip(F.replace(path, F.lit("\\"), F.lit("/")))


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_unescape(text: Column) -> Column:
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("'", "&#39;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def html_title(html: Column) -> Column:
    """The text of the first h1, else of title, else ''."""

    def inner(tag: str) -> Column:
        found = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        return strip(html_unescape(F.regexp_replace(found, r"(?s)<[^>]*>", "")))

    return F.coalesce(F.nullif(inner("h1"), F.lit("")), inner("title"), F.lit(""))


def html_links(html: Column) -> Column:
    """The targets of all anchors, in double, single or no quotes."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), 1)
    return F.transform(found, lambda h: F.regexp_replace(h, r"""^["']|["']$""", ""))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def url_kept(url: Column, excluded: Sequence[str] = ("/accelerators/", "/advanced/")) -> Column:
    """Whether no excluded part is in the URL, whatever the case."""
    return ~contains_any(F.lower(url), [e.lower() for e in excluded])


def is_doc_page(url: Column) -> Column:
    return url.endswith(".html") & ~url.endswith("index.html")


def prefix_kept(rel: Column, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> Column:
    """Prefix include (all, if none is named), then exclude."""
    starts = lambda prefixes: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(rel, p))
    kept = starts(includes) if includes else F.lit(True)
    return kept & ~starts(excludes) if excludes else kept


def rel_path(url: Column, root: str) -> Column:
    """The URL's path below ``root`` without ``.html`` and outer slashes."""
    rest = F.when(url.startswith(root), F.substring(url, len(root) + 1, 1 << 20)).otherwise(url)
    return F.regexp_replace(F.regexp_replace(rest, r"\.html$", ""), r"^/+|/+$", "")


def source_url(rel: Column, root: str) -> Column:
    """Where a page's source stands in a repository: its path below ``root``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), rel, F.lit(".rst"))


def sources_txt_url(rel: Column, root: Column) -> Column:
    """Where a documentation site keeps the copy of a page's source."""
    return url_join(root, F.concat(F.lit("_sources/"), rel, F.lit(".rst.txt")))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its dot segments resolved."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    step = lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(p == ".", out).otherwise(F.concat(out, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, F.lit("/")).otherwise(F.lit("")))


def url_join(base: Column, link: Column) -> Column:
    """A link against the page it stands on, its dot segments resolved."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    own = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.regexp_extract(link, r"^[^?#]*((?s:.*))$", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(own == "", F.concat(origin, path, F.when(rest.startswith("?"), F.lit("")).otherwise(query), rest))
        .otherwise(F.concat(origin, _without_dots(whole), rest))
    )


def display(title: Column, func_name: Column, short: Column, text: Column, path: Column) -> Column:
    """What a result shows: title, function, summary, the text's first 120
    characters, or the path."""
    preview = F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 120), F.lit("..."))).otherwise(text)
    given = [F.nullif(c, F.lit("")) for c in (title, func_name, short, preview)]
    return F.coalesce(*given, path, F.lit(""))


def path_kept(path: Column, filters: Sequence[str]) -> Column:
    """Whether a path holds one of the filters, backslashes read as slashes on
    both sides; without filters every path does."""
    return contains_any(normal_path(path), [f.replace("\\", "/") for f in filters]) if filters else F.lit(True)


def path_excluded(path: Column, names: Sequence[str], include_tests: bool = False, substring: bool = False) -> Column:
    """Whether a repository path is left out: by whole path segments, or with
    ``substring`` anywhere in the path, as looser tools do."""
    path = normal_path(path)
    if substring:
        hit = contains_any(path, names)
        return hit if include_tests else hit | F.contains(F.lower(path), F.lit("test"))
    stems = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"\.py$", ""))
    hit = F.arrays_overlap(stems, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)
    return hit if include_tests else hit | F.exists(stems, lambda s: F.lower(s).rlike(r"^tests?$|^test_|_test$"))
