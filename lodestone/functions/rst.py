"""reStructuredText to plain text with fenced code.

The line grammar looks ahead and eats a varying number of lines, which built-in
functions cannot say; it runs in Arrow batches, everything after it as Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Directives whose body goes, and those whose body is code.
STRIPPED = ("video", "image", "figure", "raw", "include", "toctree", "embed", "gallery", "thumbnail", "plot", "testsetup", "testcleanup")
CODE = ("code-block", "code", "sourcecode", "ipython", "pycon", "console", "parsed-literal")
# Heading signs from the highest level down.
HEADINGS = '#*=^"+-:.'

_DIRECTIVE = re.compile(r"\s*\.\.\s+([a-zA-Z0-9_-]+)::(.*)$")
_TARGET = re.compile(r"\.\.\s*_[A-Za-z0-9_.-]+:\s*$")
_INLINE = [
    (re.compile(r":\w+:`([^`]+)`"), r"\1"),
    (re.compile(r"`([^`<]+?)\s*<[^>`]+>`_"), r"\1"),
    (re.compile(r"`([^`]+?)`_"), r"\1"),
    (re.compile(r"``([^`]+)``"), r"\1"),
    (re.compile(r"\|[^|\s]+\|"), ""),
    (re.compile(r"\s+"), " "),
]


class _Lines:
    """A text's lines with a place to read on from."""

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.at = lines, 0

    def __bool__(self) -> bool:
        return self.at < len(self.lines)

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.lines[i] if i < len(self.lines) else None

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.lines[self.at - n]

    def skip_options(self, depth: int) -> None:
        """Past blank lines and indented ``:option:`` lines."""
        while self and ((line := self.peek()).strip() == "" or (indent(line) > depth and line.lstrip().startswith(":"))):
            self.take()

    def block(self, depth: int) -> str:
        """The lines indented deeper than ``depth``, one level taken off."""
        got = []
        while self and ((line := self.peek()).strip() == "" or indent(line) > depth):
            self.take()
            got.append(line[min(indent(line) - depth, 4) :] if line.strip() else "")
        return "\n".join(got).rstrip()


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _sign(line: str | None) -> str | None:
    """The sign a line consists of, or None."""
    line = (line or "").rstrip()
    return line[0] if line and line == line[0] * len(line) else None


def _heading(title: str, sign: str) -> str:
    level = min(HEADINGS.index(sign) + 1, 6) if sign in HEADINGS else 3
    return "#" * level + " " + title


def headings(lines: list[str]) -> list[str]:
    """Titles with adornment lines as Markdown headings."""
    src, out = _Lines(lines), []
    while src:
        first, second, third = src.peek().strip(), src.peek(1), src.peek(2)
        over, title = _sign(src.peek()), (second or "").strip()
        if third is not None and over and title and over == _sign(third) and min(len(src.peek().rstrip()), len(third.rstrip())) >= len(title):
            out.append(_heading(title, over))
            src.take(3)
        elif first and (under := _sign(second)) and len(second.rstrip()) >= len(first):
            out.append(_heading(first, under))
            src.take(2)
        else:
            out.append(src.take())
    return out


def _tidy(text: str) -> str:
    """Inline markup to its text outside fences; runs of blank lines to one."""
    out, fenced = [], False
    for line in text.splitlines():
        if line.strip().startswith("```"):
            fenced = not fenced
        elif not fenced:
            for pattern, to in _INLINE:
                line = pattern.sub(to, line)
            line = line.strip()
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out).strip()


def convert(rst: str | None, stripped: frozenset[str] = frozenset(STRIPPED)) -> tuple[str, list[dict[str, str | None]]]:
    """(text, code blocks) of a document."""
    kept = [ln for ln in (rst or "").splitlines() if ln.strip() != ":orphan:" and not _TARGET.match(ln.strip())]
    src, out, code = _Lines(headings(kept)), [], []

    def fence(body: str, lang: str | None, shown: str) -> None:
        code.append({"lang": lang, "code": body})
        out.extend(["```" + shown, body, "```"])

    while src:
        line = src.take()
        depth = indent(line)
        if found := _DIRECTIVE.match(line):
            name = found[1].lower()
            src.skip_options(depth)
            body = src.block(depth)
            if name in CODE:
                lang = "text" if name == "parsed-literal" else found[2].strip() or None
                if body:
                    fence(body, lang, lang or "")
            elif name not in stripped and body:
                out.append(body)
        elif line.rstrip().endswith("::") and not line.lstrip().startswith(".. "):
            out.append(line.rstrip()[:-1])
            mark = src.at
            if body := src.block(depth):
                fence(body, "text", "")
            else:
                src.at = mark
        else:
            out.append(line)
    return _tidy("\n".join(out)), code


def _clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([convert(t) for t in batch], columns=["text", "code_blocks"])


def clean_rst(text: Column) -> Column:
    """struct<text, code_blocks> of a reStructuredText column."""
    kind = "struct<text: string, code_blocks: array<struct<lang: string, code: string>>>"
    return F.pandas_udf(_clean, kind)(text)
