"""Pages to Markdown: what carries no content goes, the main region stays, and headings, lists, tables, links and emphasis are written."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content; where the main region is, the best first, as (tag, attribute, value).
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "link", "head"}
MAIN = (("main", None, None), (None, "role", "main"), ("article", None, None), (None, "id", "content"), (None, "id", "main"), (None, "class", "content"))

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "hr", "li", "main", "nav", "ol",
    "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What a start tag ends: open elements of these names, no further out than the named borders.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_SPECIAL = re.compile(r"([\\`*_\[\]])")
_BREAK = "\x00"


class _Open:
    """An open element and what it holds so far: (whether a block, text)."""

    __slots__ = ("tag", "attrs", "parts", "order", "rows")

    def __init__(self, tag: str, attrs: dict, order: int):
        self.tag, self.attrs, self.parts, self.order, self.rows = tag, attrs, [], order, []


def _joined(parts: list[tuple[bool, str]], between: str = "\n\n") -> str:
    """Blocks one below the other; text between them, its white space collapsed, is a block of its own."""
    out, run = [], []

    def flush() -> None:
        text = re.sub(f" ?{_BREAK} ?", "  \n", _SPACE.sub(" ", "".join(run)).strip(f" {_BREAK}"))
        if text:
            out.append(text)
        run.clear()

    for block, text in parts:
        if block:
            flush()
            if text:
                out.append(text)
        else:
            run.append(text)
    flush()
    return between.join(out)


class Writer(HTMLParser):
    """Elements are written as they end, inside out, so nesting of any depth needs no recursion.

    Malformed pages: an end tag ends all that is open inside its element, and is ignored without one; a paragraph ends where a
    block begins, list items, rows and cells where the next one does; what is open at the end ends there.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", {}, 0)]
        self.count = self.pre = self.dropped = 0
        self.main: dict[int, tuple[int, str]] = {}
        self.body: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dropped:
            self.dropped += tag in DROPPED and tag not in _VOID
            return
        if tag in DROPPED:
            self.dropped += tag not in _VOID
            return
        if tag in _BLOCK:
            self._end_inside({"p"}, _BLOCK - {"p"})
        if tag in _ENDS:
            self._end_inside(*_ENDS[tag])
        self.count += 1
        self.open.append(_Open(tag, dict(attrs), self.count))
        self.pre += tag == "pre"
        if tag in _VOID:
            self._end()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            self.dropped -= tag in DROPPED and tag not in _VOID
            return
        if tag not in _VOID and any(e.tag == tag for e in self.open):
            while self.open[-1].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.open[-1].parts.append((False, data if self.pre else _SPECIAL.sub(r"\\\1", data.replace(_BREAK, ""))))

    def _end_inside(self, tags: set[str], borders: set[str]) -> None:
        """End the innermost open element of these names, if no border stands between."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                while len(self.open) > k:
                    self._end()
                return
            if self.open[k].tag in borders:
                return

    def _end(self) -> None:
        element = self.open.pop()
        self.pre -= element.tag == "pre"
        text, block = self._written(element)
        classes = (element.attrs.get("class") or "").split()
        for k, (tag, name, value) in enumerate(MAIN):
            fits = element.tag == tag if tag else value in classes if name == "class" else element.attrs.get(name) == value
            if fits and (k not in self.main or element.order < self.main[k][0]):
                self.main[k] = element.order, _joined([(block, text)])
        if element.tag == "body" and self.body is None:
            self.body = text
        self.open[-1].parts.append((block, text))

    def _written(self, e: _Open) -> tuple[str, bool]:
        """(Markdown, whether it is a block)."""
        tag, outer = e.tag, self.open[-1]
        if tag in ("td", "th"):
            outer.rows.append((tag, _joined(e.parts, " ").replace("\n", " ").replace("|", "\\|")))
            return "", True
        if tag in ("tr", "thead", "tbody", "tfoot"):
            outer.rows += [e.rows] if tag == "tr" and e.rows else e.rows if tag != "tr" else []
            return _joined(e.parts), True
        if tag == "table":
            return "\n\n".join(filter(None, [_joined(e.parts), self._table(e.rows)])), True
        if tag == "pre":
            return "```\n" + "".join(t for _, t in e.parts).strip("\n") + "\n```", True
        if tag == "br":
            return _BREAK, False
        if tag == "hr":
            return "* * *", True
        if tag == "img":
            alt = _SPACE.sub(" ", e.attrs.get("alt") or "")
            return (f"![{alt}]({e.attrs['src']})" if e.attrs.get("src") else ""), False
        if tag in ("ul", "ol"):
            return _joined(e.parts, "\n"), True
        if tag == "li":
            number = 1 + sum(block and bool(t) for block, t in outer.parts)
            mark = f"{number}. " if outer.tag == "ol" else "- "
            return mark + _joined(e.parts, "\n").replace("\n", "\n" + " " * len(mark)), True
        if tag in _BLOCK:
            text = _joined(e.parts)
            if tag[0] == "h" and tag[1:].isdigit():
                text = text.replace("  \n", " ").replace("\n", " ")
                return (f"{'#' * int(tag[1])} {text}" if text else ""), True
            return ("\n".join(f"> {line}".rstrip() for line in text.split("\n")) if tag == "blockquote" and text else text), True
        if any(block for block, _ in e.parts):
            return _joined(e.parts), True  # blocks inside an inline element
        inner = "".join(t for _, t in e.parts)
        text = inner.strip(" \t\n\r\f")
        around = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`"}.get(tag)
        if not text or not (around or tag == "a" and e.attrs.get("href")):
            return inner, False
        lead, tail = (" " if inner[:1].isspace() else ""), (" " if inner[-1:].isspace() else "")
        return f"{lead}{around}{text}{around}{tail}" if around else f"{lead}[{text}]({e.attrs['href']}){tail}", False

    def _table(self, rows: list[list[tuple[str, str]]]) -> str:
        if not any(text for row in rows for _, text in row):
            return ""
        width = max(map(len, rows))
        lines = ["| " + " | ".join([text for _, text in row] + [""] * (width - len(row))) + " |" for row in rows]
        head = all(tag == "th" for tag, _ in rows[0])
        rule = "|" + " --- |" * width
        return "\n".join([*lines[:1], rule, *lines[1:]] if head else ["|" + "  |" * width, rule, *lines])

    def result(self) -> str:
        while len(self.open) > 1:
            self._end()
        best = next((text for k in range(len(MAIN)) if (text := self.main.get(k, (0, ""))[1]).strip()), None)
        text = best if best is not None else self.body if self.body is not None else _joined(self.open[0].parts)
        return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(html: str | None) -> str:
    """The page's main region as Markdown: the first element of the best name in MAIN that has any, else the body. Null is empty."""
    writer = Writer()
    writer.feed(html or "")
    writer.close()
    return writer.result()


@F.pandas_udf(T.StringType())
def markdown(html: pd.Series) -> pd.Series:
    """``to_markdown`` in Arrow batches."""
    return html.map(to_markdown)
