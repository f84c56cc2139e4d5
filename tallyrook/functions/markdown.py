"""Pages as Markdown: headings, lists, tables, links, quotes and code stay structure, so that chunks can be cut between them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: characters of an extracted text at most.
EXTRACTED_CHARS = 600_000
#: Elements within each other at most; what lies deeper is taken as if it stood there.
DEPTH = 100
# Elements by how they are shown.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = {*HEADINGS, "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"iframe", "noscript", "object", "script", "style", "svg", "template", "title"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "del": "~~", "strike": "~~"}
#: What an opening tag ends, and the element within which it does.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "thead"}, {"table"}), "tfoot": ({"tr", "tbody"}, {"table"})}
#: A line break within a paragraph, until it is written.
_BREAK = "\0"


class _Node:
    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def blocks(self) -> bool:
        """Whether it is, or holds, something that stands on lines of its own."""
        return self.tag in BLOCKS or any(isinstance(x, _Node) and x.blocks() for x in self.children)


class _Tree(HTMLParser):
    """The elements of a page, with the ends that a page may leave out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", {})
        self.open = [self.root]

    def _close(self, tags: set[str], within: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in BLOCKS:
            self._close({"p"}, {"table", "td", "th", "li", "blockquote"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in HEADINGS:
            self._close(set(HEADINGS), BLOCKS - set(HEADINGS))
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        within = {"table"} if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else set() if tag in BLOCKS else {"td", "th", "li"}
        self._close({tag}, within)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data.replace("\0", ""))


def _raw(node: _Node) -> str:
    return "".join(x if isinstance(x, str) else "\n" if x.tag == "br" else "" if x.tag in HIDDEN else _raw(x) for x in node.children)


def _fence(text: str, least: int) -> str:
    return "`" * max(least, 1 + max((len(x) for x in re.findall("`+", text)), default=0))


def _target(url: str) -> str:
    url = re.sub(r"\s", "%20", url.strip())
    return f"<{url}>" if re.search(r"[()<>]", url) else url


def _wrapped(mark: str, text: str) -> str:
    """A mark around a text, its outer space left outside."""
    bare = text.strip(" " + _BREAK)
    if not bare:
        return text
    start = text.index(bare)
    return f"{text[:start]}{mark}{bare}{mark}{text[start + len(bare) :]}"


def _inline(node: _Node | str) -> str:
    if isinstance(node, str):
        return re.sub(r"[ \t\n\r\f]+", " ", node)
    if node.tag in HIDDEN:
        return ""
    if node.tag == "br":
        return _BREAK
    if node.tag == "img":
        alt, source = node.attrs.get("alt") or "", node.attrs.get("src") or ""
        return f"![{_line(alt)}]({_target(source)})" if source else _line(alt)
    if node.tag in ("code", "kbd", "samp", "tt"):
        text = " ".join(_raw(node).split())
        fence, pad = _fence(text, 1), " " if text.startswith("`") or text.endswith("`") else ""
        return f"{fence}{pad}{text}{pad}{fence}" if text else ""
    inner = "".join(map(_inline, node.children))
    if node.tag in MARKS:
        return _wrapped(MARKS[node.tag], inner)
    url = node.attrs.get("href") if node.tag == "a" else None
    if url and inner.strip(" " + _BREAK):
        return f"[{_line(inner)}]({_target(url)})"
    return inner


def _line(text: str) -> str:
    """Text within a line on one line."""
    return re.sub(r"[ \t\n\r\f\0]+", " ", text).strip(" ")


def _paragraph(parts: list[str]) -> list[str]:
    lines = [_line(x) for x in "".join(parts).split(_BREAK)]
    return ["  \n".join(x for x in lines if x)] if any(lines) else []


def _indented(text: str, first: str, rest: str) -> str:
    lines = text.split("\n")
    return "\n".join([first + lines[0], *(rest + x if x else rest.rstrip() for x in lines[1:])])


def _list(node: _Node) -> list[str]:
    number = node.attrs.get("start") or "1"
    n = int(number) if re.fullmatch(r"[0-9]{1,9}", number) else 1
    items = []
    for child in node.children:
        own = _Node("li", {})
        own.children = [child] if isinstance(child, str) or child.tag != "li" else child.children
        parts = _blocks(own)
        if parts:
            marker = f"{n + len(items)}. " if node.tag == "ol" else "- "
            # A list right below its item's line needs no empty line between.
            text = parts[0] + "".join(("\n" if re.match(r"- |[0-9]+\. ", x) else "\n\n") + x for x in parts[1:])
            items.append(_indented(text, marker, " " * len(marker)))
    return ["\n".join(items)] if items else []


def _rows(node: _Node) -> list[_Node]:
    found = []
    for child in node.children:
        if isinstance(child, _Node):
            if child.tag == "tr":
                found.append(child)
            elif child.tag != "table":
                found += _rows(child)
    return found


def _table(node: _Node) -> list[str]:
    rows = []
    for row in _rows(node):
        cells = []
        for cell in row.children:
            if isinstance(cell, _Node) and cell.tag in ("td", "th"):
                span = cell.attrs.get("colspan") or "1"
                # Blocks within a cell stand on its line; a table within a table does so too.
                text = _line(" ".join(_blocks(cell))).replace("|", "\\|")
                cells += [text] + [""] * (min(int(span), 100) - 1 if re.fullmatch("[1-9][0-9]{0,3}", span) else 0)
        if any(cells):
            rows.append(cells)
    caption = [x for child in node.children if isinstance(child, _Node) and child.tag == "caption" for x in _blocks(child)]
    if not rows:
        return caption
    wide = max(map(len, rows))
    shown = ["| " + " | ".join(row + [""] * (wide - len(row))) + " |" for row in rows]
    return [*caption, "\n".join([shown[0], "|" + " --- |" * wide, *shown[1:]])]


def _block(node: _Node) -> list[str]:
    if node.tag in HEADINGS:
        text = _line(" ".join(_blocks_of(node.children)))
        return [f"{'#' * int(node.tag[1])} {text}"] if text else []
    if node.tag in ("ul", "ol", "menu"):
        return _list(node)
    if node.tag == "table":
        return _table(node)
    if node.tag == "hr":
        return ["---"]
    if node.tag == "pre":
        text = _raw(node).removeprefix("\n").rstrip()
        named = next((x for x in [node, *node.children] if isinstance(x, _Node) and "language-" in (x.attrs.get("class") or "")), None)
        language = re.search(r"language-([\w+#.-]+)", named.attrs["class"]) if named else None
        fence = _fence(text, 3)
        return [f"{fence}{language[1] if language else ''}\n{text}\n{fence}"] if text.strip() else []
    inner = _blocks(node)
    return [_indented("\n\n".join(inner), "> ", "> ")] if node.tag == "blockquote" and inner else inner


def _blocks(node: _Node) -> list[str]:
    return _blocks_of(node.children)


def _blocks_of(children: list) -> list[str]:
    out, run = [], []
    for child in children:
        if isinstance(child, _Node) and child.tag not in HIDDEN and child.blocks():
            out += _paragraph(run)
            run = []
            out += _block(child) if child.tag in BLOCKS else _blocks(child)
        else:
            run.append(_inline(child))
    return out + _paragraph(run)


def page(html: str) -> str:
    """A page as Markdown."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return "\n\n".join(_blocks(tree.root))


@F.pandas_udf(StringType())
def _pages(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: page(x or ""))


def html_markdown(html: Column) -> Column:
    """The visible content of pages as Markdown; null and empty ones give an empty text.

    Blocks are apart by an empty line, list items and table rows by lines. Text is not escaped (but bars in cells), so that it reads as
    written. Pages are read whole; ends of elements may be missing, and are where a browser would see them, but for marks that
    reach beyond a block: these end with it.
    """
    return _pages(html)


def extraction_reject(text: Column, most: int = EXTRACTED_CHARS) -> Column:
    """Why an extracted text is refused, or null."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.length(text) > most, "too_long")


def outline(text: Column) -> Column:
    """headings (texts with their marks), links (`text` and `target` as written) and items (how many) of Markdown, outside fences."""
    plain = F.regexp_replace(text, r"(?ms)^(`{3,})[^\n]*\n.*?\n\1$", "")
    heads = F.regexp_extract_all(plain, F.lit(r"(?m)^(#{1,6} .*)$"), F.lit(1))
    links = F.transform(F.regexp_extract_all(plain, F.lit(r"(?<!!)\[([^\]\n]*\]\([^)\s]*)\)"), F.lit(1)), lambda x: F.struct(F.substring_index(x, "](", 1).alias("text"), F.substring_index(x, "](", -1).alias("target")))
    items = F.size(F.regexp_extract_all(plain, F.lit(r"(?m)^ *(?:>\s*)*(- |[0-9]+\. )"), F.lit(1)))
    return F.struct(heads.alias("headings"), links.alias("links"), items.cast("long").alias("items"))
