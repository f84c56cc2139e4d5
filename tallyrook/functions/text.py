"""Scalar functions on texts, as columns; Python only where Spark has no function."""

from __future__ import annotations

import unicodedata
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyrook.schemas import CONTENT_CHARS, EXCERPT_CHARS, TITLE_CHARS, TRUNCATED, TRUNCATED_ROOM


def collapse(text: Column) -> Column:
    """White space runs (of Unicode) as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def truncate(text: Column, chars: int) -> Column:
    """Longer texts lose their end to a marker that fits into the limit."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - TRUNCATED_ROOM), F.lit(TRUNCATED))).otherwise(text)


def title(text: Column) -> Column:
    """The first line that is not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    line = F.regexp_replace(F.get(lines, 0), r"(?U)^\s+|\s+$", "")
    return truncate(F.coalesce(line, F.lit("Memory")), TITLE_CHARS)


def excerpt(text: Column) -> Column:
    return truncate(text, EXCERPT_CHARS)


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of at least two letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2))


def search_text(title_: Column, kind: Column, tags: Column, content: Column) -> Column:
    return F.concat(title_, F.lit("\nkind: "), kind, F.lit("\ntags: "), F.array_join(tags, ", "), F.lit("\n"), content)


def metadata(text: Column, chars: int = 512) -> Column:
    """Control characters as blanks, trimmed, truncated; null where nothing is left."""
    plain = F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "))
    return F.when(plain != "", truncate(plain, chars))


def safe_json(json: Column) -> Column:
    """JSON that can stand in markup."""
    return F.replace(F.replace(json, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normal_name(name: Column) -> Column:
    """NFKC, lower case, collapsed."""
    return collapse(F.lower(_nfkc(name)))


# Suffixes of files with code.
CODE_SUFFIXES = (".rs", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".swift", ".kt", ".kts", ".sql", ".sh", ".yaml", ".yml", ".json")


def code_like(source: Column) -> Column:
    """Whether a source names a file with code."""
    return reduce(or_, (F.lower(source).contains(x) for x in CODE_SUFFIXES))


def code_like_sql(source: str) -> str:
    return " OR ".join(f"contains(lower({source}), '{x}')" for x in CODE_SUFFIXES)


#: Chunks of a text at most.
MOST_CHUNKS = 100


def _pack(content: str, limit: int) -> list[str]:
    """Blocks between blank lines (none inside fences), packed up to the limit; longer blocks are cut at words."""
    blocks, block, fenced = [], [], False
    for line in [*content.replace("\r\n", "\n").split("\n"), None]:
        if line is not None and line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        if line is None or (not line.strip() and not fenced):
            whole = "\n".join(block).strip()
            if whole:
                blocks.append(whole)
            block = []
        else:
            block.append(line)
    chunks, held = [], ""
    for whole in blocks:
        if len(whole) > limit:
            chunks += [held] if held else []
            chunks += _cut_at_words(whole, limit)
            held = ""
        elif held and len(held) + 2 + len(whole) > limit:
            chunks.append(held)
            held = whole
        else:
            held = f"{held}\n\n{whole}" if held else whole
    return chunks + ([held] if held else [])


def _cut_at_words(text: str, limit: int) -> list[str]:
    parts: list[str] = []
    for word in text.split():
        if len(word) > limit:
            parts += [word[i : i + limit] for i in range(0, len(word), limit)] + [""]
        elif parts and parts[-1] and len(parts[-1]) + 1 + len(word) <= limit:
            parts[-1] += " " + word
        elif parts and not parts[-1]:
            parts[-1] = word
        else:
            parts.append(word)
    return [p for p in parts if p]


def chunks(text: Column, limit: int = CONTENT_CHARS) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _pack(x or "", limit))

    return run(text)


def chunk_reject(parts: Column) -> Column:
    """Why a text's chunks are refused, or null."""
    return F.when(F.size(parts) == 0, "empty").when(F.size(parts) > MOST_CHUNKS, "too_many_chunks")


class _Text(HTMLParser):
    _BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table"}
    _HIDDEN = {"script", "style", "noscript", "template", "head"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self._HIDDEN
        if tag in self._BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in self._HIDDEN))
        if tag in self._BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def _plain(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


#: Pages that are Python's strings at once.
PAGES = 256


@F.arrow_udf(StringType())
def _html(pages: pa.Array) -> pa.Array:
    """Slice by slice: beside the batch and its texts, only PAGES pages are held."""
    parts = [pa.array([_plain(x) for x in pages.slice(i, PAGES).to_pylist()], pa.string()) for i in range(0, len(pages), PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def html_text(html: Column) -> Column:
    """The visible text of a page, a line for each block."""
    return _html(html)
