"""Structure-aware chunking of Markdown documents.

A whole corpus is chunked in narrow stages. Sections, whose paths and ids depend on all
headings before them, are found in one Arrow pass that is linear in the text; every
further step is a column expression that turns one chunk into an array of chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marram.config import RetrievalConfig
from marram.functions import text as T
from marram.functions.packer import greedy
from marram.operators.ranking import spread

MAX_ITEMS = 10

# fixed values: line shapes that open a part
_HEADING = r"#{1,6}[^\S\n]+[^\n]+"
_API_METHOD = r'<h4 id="[^"\n]+"><code>[^\n]+?</code></h4>(?=\n|\z)'
_SIGNATURE = r"(?:final\s+)?(?:public|protected|private)\s+(?:static\s+)?function\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\("
_FENCE = r"[ \t]*```php[ \t]*\n"

_PARTS = ("part", "api_items_part", "method_annotations_part", "method_signatures_part", "examples_part", "table_part")
FIELDS = ("id", "content", "section", "heading_path", "method", "event_component", *_PARTS)


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _before(c: Column, line: str) -> Column:
    """Pieces of ``c``, each but perhaps the first opening with a line like ``line``."""
    return F.filter(F.split(c, rf"(?m)(?=^{line})"), lambda x: x != "")


def _chunk(base: dict[str, Column], **changed: Column) -> Column:
    """A chunk struct that takes from ``base`` what is not changed."""
    return F.struct(*((changed.get(f, base[f])).alias(f) for f in FIELDS))


def _row() -> dict[str, Column]:
    return {f: F.col(f) for f in FIELDS}


_HEAD = re.compile(r"^(#{1,6})[^\S\n]+([^\n]+)", re.M)
_SECTION = "doc string, id string, content string, section string, heading_path array<string>"


def sections(document: str, content: str) -> list[tuple[str, str, str | None, list[str]]]:
    """``id, content, section, heading_path`` of a document by heading, in one pass.

    A heading closes all open headings of its level or deeper. Text before the first
    heading is the root. Fences are not looked at: a comment line in a code block that
    looks like a heading opens a section. The n-th chunk of one id gets ``-n``.
    """
    heads = list(_HEAD.finditer(content))
    starts = [m.start() for m in heads]
    out, open_, seen = [], [], {}

    def add(text: str) -> None:
        base = "::".join([document, *(slug for _, _, slug in open_)]) if open_ else f"{document}::root"
        n = seen[base] = seen.get(base, 0) + 1
        path = [title for _, title, _ in open_]
        out.append((base if n == 1 else f"{base}-{n}", text.strip(T.SPACES), path[-1] if path else None, path))

    before = content[: starts[0]] if starts else content
    if before:
        add(before)
    for m, start, end in zip(heads, starts, [*starts[1:], len(content)]):
        level, title = len(m[1]), m[2].strip(T.SPACES)
        while open_ and open_[-1][0] >= level:
            open_.pop()
        open_.append((level, title, T.slug_text(title)))
        add(content[start:end])
    return out


def _named(r: dict[str, Column], name: Column, content: Column, **more: Column) -> Column:
    return _chunk(
        r,
        id=F.concat(r["id"], F.lit("::"), T.slug(name)),
        content=T.trim_all(content),
        section=name,
        heading_path=F.concat(r["heading_path"], F.array(name)),
        **more,
    )


def _by_marker(r: dict[str, Column], line: str, name: str) -> Column:
    """Text before the first marker keeps the chunk's id; each marked piece is a method."""
    pieces = _before(r["content"], line)
    method = lambda p: T.trim_all(F.regexp_extract(p, name, 1))
    made = F.transform(pieces, lambda p: F.when(p.rlike(rf"\A{line}"), _named(r, method(p), p, method=method(p))).otherwise(_chunk(r, content=T.trim_all(p))))
    return F.filter(made, lambda c: c["content"] != "")


def api_methods(r: dict[str, Column]) -> Column:
    return _by_marker(r, _API_METHOD, r"<code>([^\n]+?)</code></h4>")


def signature_blocks(r: dict[str, Column]) -> Column:
    line = rf"{_FENCE}(?:[ \t]*\n)*[ \t]*{_SIGNATURE}"
    return _by_marker(r, line, rf"\A{_FENCE}(?:[ \t]*\n)*[ \t]*(?:final\s+)?(?:public|protected|private)\s+(?:static\s+)?function\s+(\w+)")


def has_events(r: dict[str, Column]) -> Column:
    c = r["content"]
    return F.coalesce((r["section"] == "List of Events") & c.contains("| Component") & c.contains("| Event") & c.contains("| Parameters"), F.lit(False))


def events(r: dict[str, Column]) -> Column:
    """Rows of the table of events by their first cell, in order of appearance, under a repeated head."""
    is_row = lambda x: F.trim(x).rlike(r"^\|.*\|")
    lines = _lines(r["content"])
    rows = F.filter(lines, is_row)
    head = F.slice(rows, 1, 2)
    data = F.filter(F.slice(rows, 3, F.size(rows) + 1), lambda x: F.size(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|")) >= 3)
    cell = lambda x: T.trim_all(F.get(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), 0))
    keys = F.array_distinct(F.transform(data, cell))
    name = T.link_text
    groups = F.transform(
        keys, lambda k: _named(r, name(k), F.array_join(F.concat(head, F.filter(data, lambda x: cell(x) == k)), "\n"), event_component=name(k))
    )
    first = F.array_position(F.transform(lines, is_row), True).cast("int")
    prefix = T.trim_all(F.array_join(F.slice(lines, 1, F.greatest(first - 1, F.lit(0))), "\n"))
    split = F.when(prefix != "", F.concat(F.array(_chunk(r, content=prefix)), groups)).otherwise(groups)
    return F.when(F.size(rows) < 3, F.array(_chunk(r))).otherwise(split)


def blocks(content: Column) -> Column:
    """Blocks between blank lines; fenced code is never cut and ends its block.

    Line breaks inside fences are hidden, a blank line is put after each closing fence,
    and the text is split at blank lines.
    """
    pieces = F.split(content, r"(?m)(?=^[ \t]*```)")
    opens = F.when(F.get(pieces, 0).rlike(r"\A[ \t]*```"), 0).otherwise(1)  # index of the first fence
    marked = F.transform(
        pieces,
        lambda p, i: F.when((i >= opens) & ((i - opens) % 2 == 0), F.translate(p, "\n", "\x01"))
        .when((i >= opens) & ((i - opens) % 2 == 1), F.regexp_replace(p, r"\A([^\n]*)\n?", "$1\n\n"))
        .otherwise(p),
    )
    split = F.split(F.array_join(marked, ""), r"\n(?:[^\S\n]*\n)+")
    return F.filter(F.transform(split, lambda b: T.trim_all(F.translate(b, "\x01", "\n"))), lambda b: b != "")


def join_headings(bs: Column) -> Column:
    """Blocks that are only a heading go in front of the next block; a trailing one stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("wait"))
    both = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b))

    def step(s: Column, b: Column) -> Column:
        lone = b.rlike(rf"\A{_HEADING}\z")
        return F.struct(
            F.when(lone, s["out"]).otherwise(F.concat(s["out"], F.array(both(s["wait"], b)))).alias("out"),
            F.when(lone, both(s["wait"], b)).otherwise("").alias("wait"),
        )

    return F.aggregate(bs, start, step, lambda s: F.when(s["wait"] != "", F.concat(s["out"], F.array(s["wait"]))).otherwise(s["out"]))


def _parts(r: dict[str, Column], groups: Column, field: str, suffix: str, render) -> Column:
    return F.transform(
        groups,
        lambda g, i: _chunk(r, id=F.concat(r["id"], F.lit(f"::{suffix}-"), (i + 1).cast("string")), content=T.trim_all(render(g)), **{field: (i + 1).cast("int")}),
    )


def oversized(r: dict[str, Column], limit: int) -> Column:
    return _parts(r, greedy(join_headings(blocks(r["content"])), limit), "part", "part", lambda g: F.array_join(g, "\n\n"))


def _fenced(c: Column) -> Column:
    """Text inside fences of PHP code."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)(?m)^[ \t]*```php[ \t]*\n(.*?)^[ \t]*```[ \t]*$"), 1)
    return F.array_join(found, "")


def _unless_one(r: dict[str, Column], items: Column, made: Column) -> Column:
    return F.when(F.size(items) <= 1, F.array(_chunk(r))).otherwise(made)


def examples(r: dict[str, Column], limit: int) -> Column:
    """Query examples inside fences, cut in front of each ``// SELECT``."""
    items = F.filter(F.transform(_before(_fenced(r["content"]), r"[ \t]*// SELECT"), T.trim_all), lambda x: x != "")
    head = "### Examples\n\n```php\n"
    return _unless_one(r, items, _parts(r, greedy(items, limit, 4), "examples_part", "examples", lambda g: F.concat(F.lit(head), F.array_join(g, "\n\n"), F.lit("\n```"))))


def is_examples(r: dict[str, Column]) -> Column:
    c = r["content"]
    return F.coalesce((r["section"] == "Examples") & (F.size(F.split(c, "// SELECT")) > 2) & c.contains("$builder"), F.lit(False))


def api_items(r: dict[str, Column], limit: int) -> Column:
    items = F.transform(F.regexp_extract_all(r["content"], F.lit(r"(?s)<ApiItem\b.*?</ApiItem>"), 0), T.trim_all)
    prefix = T.trim_all(F.get(F.split(r["content"], r"<ApiItem\b", 2), 0))
    groups = greedy(items, limit, T.word_count(prefix) + 1, MAX_ITEMS)
    made = _parts(r, groups, "api_items_part", "api-items", lambda g: F.concat(prefix, F.lit("\n\n"), F.array_join(g, "\n\n"), F.lit("\n\n</ApiList>")))
    return F.when(F.size(items) == 0, F.array(_chunk(r))).otherwise(made)


def table_rows(r: dict[str, Column], limit: int) -> Column:
    lines = _lines(r["content"])
    head = F.array_join(F.slice(lines, 1, 2), "\n")
    rows = F.slice(lines, 3, F.size(lines) + 1)
    groups = greedy(rows, limit, T.word_count(head))
    return _parts(r, groups, "table_part", "table", lambda g: F.concat(head, F.lit("\n"), F.array_join(g, "\n")))


def is_table(r: dict[str, Column]) -> Column:
    lines = F.filter(_lines(r["content"]), lambda x: F.trim(x) != "")
    return (F.size(lines) >= 3) & F.trim(F.get(lines, 0)).startswith("|") & F.trim(F.get(lines, 1)).startswith("|")


def signature_list(r: dict[str, Column], limit: int) -> Column:
    items = F.filter(F.transform(_before(_fenced(r["content"]), rf"[ \t]*{_SIGNATURE}"), T.trim_all), lambda x: x != "")
    render = lambda g: F.concat(F.lit("```php\n"), F.array_join(g, "\n\n"), F.lit("\n```"))
    return _unless_one(r, items, _parts(r, greedy(items, limit, 2), "method_signatures_part", "method-signatures", render))


def annotations(r: dict[str, Column], limit: int) -> Column:
    items = F.filter(_lines(r["content"]), lambda x: F.trim(x).startswith("@method "))
    return _unless_one(r, items, _parts(r, greedy(items, limit), "method_annotations_part", "method-annotations", lambda g: F.array_join(g, "\n")))


def _each(df: DataFrame, chunks: Column) -> DataFrame:
    return df.select("doc", F.posexplode(chunks)).select("doc", *(F.col(f"col.{f}").alias(f) for f in FIELDS))


def split_sections(documents: DataFrame) -> DataFrame:
    """``doc, content`` by heading; see :func:`sections`. An Arrow stage, linear in the text."""
    schema = to_arrow_schema(StructType.fromDDL(_SECTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in sections(d, t)]
            cols = zip(*rows) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    given = documents.where("doc is not null and content is not null").select(F.col("doc").cast("string").alias("doc"), F.regexp_replace("content", r"\r\n?", "\n").alias("content"))
    nulls = {f: F.lit(None).cast("int") for f in _PARTS} | {f: F.lit(None).cast("string") for f in ("method", "event_component")}
    return spread(given).mapInArrow(run, _SECTION).select("doc", *(nulls[f].alias(f) if f in nulls else F.col(f) for f in FIELDS))


def chunk_documents(documents: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Chunks of ``doc, content``: sections, methods and event tables, then parts of what is too long.

    Null content gives no chunk; empty content is a root without substance and is
    dropped. Order of documents does not matter; chunks of one document keep theirs.
    """
    limit = config.max_words
    n = T.word_count(F.col("content"))
    s = split_sections(documents)
    r = _row()
    c = F.col("content")
    keep = F.array(_chunk(r))
    fenced_signature = c.rlike(rf"(?m)^{_FENCE}(?:[ \t]*\n)*[ \t]*{_SIGNATURE}")
    s = _each(
        s,
        F.when(c.rlike(rf"(?m)^{_API_METHOD}"), api_methods(r))
        .when(has_events(r), events(r))
        .when((n > limit) & fenced_signature, signature_blocks(r))
        .otherwise(keep),
    ).where(T.keep_chunk(F.col("section"), c))
    s = _each(s, F.when(n > limit, oversized(r, limit)).otherwise(keep))
    several = lambda p: F.size(F.regexp_extract_all(c, F.lit(p), 0)) > 1
    return _each(
        s,
        F.when(n <= limit, keep)
        .when(is_examples(r), examples(r, limit))
        .when(c.contains("<ApiList>") & c.contains("<ApiItem ") & c.contains("</ApiItem>"), api_items(r, limit))
        .when(is_table(r), table_rows(r, limit))
        .when(several(rf"(?m)^[ \t]*{_SIGNATURE}"), signature_list(r, limit))
        .when(several(r"(?m)^[ \t]*@method "), annotations(r, limit))
        .otherwise(keep),
    )
