"""Text functions as column expressions: they stay inside the JVM and whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: English stop words of the lexical index
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
# fixed values: white space of any script, as Java reads it, and as Python strips it
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACES = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def slug(c: Column) -> Column:
    """Lower case; every run of other characters than ``a-z 0-9 _`` becomes one hyphen; none at the ends."""
    dashed = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def slug_text(x: str) -> str:
    """:func:`slug` of a Python string."""
    return re.sub("[^a-z0-9_]+", "-", x.strip(" ").lower()).strip("-")


def front_matter(c: Column) -> Column:
    """The block between leading ``---`` marks; null where there is none or it is not closed."""
    parts = F.split(c, "---", 3)
    return F.when(c.startswith("---") & (F.size(parts) == 3), F.get(parts, 1))


def front_matter_map(c: Column) -> Column:
    """Flat ``key: value`` lines of a front matter block as a map; the last of equal keys wins."""
    lines = F.regexp_extract_all(c, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*$"), 0)
    key = lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1)
    value = lambda x: F.regexp_replace(F.regexp_extract(x, r"^[\w-]+:[ \t]*(.*?)[ \t]*$", 1), "^[\"'](.*)[\"']$", "$1")
    indexed = F.transform(lines, lambda x, i: F.struct(key(x).alias("k"), value(x).alias("v"), i.alias("i")))
    last = F.filter(indexed, lambda x: ~F.exists(indexed, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def body(c: Column) -> Column:
    """The text after a closed front matter block; the text itself where there is none."""
    parts = F.split(c, "---", 3)
    return F.when(c.startswith("---") & (F.size(parts) == 3), F.regexp_replace(F.get(parts, 2), r"^\s+", "")).otherwise(c)


def clean(c: Column) -> Column:
    """Without link definitions, usage lists and long trees; at most one blank line in a row."""
    # fixed values: what is taken out of a page
    c = F.regexp_replace(c, r"(?m)^\s*\[[^\]]+\]:\s+\S+.*$", "")
    c = F.regexp_replace(c, r"(?s)<ApiUses>.*?</ApiUses>", "")
    c = F.regexp_replace(c, r"(?s)<ApiUsedBy>.*?</ApiUsedBy>", "")
    # trees of more than twenty lines only; possessive, so the match never backtracks
    c = F.regexp_replace(c, r"<ApiTree>(?:(?!</ApiTree>)[^\n])*+(?:\n(?:(?!</ApiTree>)[^\n])*+){20,}+</ApiTree>", "")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def is_noise(c: Column, noise: tuple[str, ...]) -> Column:
    """The text is one of the given boilerplate texts and nothing else; white space around it does not count."""
    return F.coalesce(trim_all(c).isin(*(x.strip(SPACES) for x in noise)), F.lit(False)) if noise else F.lit(False)


def link_text(c: Column) -> Column:
    """Text of a link at the start, else the value."""
    t = F.regexp_extract(c, r"^\[([^\]]+)\]", 1)
    return F.when(t != "", t).otherwise(c)


def chunk_id(document: Column, path: Column) -> Column:
    """``document::slug::slug``; ``document::root`` without a path."""
    return F.when(F.size(path) == 0, F.concat(document, F.lit("::root"))).otherwise(
        F.array_join(F.concat(F.array(document), F.transform(path, slug)), "::")
    )


def terms(c: Column) -> Column:
    """Index terms: runs of two or more letters, digits or underscores in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: ~t.isin(*STOP_WORDS))


def substantive(content: Column) -> Column:
    """Something is left without headings, images, empty links, self-closing tags and rules."""
    # fixed values: what is no substance
    c = F.regexp_replace(content, r"(?m)^#{1,6}\s+.*$", "")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]+\)", "")
    c = F.regexp_replace(c, r"\[\s*\]\[[^\]]+\]", "")
    c = F.regexp_replace(c, r"<[A-Za-z][^>]*/>", "")
    c = F.regexp_replace(c, r"(?m)^\s*---+\s*$", "")
    return F.regexp_replace(c, r"\s+", "") != ""


def keep_chunk(section: Column, content: Column) -> Column:
    """False for summaries of methods, lone headings and chunks without substance."""
    lone = F.regexp_replace(content, r"^\s+|\s+$", "").rlike(r"^#{1,6}[^\S\n]+[^\n]+$")
    return F.coalesce(~(F.coalesce(section, F.lit("")) == "Method Summary") & ~lone & substantive(content), F.lit(False))


def trim_all(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z", "")


def embedding_text(source: Column, file: Column, method: Column, content: Column) -> Column:
    """What is embedded or reranked: code carries its file and method; other sources are empty."""
    code = F.concat(F.lit("File: "), F.coalesce(file, F.lit("")), F.lit("\nMethod: "), F.coalesce(method, F.lit("")), F.lit("\n\n"), content)
    return F.when(source == "code", code).when(source == "docs", content).otherwise("")
