"""Prompts, offline stand-ins for generation and rewriting, and the ask pipeline's surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions import text as T

MAX_QUESTION = 2000

RULES = (
    "Use only the numbered excerpts below.",
    "Say so when they do not answer the question.",
    "Put the number of each excerpt you rely on in square brackets.",
    "Prefer documentation for behaviour that is promised, code for how it is done.",
    "The user's own code is the subject of the question, not a source.",
)


# fixed values: the labels of an excerpt
LABELS = {"docs": ("Type: DOCUMENTATION", "File: ", "Section: ", "Content: "), "code": ("Type: SOURCE CODE", "File: ", "Method: ", "Lines: ", "Content:")}


def excerpt(chunk: Column) -> Column:
    """A chunk as the generator reads it; empty for a source that is neither docs nor code."""
    s = lambda f: F.coalesce(chunk[f].cast("string"), F.lit("None"))
    d, k = LABELS["docs"], LABELS["code"]
    docs = F.concat(F.lit(f"{d[0]}\n{d[1]}"), s("file"), F.lit(f"\n{d[2]}"), s("section"), F.lit(f"\n{d[3]}"), chunk["content"])
    code = F.concat(
        F.lit(f"{k[0]}\n{k[1]}"), s("file"), F.lit(f"\n{k[2]}"), s("method"), F.lit(f"\n{k[3]}"), s("start_line"), F.lit("-"), s("end_line"), F.lit(f"\n{k[4]}\n"), chunk["content"]
    )
    return F.when(chunk["source"] == "docs", docs).when(chunk["source"] == "code", code).otherwise("")


def rerank_text() -> Column:
    """What a reranker reads of a row of the corpus."""
    return T.embedding_text(F.col("source"), F.col("file"), F.col("method"), F.col("text"))


def context(chunks: Column) -> Column:
    """Numbered excerpts of an ordered array of chunks; empty for an empty array."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), excerpt(c), F.lit("\n\n"))), "")


HEAD = "You answer questions about a software framework.\n" + "".join(f"- {r}\n" for r in RULES)


def prompt(question: Column, numbered: Column, selected: Column | None = None) -> Column:
    """The whole prompt; the user's code comes in only when there is some."""
    head = HEAD
    code = F.lit("") if selected is None else F.when(selected.isNotNull() & (selected != ""), F.concat(F.lit("\nCode of the user:\n```\n"), selected, F.lit("\n```\n"))).otherwise("")
    return F.concat(F.lit(head + "\nQuestion:\n"), question, F.lit("\n"), code, F.lit("\nExcerpts:\n"), numbered)


def extract_answer(chunks: Column) -> Column:
    """Offline generator: the first sentence of each chunk with its number."""
    first = lambda c: F.regexp_extract(F.regexp_replace(c["content"], r"\s+", " "), r"^(.*?[.!?])(?: |$)", 1)
    said = F.transform(chunks, lambda c, i: F.when(first(c) != "", F.concat(first(c), F.lit(" ["), (i + 1).cast("string"), F.lit("]"))))
    return F.array_join(F.filter(said, lambda x: x.isNotNull()), " ")


def rewrite(question: Column, code: Column) -> Column:
    """Offline rewriter: the question with the names that the code calls; as it is without code."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))
    return F.when(F.coalesce(code, F.lit("")) != "", F.trim(F.concat_ws(" ", question, F.array_join(names, " ")))).otherwise(question)


def validate(asks: DataFrame) -> DataFrame:
    """Adds trimmed ``question`` and ``context`` and ``reject`` (null when the request is fine).

    A question has 1 to 2000 characters; a context is null or has as many. A blank
    context is rejected and not read as null.
    """
    trimmed = lambda c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    q, c = trimmed("question"), trimmed("context")
    out = lambda x: (F.length(x) < 1) | (F.length(x) > MAX_QUESTION)
    reject = F.when(F.col("question").isNull() | out(q), "question").when(F.col("context").isNotNull() & out(c), "context")
    return asks.withColumn("reject", reject).withColumn("question", q).withColumn("context", c)


def citation(source: Column, file_path: Column, file: Column) -> Column:
    """The file a chunk is cited by: the page's path, else the code file."""
    return F.coalesce(F.when(file_path != "", file_path), file)
