"""Functions paired with their documentation.

Method: signatures are detected by a regular expression over text whose comments and
strings are blanked; bodies are delimited by a stack of closing marks; a comment
belongs to a declaration by line distance: it, or a run of such comments, ends where
only white space stands before the declaration.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from marram.llm.arrow import stage

MIN_WORDS = 6

_WORD = re.compile(r"\w+")
# one token of source text: comment, string, or nothing special
_LEX = re.compile(
    r"""(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\r\n]*)|(?P<str>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))""",
    re.S,
)
_SIGNATURE = re.compile(r"(?<![\w$])(?:(?:abstract|final|public|protected|private|internal|static|inline|deprecated|scoped)\s+)*function\s+&?\s*(?P<name>[^\W\d]\w*)\s*\(", re.I)
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_MARK = re.compile(r"[()\[\]{}]")
_HEAD = re.compile(r"\s*(?:(?:->|:)[^{};]*)?\{")
_TAG = re.compile(r"\{?@\w+.*")
# fixed values: marks that stand in place of a description
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|hack|tbd|wip)\b.*|lorem ipsum.*|.*\bauto[- ]?generated\b.*|inherit(?:ed|doc|s)?\b\W*|\{?inheritdoc\}?|lint[: -]\w+.*|phpcs[: ].*|eslint.*|noinspection.*|phpstan.*|@?codeCoverage\w+.*)\W*$",
    re.I | re.S,
)
# a text that stands in brackets as a whole is a slot to be filled
_SLOT = re.compile(r"^\s*(?:\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\}|_{2,}.*_{2,})\W*$", re.S)
# fixed values: a sentence that has a word of each kind speaks of the documentation to be written, not of the function
_META = (
    frozenset("description descriptions summary documentation docs doc docblock comment text beschreibung zusammenfassung dokumentation kommentar résumé commentaire descripción resumen documentación comentario descrição описание документация комментарий 描述 说明".split()),
    frozenset("insert add write written fill filled replace complete completed provide provided supply put goes go needs need missing pending einfügen ergänzen ergänzt schreiben ausfüllen ersetzen fehlt folgt insérer ajouter écrire compléter remplir remplacer manque insertar añadir agregar escribir completar rellenar falta добавить написать заполнить заменить вставить".split()),
    frozenset("here please still yet later this your hier bitte noch später diese dieser ici veuillez encore cette votre aquí favor todavía esta este su здесь пожалуйста ещё этот этого позже".split()),
)
META_WORDS = 16
_LICENCE = re.compile(
    r"\b(?:licen[cs]ed?|copyright|all rights|spdx|\(c\) \d{4}|this (?:file|source file|source code|software) is (?:part of|subject to|provided)"
    r"|warrant(?:y|ies)|redistribut\w+|merchantability|permission is hereby|without restriction)\b|©",
    re.I,
)
# lines that only code has; names in back quotes are taken out first
_CODE_LINE = re.compile(
    r"""[{}]\s*$|->\w+|\w\s*\(.*\)\s*;?\s*$|^\s*(?:let|return|throw|unset|fetch|echo|use|namespace|var)\b.*;\s*$|^\s*(?:case\b.*|default\s*):\s*$|^\s*(?:break|continue)\s*;\s*$|^\s*[$\w>\[\]"'.-]+\s*[-+*/.]?=\s*\S.*;\s*$|^\s*[})\]]+[;,]?\s*$|\$\w+\s*="""
)
_SAMPLE = re.compile(r"<(code|pre|example)>.*?(?:</\1>|\Z)|```.*?(?:```|\Z)", re.S | re.I)
_QUOTED = re.compile(r"`[^`]*`")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")


@dataclass(frozen=True)
class Function:
    """A function found in a span of source text."""

    name: str
    start: int  # of the declaration, modifiers included
    end: int  # after the closing mark of the body
    comments: tuple[str, ...]


def blank(text: str) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with comments and strings blanked, same length, and the comments' spans."""
    out, spans, at = [], [], 0
    for m in _LEX.finditer(text):
        out.append(text[at : m.start()])
        out.append(re.sub(r"[^\r\n]", " ", m.group()))
        if m.lastgroup != "str":
            spans.append(m.span())
        at = m.end()
    out.append(text[at:])
    return "".join(out), spans


def _matches(masked: str) -> dict[int, int]:
    """Position after the closing mark of each opening mark that is closed, in one pass.

    A closing brace ends brackets left open inside its body; other stray marks are ignored.
    """
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    braces = 0
    for m in _MARK.finditer(masked):
        c = m.group()
        if c in _CLOSES:
            stack.append((_CLOSES[c], m.start()))
            braces += c == "{"
        elif stack and c == stack[-1][0] or c == "}" and braces:
            while stack[-1][0] != c:
                stack.pop()
            out[stack.pop()[1]] = m.end()
            braces -= c == "}"
    return out


def functions(text: str | None) -> list[Function]:
    """Named functions with a body, outside comments and strings, with the comments before them."""
    if not text:
        return []
    masked, comments = blank(text)
    found, at = [], 0
    ends = {b: a for a, b in comments}
    closed = _matches(masked)
    while m := _SIGNATURE.search(masked, at):
        at = m.end()
        args = closed.get(m.end() - 1)
        if args is None:
            continue
        # up to the body stand only a return type and white space
        head = _HEAD.match(masked, args)
        end = closed.get(head.end() - 1) if head else None
        if end is None:
            continue
        run, edge = [], m.start()
        while True:
            while edge > 0 and text[edge - 1].isspace():
                edge -= 1
            if edge in ends:
                run.append(text[ends[edge] : edge])
                edge = ends[edge]
            else:
                break
        found.append(Function(m["name"], m.start(), end, tuple(reversed(run))))
        at = head.end()
    return found


def comment_lines(comment: str) -> list[str]:
    """Lines of a comment without its marks."""
    if comment.startswith("//"):
        return [re.sub(r"^[/!\s]+", "", comment)]
    body = re.sub(r"^/\*+!?|\*+/$", "", comment)
    return [re.sub(r"^\s*\*+(?!\*)\s?|^\s*\*+\s*$", "", x) for x in re.split(r"\r\n|\r|\n", body)]


def _name_words(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)
    return {p.lower() for p in parts} | {name.lower()}


# fixed values: words that may stand around a name put in words
_FILLERS = frozenset("a an the this that of for to and is method function getter setter constructor gets get sets set returns return does do it its".split())


def description(comments: tuple[str, ...], name: str) -> str:
    """The real description in a run of comments; empty when there is none.

    Prose is the text without marks, samples and anything from a tag to the end of its
    line. Paragraphs that are a placeholder, a licence notice, disabled code or just
    the name in words are dropped; what is left counts if it has enough words.
    """
    paragraphs: list[list[str]] = []
    line_run = False
    for c in comments:
        is_line = c.startswith("//")
        text = "\n".join(comment_lines(c))
        text = _SAMPLE.sub("\n\n", text)
        for k, raw in enumerate(text.split("\n")):
            line = _TAG.sub("", raw)
            if not _WORD.search(line) or (line != raw and not line.strip()):
                paragraphs.append([])
                continue
            if not paragraphs or (k == 0 and not (is_line and line_run)):
                paragraphs.append([])
            paragraphs[-1].append(line)
        line_run = is_line
    kept = []
    own = _name_words(name)
    for p in paragraphs:
        code = [bool(_CODE_LINE.search(_QUOTED.sub("", x))) for x in p]
        if 2 * sum(code) >= len(p):
            continue
        # placeholders, notices and the name in words go sentence by sentence; what stands next to them stays
        joined = " ".join(x.strip() for x in p if not _PLACEHOLDER.match(x))
        if _SLOT.match(joined):
            continue
        real = []
        for sentence in _SENTENCE.split(joined):
            words = [w.lower() for w in _WORD.findall(sentence)]
            if _PLACEHOLDER.match(sentence) or _SLOT.match(sentence) or _LICENCE.search(sentence):
                continue
            if len(words) <= META_WORDS and all(not kind.isdisjoint(words) for kind in _META):
                continue
            if all(w in own or w in _FILLERS or w.rstrip("s") in own for w in words):
                continue
            real.append(sentence)
        if real:
            kept.append(" ".join(real))
    out = "\n".join(kept)
    return out if len(_WORD.findall(out)) >= MIN_WORDS else ""


def pairs(methods: DataFrame) -> DataFrame:
    """One row per function with a real description.

    ``methods`` needs ``method_no`` and ``content``; other columns are ignored. Result:
    ``method_no, fn_no, name, code, description``. A null or empty content, and one
    without a closed body, gives no row. Repeated rows give repeated pairs. Spans are
    independent, so the plan is one narrow stage without a shuffle.
    """

    def make():
        def run(cols):
            out = {k: [] for k in ("method_no", "fn_no", "name", "code", "description")}
            for no, text in zip(cols["method_no"], cols["content"]):
                for k, f in enumerate(functions(text)):
                    if f.comments and (d := description(f.comments, f.name)):
                        for key, v in zip(out, (no, k, f.name, text[f.start : f.end], d)):
                            out[key].append(v)
            return out

        return run

    return stage(methods.select("method_no", "content"), "method_no long, fn_no int, name string, code string, description string", make)
