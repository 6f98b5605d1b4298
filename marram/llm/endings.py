"""How a text ends: complete, or broken off.

Structure decides where it can: an open code block, a table row without its last bar,
braces left open in source text. Where a line merely has no terminal mark, the whole
collection decides: for the last two words of every such text, and for the last one,
it is counted exactly how often a sentence or a line ends after them and how often it
goes on. Verdicts compare shares only, so they do not depend on the size of the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.counts import count_table
from marram.llm.words import hash_text, mix
from marram.operators.ranking import spread
from marram.storage import write_through

#: Bits of the filter before the counting: a full one lets more words through, the counts stay exact.
FILTER_BITS = 24
#: Part of all distinct texts that must end in the same two words before these count as a usual ending.
USUAL_SHARE = 1 / 2000
#: A pair of words may own many texts: its counts are copied this often, and its texts spread over the copies.
SALTS = 16

# fixed values: marks that end a sentence, with closing quotes or brackets after them
TERMINAL = re.compile(r"[.!?…。！？][\"'»”’)\]*_]*$")
_TOKEN = re.compile(r"`[^`\n]*`|\[[^\]\n]*\]\([^)\n]*\)|[^\W\d_][\w'’-]*|\d[\d.,]*|_+|[.!?…。！？]+|[\r\n]+|[^\s\w]")
_SPACE = " \t\r\n​﻿　\xa0\x0b\x0c"
_BREAK = re.compile(r"\r\n|\r|\n")

OTHER, WORD, STOP = range(3)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0x5851F42D4C957F2D)


class Tokens:
    """Hashes and kinds of the tokens of texts; the memory is emptied when it grows too large.

    Words are taken in lower case; names in back quotes, links and numbers are one
    symbol each; a run of line breaks is one token.
    """

    def __init__(self, limit: int = 500_000) -> None:
        self._known: dict[str, tuple[int, int]] = {}
        self._limit = limit

    def _learn(self, t: str) -> tuple[int, int]:
        c = t[0]
        if c == "`" and len(t) > 1:
            v = ("`", WORD)
        elif c == "[" and len(t) > 1:
            v = ("[]", WORD)
        elif c.isdigit():
            v = ("0", WORD)
        elif c in "\r\n":
            v = ("\n", STOP)
        elif c.isalpha():
            v = (t.rstrip("-'’"), WORD)
        elif c in ".!?…。！？":
            v = (".", STOP)
        else:
            v = (t, OTHER)
        if len(self._known) > self._limit:
            self._known.clear()
        v = self._known[t] = (hash_text(v[0]), v[1])
        return v

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        got = _TOKEN.findall(text.lower())
        known = self._known
        pairs = [known.get(t) or self._learn(t) for t in got]
        if not pairs:
            return np.empty(0, np.uint64), np.empty(0, np.uint8)
        h, k = zip(*pairs)
        return np.array(h, np.uint64), np.array(k, np.uint8)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _MUL + b)


_LINE = np.uint64(hash_text("\n"))


def _contexts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (previous, token) and of single tokens."""
    before = np.concatenate([np.array([_LINE], np.uint64), h[:-1]])
    with np.errstate(over="ignore"):
        return _pair(before, h), mix(h + _SALT)


def open_braces(text: str) -> int:
    """Depth of braces left open, comments and strings apart; -1 inside an open string or comment."""
    from marram.llm.docpairs import blank

    masked, spans = blank(text)
    if spans and spans[-1][1] == len(text) and text[spans[-1][0] : spans[-1][0] + 2] == "/*" and not text.endswith("*/"):
        return -1
    depth = 0
    for c in re.findall(r"[{}]", masked):
        depth = depth + 1 if c == "{" else max(0, depth - 1)
    return depth


_SOURCE = re.compile(r"\A\s*(?:<\?php|namespace\s+[\w\\]+\s*;|/\*|//|#!)", re.I)
_CLASS = re.compile(r"^[ \t]*(?:(?:abstract|final)\s+)?(?:class|interface|trait)\s+\w+", re.I | re.M)
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_FOOTER = re.compile(
    # fixed values: line shapes that stand at the end of a complete text
    r"^(?:\*\*\*+|---+|___+|={3,}|<br\s*/?>|&copy;.*|©.*|-- ?|tags:.*|version [\d.]+|@since.*|since [\d.]+|last updated .*|next: .*|see also:?.*|sources?:.*|\[\d+\] .*|\(.*\)|edit this page|back to top"
    r"|thanks.*|cheers.*|best regards.*|greetings.*|(?:.* )?[:;]-?[)(D]|/\*.*\*/|// end of .*)$",
    re.I,
)
# fixed values: a line under which only a name stands, and a short line of its own that ends in a date
_SIGN_OFF = re.compile(r"(?:-- ?|(?:many )?thanks.*|cheers.*|(?:best|kind|warm) regards.*|greetings.*)$", re.I)
_STAMP = re.compile(r"(?:\S+\s+){0,5}\d{4}-\d\d-\d\d$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)$")


def _last_lines(t: str) -> tuple[str, str]:
    """The line before the last one and the last one, whole."""
    end = max(t.rfind("\n"), t.rfind("\r"))
    if end < 0:
        return "", t
    above = t[: end - (t[end - 1 : end + 1] == "\r\n")]
    return above[max(above.rfind("\n"), above.rfind("\r")) + 1 :], t[end + 1 :]


#: What is known of an ending: the three verdicts where structure decides, else the keys and traits to be judged by counts.
SHAPE = {
    "lenient": "string", "strict": "string", "at_limit": "string", "pair": "long", "word": "long",
    "own_form": "boolean", "bullet": "boolean", "short_item": "boolean", "heading": "boolean", "prose": "boolean", "marks": "boolean", "casual": "boolean",
}
SHAPE_DDL = ", ".join(f"{k} {v}" for k, v in SHAPE.items())
_OPEN = (None,) * (len(SHAPE) - 3)


def _decided(lenient: str | None, strict: str | None, limit: str | None) -> tuple:
    return (lenient, strict, limit, *_OPEN)


COMPLETE = _decided(None, None, None)


def prose_line(line: str) -> bool:
    """A line that reads as prose: some words, no list, heading, table, tag or footer."""
    x = line.strip(_SPACE)
    return len(x.split()) >= 5 and not _BULLET.match(x) and x[0] not in "#|<>*_`[" and not _FOOTER.match(x)


def shape(text: str, tokens: Tokens) -> tuple:
    """The :data:`SHAPE` of a text's ending; kinds are ``code``, ``table``, ``word``, ``sentence``.

    Three verdicts: for texts whose authors often leave out the terminal mark
    (lenient), for those who hardly ever do (strict), and for a length at which its
    source cuts, where a missing mark is enough (at_limit). Empty text is complete.
    """
    t = text.strip(_SPACE)
    if not t:
        return COMPLETE
    all_ = lambda kind: _decided(kind, kind, kind)
    if t[-1] == "\ufffd":  # cut inside a character
        return all_("word")
    above, last = _last_lines(t)
    last = last.strip(_SPACE)
    if len(re.findall(r"(?m)^[ \t]*```", t)) % 2:
        return all_("code")
    if last.startswith("```"):
        return COMPLETE if last.rstrip() == "```" else all_("code")
    if _SOURCE.match(t) and _CLASS.search(t):
        return all_("code") if open_braces(t) else COMPLETE
    if last.startswith("|"):
        above = above.strip()
        whole = last.endswith("|") and len(last) > 1 and (not above.startswith("|") or above.count("|") == last.count("|"))
        return COMPLETE if whole else all_("table")
    if last.count("`") % 2:
        return all_("word")
    if (m := re.match(r"<(\w+)[^>]*>.", last)) and f"</{m[1]}>" not in last:
        return all_("word")
    if _ELLIPSIS.search(last):
        return _decided(None, None, "word")
    if TERMINAL.search(last) or _FOOTER.match(last) or _SIGN_OFF.match(above.strip(_SPACE)) and len(last.split()) <= 3 or _STAMP.match(last) and not above.strip(_SPACE):
        return COMPLETE
    if last[-1] in ",;([{<=\\/&+|" or re.match(r"^#{1,6}\s*$", last) or re.search(r"\]\([^)]*$|<\w[^>]*$|\s[-–—]$|\[[^\]]*$", last):
        return all_("sentence")
    if last.count("(") > last.count(")"):
        return all_("sentence")
    if re.search(r"\]\([^()\s]+\)$", last):  # a link
        return COMPLETE
    bullet, heading, prose = bool(_BULLET.match(last)), last[0] == "#", prose_line(last)
    h, k = tokens(last)
    if not len(k) or k[-1] != WORD:
        # a closing mark after a link, a name or an aside ends a line as well as a full stop does
        if last[-1] == ":" and prose:
            return all_("sentence")
        return _decided(None, None, None if last[-1] in ")]>" and not prose else "sentence")
    if re.fullmatch(r"`[^`]+`|[\w$]+(?:(?:::|->|\.)\w+)+(?:\(\))?", t):  # nothing but a name
        return COMPLETE
    pair, word = _contexts(h)
    # a mark earlier in the same line, or a long line that begins like a written sentence, shows that its author sets marks
    marks = prose and (re.search(r"\w[\w`)\"']*[.!?]\s+\S", last) is not None or last[0].isupper() and len(last.split()) >= 7)
    return (
        None, None, None, int(pair[-1].view(np.int64)), int(word[-1].view(np.int64)),
        # a short line of its own may be a closing remark: how usual it is decides
        last[-1] in "`)" or last[-1].isdigit() or len(last.split()) <= 3 and not bullet and t != last and not above.strip(_SPACE), bullet, bullet and len(last.split()) <= 4, heading, prose, marks, not bullet and t == last and t[0].islower(),
    )


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which keys occur, by the lowest bits of a key."""

    def make():
        return lambda b: [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]

    return np.packbits(count_table(keys, 1, FILTER_BITS, make)[0] > 0, bitorder="little")


def follow_counts(texts: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``key, ends, goes``: how often a sentence or line ends after a word or pair of ``keys``, and how often it goes on.

    Every row of ``texts`` counts. The last word of a text without a mark after it
    teaches nothing, as the text may be cut there. Only counts of words that pass a
    filter of the keys leave a task, summed up for each batch.
    """
    present = texts.sparkSession.sparkContext.broadcast(_bitmap(keys))
    schema = pa.schema([("key", pa.int64()), ("ends", pa.int64()), ("goes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, bitmap, mask = Tokens(), present.value, np.uint64((1 << FILTER_BITS) - 1)
        for b in batches:
            keys_, ended = [], []
            for t in b.column(0).to_pylist():
                h, k = tok(t.strip(_SPACE)) if t else ((), ())
                if len(h) < 2:
                    continue
                at = np.flatnonzero(k[:-1] == WORD)
                pair, word = _contexts(h)
                for x in (pair[at], word[at]):
                    low = x & mask
                    hit = (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    keys_.append(x[hit])
                    ended.append(k[at + 1][hit] == STOP)
            if not keys_:
                continue
            got, where = np.unique(np.concatenate(keys_), return_inverse=True)
            ends = np.bincount(where, weights=np.concatenate(ended), minlength=len(got)).astype(np.int64)
            n = np.bincount(where, minlength=len(got))
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(ends), pa.array(n - ends)], schema=schema)

    counted = spread(texts.where(F.col(column).isNotNull()).select(F.col(column).cast("string"))).mapInArrow(run, "key long, ends long, goes long")
    return counted.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes")).join(keys, "key", "left_semi")


def resolve(shaped: DataFrame, texts: DataFrame, column: str, distinct_texts: int) -> DataFrame:
    """``shaped`` with ``lenient, strict, at_limit`` decided for every row, the other :data:`SHAPE` columns gone.

    ``shaped`` must be a written table: it has the :data:`SHAPE` columns and
    ``text_hash``. What follows the last words is counted over all of ``texts``.
    """
    open_ = shaped.where("pair is not null")
    # copies of a text count once: a cut text that is stored often is no usual ending
    pairs = open_.groupBy("pair").agg(F.min("word").alias("word"), F.count_distinct("text_hash").alias("same"))
    pairs = write_through(pairs, "endings-pairs")
    keys = pairs.select(F.explode(F.array("pair", "word")).alias("key")).distinct()
    counts = write_through(follow_counts(texts, column, keys), "endings-counts")
    of = lambda k, e, g: counts.select(F.col("key").alias(k), F.col("ends").alias(e), F.col("goes").alias(g))
    known = pairs.join(of("pair", "pe", "pm"), "pair", "left").join(of("word", "we", "wm"), "word", "left").drop("word").na.fill(0)
    known = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).withColumnRenamed("pair", "known_pair")
    left = shaped.withColumn("salt_of", F.pmod(F.xxhash64("text_hash", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    j = left.join(known, (F.col("pair") == F.col("known_pair")) & (F.col("salt_of") == F.col("salt")), "left")
    lenient, strict, limit = _verdicts(distinct_texts)
    was_open = F.col("pair").isNotNull()
    pick = lambda old, new: F.when(was_open, new).otherwise(F.col(old)).alias(old)
    kept = [c for c in shaped.columns if c not in SHAPE]
    return j.select(*kept, pick("lenient", lenient), pick("strict", strict), pick("at_limit", limit))


def _verdicts(distinct_texts: int) -> tuple[Column, Column, Column]:
    """The three verdicts of an ending that structure leaves open, from its traits and counts."""
    pe, pm, we, wm, same = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("pe", "pm", "we", "wm", "same"))
    bullet, heading, prose = F.col("bullet"), F.col("heading"), F.col("prose")
    word, sentence, none = F.lit("word"), F.lit("sentence"), F.lit(None).cast("string")
    unseen = ~F.col("own_form") & (we + wm < 1)
    # the share of texts with this ending, two standard deviations below what was counted
    least = (same - 2.0 * F.sqrt(same)) / F.lit(float(max(distinct_texts, 1)))
    usual = (least > USUAL_SHARE) & (pm * 20 <= same)
    item = F.when((we * 50 < wm) & (pe * 50 < pm), sentence)
    item_limit = F.coalesce(item, F.when(pe * 4 < pm, sentence))
    share = F.when(pe + pm >= 2, pe / (pe + pm)).otherwise(we / (we + wm + 4))
    # titles are free in form: only words that practically never end anything tell against one
    mild = F.when((share >= 0.25) | (heading & ~((we * 50 < wm) & (wm >= 100))), none).otherwise(sentence)
    hard = F.when(prose, sentence).otherwise(mild)
    casual = F.when(F.col("casual") & (share >= 0.08), none).otherwise(mild)  # one casual line
    lenient = F.when(F.col("marks"), hard).otherwise(casual)
    limit = F.when(heading, casual).when(prose | (share < 0.5), sentence)
    case = lambda a, b, c: F.when(unseen, word).when(usual, a).when(F.col("short_item"), b).otherwise(c)
    return case(none, item, lenient), case(none, item, hard), case(F.when(prose & (least < 10 * USUAL_SHARE), sentence), item_limit, limit)
