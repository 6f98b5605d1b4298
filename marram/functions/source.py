"""Source text: masking comments, matching braces, cutting ranges."""

from __future__ import annotations

import re
from bisect import bisect_right

_LEX = re.compile(r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))""", re.S)
_BRACES = re.compile(r"""(?P<string>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))|(?P<mark>[{};])""", re.S)
# fixed value: a named function up to the brace that opens its body
_FUNCTION = re.compile(
    r"\b(?:(?:public|protected|private)\s+)?(?:static\s+)?function\s+(?P<name>[a-zA-Z_\x80-\xff][a-zA-Z0-9_\x80-\xff]*)\s*\(.*?\)(?:\s*->\s*[^{]+)?\s*\{",
    re.S | re.I,
)


def mask_comments(text: str) -> str:
    """Comments as spaces; strings, line breaks and the length stay."""
    return _LEX.sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if m.lastgroup == "comment" else m.group(), text)


def _marks(masked: str, start: int = 0):
    """Positions of braces and semicolons outside strings."""
    for m in _BRACES.finditer(masked, start):
        if m.lastgroup == "mark":
            yield m.start(), m.group()


def closing_brace(masked: str, at: int) -> int:
    """Position of the brace that closes the one at ``at``; an error when there is none."""
    depth = 0
    if masked[at : at + 1] != "{":
        raise ValueError("no brace at the position")
    for i, c in _marks(masked, at):
        depth += (c == "{") - (c == "}")
        if c == "}" and depth == 0:
            return i
    raise ValueError("the brace is never closed")


def methods(text: str):
    """``name, start, end, start_line, end_line`` of functions with a body.

    A declaration without a body runs on to the next body and takes the method in
    between with it, under its own name. A body that is never closed is skipped.
    """
    masked = mask_comments(text)
    for m in _FUNCTION.finditer(masked):
        try:
            end = closing_brace(masked, m.end() - 1)
        except ValueError:
            continue
        yield m["name"], m.start(), end + 1, masked.count("\n", 0, m.start()) + 1, masked.count("\n", 0, end) + 1


def cut_points(text: str) -> list[tuple[int, int]]:
    """``position, depth`` behind closing braces and semicolons inside the outermost body."""
    out, depth = [], 0
    for i, c in _marks(mask_comments(text)):
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth >= 1:
                out.append((i + 1, depth))
        elif depth >= 1:
            out.append((i + 1, depth))
    return out


def hard_ranges(start: int, end: int, size: int) -> list[tuple[int, int]]:
    return [(s, min(s + size, end)) for s in range(start, end, size)]


def _segments(start: int, end: int, points: list[int], size: int) -> list[tuple[int, int]]:
    """Ranges that end at the last point within reach; the rest is one range when none is."""
    out = []
    while end - start > size:
        k = bisect_right(points, start + size) - 1
        if k < 0 or points[k] <= start:
            break
        out.append((start, points[k]))
        start = points[k]
    return [*out, (start, end)]


def structural_ranges(text: str, size: int) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` characters that cover the text, cut at the shallowest depth that helps."""
    points = cut_points(text)
    by_depth: dict[int, list[int]] = {}
    for p, d in points:
        by_depth.setdefault(d, []).append(p)
    depths = sorted(by_depth)
    inside = lambda d, s, e: [p for p in by_depth.get(d, ()) if s < p < e]
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 1)]
    while todo:
        s, e, depth = todo.pop()
        if e - s <= size:
            out.append((s, e))
            continue
        here = inside(depth, s, e)
        deeper = any(inside(d, s, e) for d in depths if d > depth)
        if not here:
            if deeper:
                todo.append((s, e, depth + 1))
            else:
                out.extend(hard_ranges(s, e, size))
            continue
        # the parts are taken up in order, so they go onto the stack backwards
        for a, b in reversed(_segments(s, e, here, size)):
            below = b - a > size and any(inside(d, a, b) for d in depths if d > depth)
            todo.append((a, b, depth + 1 if below else 10**9))
    return out


def merge_small(ranges: list[tuple[int, int]], least: int, size: int) -> list[tuple[int, int]]:
    """Small ranges join the one before, else the one after, while the result stays within ``size``."""
    if len(ranges) <= 1:
        return ranges
    out: list[tuple[int, int]] = []
    rest = iter(range(len(ranges)))
    for i in rest:
        s, e = ranges[i]
        if e - s < least and out and e - out[-1][0] <= size:
            out[-1] = (out[-1][0], e)
        elif e - s < least and i + 1 < len(ranges) and ranges[i + 1][1] - s <= size:
            out.append((s, ranges[i + 1][1]))
            next(rest)
        else:
            out.append((s, e))
    return out
