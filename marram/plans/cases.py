"""Small pages and source files, one for each rule of the chunkers, and the rows that the rules ask for.

The expected rows are written out by hand from the rules; SQL gives them as they stand.
"""

from __future__ import annotations

#: Words a chunk may have in these cases.
WORDS = 40

_F = "`" * 3


def _w(n: int, word: str = "w") -> str:
    return " ".join([word] * n)


PAGES = {
    "headings": "intro\n# A\nx\n## B\n### C\ny\n## B\nz",
    "api": '# T\npre\n<h4 id="a"><code>run()</code></h4>\nx\n<h4 id="b"><code>stop(a)</code></h4>\ny',
    "events": "## List of Events\n\nIntro text.\n\n| Component | Event | Parameters |\n|---|---|---|\n| [C1](u) | e1 | p |\n| C2 | e2 | p |\n| [C1](u) | e3 | p |\ntail",
    "sig": f"# S\n\npre text\n\n{_F}php\npublic function a(int x)\n// {_w(25)}\n{_F}\n\n{_F}php\nfinal public static function b()\n// {_w(25)}\n{_F}",
    "parts": f"# P\n\n{_w(30)}\n\n{_w(20, 'v')}",
    "fence": f"# F\n\n{_w(10)}\n\n{_F}php\na\n\nb\n{_F}\n{_w(35, 'v')}",
    "examples": f"## Examples\n\n{_F}php\n// SELECT a\n$builder->x({_w(18)});\n\n// SELECT b\n$builder->y({_w(18)});\n{_F}",
    "items": "# L\n<ApiList>\n" + "\n".join(f"<ApiItem n{i}>{_w(12)}</ApiItem>" for i in (1, 2, 3, 4)) + "\n</ApiList>",
    "table": f"# T\n\n{_w(35)}\n\n| a | b |\n|---|---|\n" + "\n".join(f"| {_w(8, f'v{i}')} | x |" for i in (1, 2, 3, 4, 5, 6)),
    "list": f"# S\n\n{_F}php\npublic function a(int x)\n// {_w(20)}\npublic function b()\n// {_w(20)}\n{_F}",
    "notes": "# M\n" + "\n".join(f"@method {_w(15, f'v{i}')}" for i in (1, 2, 3)),
    "skipped": "# Only\n\n## Method Summary\ntext\n\n## Pictures\n![i](u)\n\n---\n\n## Kept\ntext",
    "empty": "",
}

_HEAD = "| Component | Event | Parameters |\n|---|---|---|\n"
# id, content, section, method, event_component
CHUNKS = [
    ("headings::root", "intro", None, None, None),
    ("headings::a", "# A\nx", "A", None, None),
    ("headings::a::b::c", "### C\ny", "C", None, None),
    ("headings::a::b-2", "## B\nz", "B", None, None),
    ("api::t", "# T\npre", "T", None, None),
    ("api::t::run", '<h4 id="a"><code>run()</code></h4>\nx', "run()", "run()", None),
    ("api::t::stop-a", '<h4 id="b"><code>stop(a)</code></h4>\ny', "stop(a)", "stop(a)", None),
    ("events::list-of-events", "## List of Events\n\nIntro text.", "List of Events", None, None),
    ("events::list-of-events::c1", _HEAD + "| [C1](u) | e1 | p |\n| [C1](u) | e3 | p |", "C1", None, "C1"),
    ("events::list-of-events::c2", _HEAD + "| C2 | e2 | p |", "C2", None, "C2"),
    ("sig::s", "# S\n\npre text", "S", None, None),
    ("sig::s::a", f"{_F}php\npublic function a(int x)\n// {_w(25)}\n{_F}", "a", "a", None),
    ("sig::s::b", f"{_F}php\nfinal public static function b()\n// {_w(25)}\n{_F}", "b", "b", None),
    ("parts::p::part-1", f"# P\n\n{_w(30)}", "P", None, None),
    ("parts::p::part-2", _w(20, "v"), "P", None, None),
    ("fence::f::part-1", f"# F\n\n{_w(10)}\n\n{_F}php\na\n\nb\n{_F}", "F", None, None),
    ("fence::f::part-2", _w(35, "v"), "F", None, None),
    ("examples::examples::part-1::examples-1", f"### Examples\n\n{_F}php\n// SELECT a\n$builder->x({_w(18)});\n{_F}", "Examples", None, None),
    ("examples::examples::part-1::examples-2", f"### Examples\n\n{_F}php\n// SELECT b\n$builder->y({_w(18)});\n{_F}", "Examples", None, None),
    *(
        (f"items::l::part-1::api-items-{k}", "# L\n<ApiList>\n\n" + "\n\n".join(f"<ApiItem n{i}>{_w(12)}</ApiItem>" for i in two) + "\n\n</ApiList>", "L", None, None)
        for k, two in ((1, (1, 2)), (2, (3, 4)))
    ),
    ("table::t::part-1", f"# T\n\n{_w(35)}", "T", None, None),
    *(
        (f"table::t::part-2::table-{k}", "| a | b |\n|---|---|\n" + "\n".join(f"| {_w(8, f'v{i}')} | x |" for i in two), "T", None, None)
        for k, two in ((1, (1, 2)), (2, (3, 4)), (3, (5, 6)))
    ),
    ("list::s::a::part-1::method-signatures-1", f"{_F}php\npublic function a(int x)\n// {_w(20)}\n{_F}", "a", "a", None),
    ("list::s::a::part-1::method-signatures-2", f"{_F}php\npublic function b()\n// {_w(20)}\n{_F}", "a", "a", None),
    ("notes::m::part-1::method-annotations-1", f"@method {_w(15, 'v1')}\n@method {_w(15, 'v2')}", "M", None, None),
    ("notes::m::part-1::method-annotations-2", f"@method {_w(15, 'v3')}", "M", None, None),
    ("skipped::only::kept", "## Kept\ntext", "Kept", None, None),
]



def _tree(lines: int) -> str:
    return "<ApiTree>" + "\n".join(["x"] * lines) + "</ApiTree>"


#: Pages as they are stored, and what cleaning leaves of them.
RAW = {
    "tree-1": f"a{_tree(1)}b",
    "tree-20": f"a{_tree(20)}b",
    "tree-21": f"a{_tree(21)}b",
    "tree-400": f"a\n{_tree(400)}\nb{_tree(2)}",
    "uses": "a\n<ApiUses>\nx\n</ApiUses>\n\n\nb<ApiUsedBy>y</ApiUsedBy>c",
    "links": "a\n[x]: http://y z\n[y]: u\nb [z]: v",
    "lines": "a\n\n\n\nb\n\nc",
    "front": "---\ntitle: T\n---\n\n# H\n",
    "open": "---\ntitle: T\n# H\n",
    "inside": "---\ntitle: a---b\n---\nc",
}
CLEANED = [
    ("tree-1", f"a{_tree(1)}b"),
    ("tree-20", f"a{_tree(20)}b"),
    ("tree-21", "ab"),
    ("tree-400", f"a\n\nb{_tree(2)}"),
    ("uses", "a\n\nbc"),
    ("links", "a\n\nb [z]: v"),
    ("lines", "a\n\nb\n\nc"),
    ("front", "# H\n"),
    ("open", "---\ntitle: T\n# H\n"),
    ("inside", "b\n---\nc"),
]

SOURCES = {
    "masks.zep": 'class A\n{\n    /* function hidden() { } */\n    // function gone() { }\n    public function one(string a = "}") -> string\n    {\n        return "{ // no comment";\n    }\n    private static function two()\n    {\n        if x { y(); } /* } */\n    }\n}\n',
    "abstract.zep": "abstract public function first();\npublic function second()\n{\n    return 1;\n}\n",
    "open.zep": "function never() {\n    if a {\n",
    "case.zep": "PUBLIC FUNCTION Loud(a) { }",
    "none.zep": "// nothing here",
}

# id, start_line, end_line, content
METHODS = [
    ("masks.zep::one", 5, 8, 'public function one(string a = "}") -> string\n    {\n        return "{ // no comment";\n    }'),
    ("masks.zep::two", 9, 12, "private static function two()\n    {\n        if x { y(); } /* } */\n    }"),
    ("abstract.zep::first", 1, 5, "public function first();\npublic function second()\n{\n    return 1;\n}"),
    ("case.zep::Loud", 1, 1, "PUBLIC FUNCTION Loud(a) { }"),
]


def values(rows: list[tuple], columns: str) -> str:
    """The rows as SQL."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    typed = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in (x.split() for x in columns.split(", ")))
    names = ", ".join(x.split()[0] for x in columns.split(", "))
    return f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"
