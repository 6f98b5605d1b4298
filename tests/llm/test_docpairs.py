from marram.llm import docpairs as D


def described(text):
    return [(f.name, D.description(f.comments, f.name)) for f in D.functions(text) if D.description(f.comments, f.name)]


BODY = "public function openWindow(int a = \"{\") -> array | null\n{\n    return \"}\"; // }\n}\n"
PROSE = "Opens the window and keeps it open until the caller lets go."


def test_comment_styles():
    for c in (f"/** {PROSE} */\n", f"/**\n * {PROSE}\n */\n\n", f"// {PROSE}\n", "// Opens the window and keeps it\n// open until the caller lets go.\n", f"/*\r\n   {PROSE}\r\n*/\r\n", f"// lint:off\n/** {PROSE} */\n// phpcs:ignore\n"):
        assert described(c + BODY) == [("openWindow", PROSE)], c


def test_no_description():
    for c in (
        "", "/** */", "// ****", "/** @param int a the number of windows that are open now */", "// TODO: describe the arguments of this function later on",
        "/** Auto-generated method stub, replace this text with a description. */", "/** Lorem ipsum placeholder text, description still to be written. */",
        "/* This file is part of the X package. For the full licence terms see the file COPYING. All rights are kept by the project authors. */",
        "// let a = this->b(c, 1);\n// return a;\n// unset x;", "/** openWindow() */", "/** Method that opens the window: open window, openWindow */", f"/** {PROSE} */\npublic a = 1;\n", "/** Inherited. */",
        "/** {@inheritdoc} */", "/** {@link Foo} opens the window and keeps it open */",
    ):
        assert described(c + "\n" + BODY) == [], c


def test_slots_and_remarks_on_the_documentation():
    for c in (
        "[insert a summary of what this method does]", "<write here what the function is good for>", "Method description goes here, please fill in before the release.", "Please add a description of the arguments here.", "This summary still needs to be written by somebody.",
        "Hier bitte noch eine Beschreibung der Methode einfügen.", "Ajouter ici une description de cette méthode, s'il vous plaît.", "Aquí falta añadir la descripción de este método.", "Здесь нужно добавить описание этого метода позже.",
    ):
        assert described(f"/** {c} */\n" + BODY) == [], c
    for c in ("Adds a description to the page and writes it to the log.", "Returns the summary of the window that is open now.", "Fills the text of the comment with what the caller gave."):
        assert described(f"/** {c} */\n" + BODY) == [("openWindow", c)], c


def test_description_next_to_other_things():
    licence = "/* This file is part of the X package. All rights are kept by the project authors. */\n"
    assert described(licence + f"/** {PROSE} */\n" + BODY) == [("openWindow", PROSE)]
    assert described(f"/**\n * @return int\n *\n * {PROSE}\n * <code>\n * public function sample() {{ return 1; }}\n * </code>\n */\n" + BODY) == [("openWindow", PROSE)]
    assert described(f"/**\n * {PROSE}\n * TODO add docs\n */\n" + BODY) == [("openWindow", PROSE)]
    wrapped = "Asks the reader for every window;\n * returns null when there is none."
    assert described(f"/** {wrapped} */\n" + BODY)[0][1] == "Asks the reader for every window; returns null when there is none."


def test_own_name_and_where():
    text = f"/** {PROSE} */\npublic function a();\n/** {PROSE} */\nFUNCTION b() {{ this->c(function (x) {{ return 1; }}); }}\n"
    assert [n for n, _ in described(text)] == ["b"]
    assert described(f"/* {PROSE} function z() {{ }} */\n" + 'let x = "function q() { }";') == []
    assert described(f"// {PROSE}\nfunction f() {{ if x {{ }}") == []
    two = f"/** {PROSE} */ function a() {{ }} /** {PROSE} */ static function b(array x = []) -> <X> {{ }}"
    assert [n for n, _ in described(two)] == ["a", "b"]


def test_words_in_any_language():
    assert described("/** Открывает окно и держит его открытым для всех. */\n" + BODY)
    assert not described("/** Открывает окно и держит. */\n" + BODY)


def test_frame(spark):
    rows = [(1, "// " + PROSE + "\n" + BODY, "clash"), (2, None, None), (3, "", "x"), (None, "// " + PROSE + "\n" + BODY, "x"), (1, "// " + PROSE + "\n" + BODY, "clash"), (4, "{" * 20000 + "/*" * 20000, "long")]
    df = spark.createDataFrame(rows, "method_no long, content string, name string")
    got = D.pairs(df).collect()
    assert sorted((r["method_no"] or 0, r["name"]) for r in got) == [(0, "openWindow"), (1, "openWindow"), (1, "openWindow")]
    assert got[0]["code"].startswith("public function") and got[0]["code"].endswith("}")
    assert D.pairs(df.limit(0)).collect() == []
