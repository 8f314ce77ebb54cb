from cairn.llm import authorship, pairs
from cairn.llm.descriptions import describes
from cairn.llm.layout import measured

GOOD = ["Blocks until the last frame has been acknowledged or the context expires.", "/** 遍历所有尚未提交的 stream,并把过期的 queue 标记为可回收,最后返回剩余数量。 */", "TODO(later): cover idle input. Until then only partial quota reach the lexeme, everything else bounces."]
BAD = [None, "", "merge record", "// Merges a record.", "TODO: document this", "nolint:errcheck", "@param x the x\n@returns y", "Copyright 2019 the X authors. All rights reserved.", "return a.b(3);", "~~~~~~", "n/a", "mergeRecord() function.", "Args:\n    x: the x"]


def test_descriptions():
    for text in GOOD:
        assert describes(text, "mergeRecord", "func mergeRecord(x int) error"), text
    for text in BAD:
        assert not describes(text, "mergeRecord", "func mergeRecord(x int) error"), text
    assert describes(GOOD[0], None, None)


SYMBOL = "id long, kind string, name string, signature string, doc_comment string, body_snippet string, file_path string, code string"


def test_pairs(spark):
    prose = GOOD[0]
    rows = [
        (1, "func", "f", "func f()", prose, "func f() {\n\tg(\"}\")\n}\n\nfunc other() {}", "a.go", ""),
        (2, "method", "f", "f()", " ", f"// {prose}\n// more of it\nfunc f() {{}}", "a.go", ""),
        (3, "func", "f", "def f()", None, f"@deco\ndef f(a,\n      b):\n    '''{prose}'''\n    return 1", "a.py", ""),
        (4, "func", "f", "def f()", None, f"def f(a):\n    x = {{}}\n    if (a):\n        '''{prose}'''\n", "a.py", ""),
        (5, "func", "f", "f()", "TODO", f"// {prose}\nfunc f() {{}}", "a.go", ""),
        (6, "struct", "S", "S", prose, "type S struct {}", "a.go", ""),
        (7, "func", "f", "f()", prose, "  \n", "a.go", ""),
        (8, "func", None, None, prose, "fn f<'a>() {", "a.rs", ""),
        (9, "func", "f", "f()", None, "# noqa\ndef f():\n    \"\"\"" + prose + "\"\"\"", "a.py", ""),
        (10, "func", "f", "f()", prose, "x" * 100_000, None, ""),
    ]
    symbols = spark.createDataFrame(rows + rows[:2], SYMBOL)
    out = {r.symbol_id: r for r in pairs.pairs(symbols).collect()}
    assert set(out) == {1, 2, 3, 8, 9, 10}
    assert out[1].code == "func f() {\n\tg(\"}\")\n}" and out[2].code == "func f() {}" and out[2].description.startswith(prose)
    assert pairs.pairs(symbols.limit(0)).count() == 0


HAND = 'package a\n\nimport "fmt"\n\nfunc F(x int) int {\n\tif x > 3 {\n\t\treturn x\n\t}\n\treturn 2\n}\n\nfunc G(s string) {\n\tfmt.Println(s)\n\tfor {\n\t}\n}\n'
LIBRARY = "// Copyright 2019 Bolil contributors\n// Released under the MIT licence\n\npackage bolil\n\n" + HAND[11:].replace("Println(s)", "Println(s, s, s, s, s, s, s, s, s, s, s, s, s, s, s, s, s, s)").replace("return 2", "return x * 2 + 41 - x / 3 + x * 12 + 77")

ONE = "func Q(a int) int {\n" + "".join(f"\ta = a * {i} + 7\n" for i in range(9)) + "\treturn a\n}\n"


def test_layout():
    figures = measured(HAND, ".go")
    assert figures["canonical"] <= 1.5 * figures["lines"] and not figures["machine"] and figures["holder"] is None
    small = measured("var a={};" + "if(o){m=o.b;y+=5}else z(1);" * 40, ".js")
    assert small["canonical"] > 50 and small["lines"] == 1
    assert measured("// Code generated by x v1. DO NOT EDIT.\n" + HAND, ".go")["machine"]
    assert not measured("// Ids here are generated by the server.\n" + HAND, ".go")["machine"]
    assert not measured(HAND + "\nfunc T() string {\n\treturn `\n// Code generated by x. DO NOT EDIT.\n`\n}\n", ".go")["machine"]
    data = measured("package a\n\nvar t = []int{\n" + "\t12, 345, 6789,\n" * 60 + "}\n", ".go")
    assert data["literal_chars"] > 0.78 * data["chars"]
    assert measured("", ".py")["lines"] == 0


def test_emission_against_the_layout():
    """The file's own lines are its canonical ones with their indent; packed on few lines, hardly any is left."""
    plain = "function f(a) {\n  if (a) {\n    b ( ) ;\n    c ( ) ;\n  }\n}\n"
    figures = measured(plain, ".js")
    assert figures["kept"] == figures["indented"] == figures["canonical"] > 4
    flat = measured(plain.replace("    ", "  "), ".js")
    assert flat["kept"] == figures["kept"] and flat["indented"] < flat["kept"]
    packed = measured(plain.replace("\n", " ") * 30, ".js")
    assert packed["kept"] == 0 and packed["canonical"] == 30 * figures["canonical"]


def test_long_units_that_differ_late_are_not_uniform():
    unit = "func F{0}(x int) int {{\n" + "\tx = x + 1\n" * 300 + "\t{1}\n}}\n\n"
    same = measured("package a\n\n" + "".join(unit.format(i, "return x") for i in range(6)), ".go")
    other = measured("package a\n\n" + "".join(unit.format(i, "return x" + " * 2" * i) for i in range(6)), ".go")
    assert (same["units"], same["same_shape"]) == (6, 6) and (other["units"], other["same_shape"]) == (6, 1)


def test_judged_files(spark):
    texts = {
        (1, "src/a.go"): HAND,
        (1, "vendor/b.go"): HAND.replace("F(", "H("),
        (1, "lib/c.go"): LIBRARY,
        (2, "own/d.go"): LIBRARY.split("\n\n", 1)[1],  # its head stripped
        (3, "own/e.go"): LIBRARY.replace("Bolil", "Mine").replace("F(", "K(").replace("G(", "L("),
        (4, "one/unit.go"): "package q\n\n" + ONE,
        (5, "lib/unit.go"): "// Copyright 2019 Bolil contributors\n// Released under the MIT licence\n\npackage q\n\n" + ONE,
        (2, "x.js"): "var a={};" + "if(o){m=o.b;y+=5}else z(1);" * 40,
    }
    chunks = spark.createDataFrame([(i, c, p, 1, t.count("\n") + 1, t) for i, ((c, p), t) in enumerate(texts.items())], "id long, codebase_id long, file_path string, start_line long, end_line long, snippet string")
    known = chunks.select("codebase_id", "file_path")
    codebases = spark.createDataFrame([(1, "one"), (2, None), (3, "mine-core")], "id long, name string")
    found = {(r.codebase_id, r.file_path) for r in authorship.not_hand_written(chunks, known, codebases).collect()}
    assert found == {(1, "lib/c.go"), (2, "own/d.go"), (2, "x.js"), (4, "one/unit.go"), (5, "lib/unit.go")}
    assert authorship.not_hand_written(chunks.limit(0), known, codebases).count() == 0
