"""Strings and comments are not code."""

import random

import pytest

from quarry.sources import code
from quarry.sources.code import MODULE, parse_lines
from quarry.sources.scan import scan


def held(text, language):
    bare, code = scan(text, language)
    assert len(bare) == len(code) == len(text) and [x.count("\n") for x in (bare, code)] == [text.count("\n")] * 2
    return code


#: A text and the parts of it that are blanked out.
CASES = [
    ("typescript", 'a("}") // }\nb', ["}", "// }"]),
    ("typescript", "x = `a${f({b: `}`})}c` + g()", ["a", "}", "c"]),
    ("javascript", "r = /[/}\"]+\\/'/.test(y) / 2", ["[/}\"]+\\/'"]),
    ("javascript", "'it\\'s }' + \"un}closed\nf()", ["it\\'s }", "un}closed"]),
    ("rust", "/* a /* } */ } */ x<'a>('}', r#\"\"}\"#)", ["/* a /* } */ } */", "}", "\"}"]),
    ("go", "`}\n}` '}' f() /* {", ["}", "}", "}", "/* {"]),
    ("java", '"""\n } " \n""" + "\\"}" // x', [' } " ', '""', '\\"}', "// x"]),
]


@pytest.mark.parametrize("language,text,parts", CASES)
def test_blanks(language, text, parts):
    want, at = text, 0
    for part in parts:
        at = text.index(part, at)
        want = want[:at] + " " * len(part) + want[at + len(part) :]
        at += len(part)
    assert held(text, language) == want


def test_any_text_keeps_its_shape():
    rng = random.Random(8)
    bits = ['"', "'", "`", "${", "}", "{", "//", "/*", "*/", "\n", "\\", "x", " ", "r#\"", '"""', "/", "#"]
    for language in ("typescript", "javascript", "rust", "go", "java"):
        for _ in range(300):
            held("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), language)
    held("/" * 200_000 + "\n" + "`${" * 20_000, "typescript")


def spans(text, language):
    return [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in parse_lines(text, language)["symbols"]]


def test_braces_in_strings_do_not_end_a_definition():
    ts = 'import { a } from "./b}" // {\nexport function one() {\n  log("}");\n  /* } */\n  two(`}${three("{")}`);\n}\n// function no() {\nfunction last() {\n}\n'
    assert spans(ts, "typescript") == [("one", "Function", 2, 6), ("last", "Function", 8, 9)]
    out = parse_lines(ts, "typescript")
    assert [(c["caller"], c["callee"], c["line"]) for c in out["calls"]] == [("one", "log", 3), ("one", "two", 5), ("one", "three", 5)]
    assert [(i["module"], i["name"]) for i in out["imports"]] == [("./b}", "a")]
    rs = "pub fn f<'a>(x: &'a str) -> char {\n    let c = '{';\n    g(r#\"}\"#);\n    c\n}\nfn g() {}\n"
    assert spans(rs, "rust") == [("f", "Function", 1, 5), ("g", "Function", 6, 6)]
    go = "func f() {\n  s := `\n}\n`\n  g(s)\n}\nfunc g() {\n}\n"
    assert spans(go, "go") == [("f", "Function", 1, 6), ("g", "Function", 7, 8)]
    java = 'class A {\n  void f() {\n    g("{");\n  }\n  void g() {\n  }\n}\n'
    assert spans(java, "java") == [("A", "Class", 1, 7), ("f", "Method", 2, 4), ("g", "Method", 5, 6)]
    assert parse_lines("f(); // g()\n", "javascript")["calls"] == [{"caller": MODULE, "callee": "f", "line": 1}]


def test_python_in_pieces():
    """Every cut of a text gives what one parse gives; what does not parse as a whole does not in pieces."""
    text = (
        "import os\n@wrap(\n  1)\ndef f(a='''\ndef no(): pass\n'''):\n    g(\n1)\n    return x\n\nclass A(B):\n    def m(self):\n        h()\nif a:\n    k()\nelse:\n    l()\nasync def n():\n    o()\n"
        "try:\n    p()\nexcept E:\n    q()\nx = (\nasync_(1))\ny = \"\"\"\nclass No: pass\n\"\"\"\nz = 1 \\\n+ r()\n# def\n\x0cdef s(): t()\r\ndef u(): v()\r\n@d\nclass C: w()\nfrom . import q"
    )
    whole = code.parse_python(text, 10**9)
    assert [(s["name"], s["start_line"], s["signature"]) for s in whole["symbols"]][-1] == ("C", 35, "class C: w()")
    for piece in range(1, len(text) + 2):
        assert code.parse_python(text, piece) == whole
    for bad in (text + "\ndef (:", "def f(:\n" + text, "x = '''\n" + "def f(): pass\n" * 9):
        for piece in (1, 20, 10**9):
            assert code.parse_file("a.py", "python", bad) is None
            with pytest.raises(SyntaxError):
                code.parse_python(bad, piece)


def test_long_python_is_parsed_in_pieces():
    """No tree of a whole long text is built."""
    text = "def f():\n    g()\n" * 100
    trees = list(code._trees(text, 100))
    assert len(trees) > 10 and max(len(t.body) for t, _ in trees) < 10
    assert [c["line"] for c in code.parse_python(text, 100)["calls"]] == list(range(2, 201, 2))


@pytest.mark.parametrize("text, language", [("import { a } from './b'\nclass A extends B {\n  run() {\n    go();\n  }\n}\nexport const f = (x) => g(x);\nif (a) {\n}\n", "typescript"), ("use a::b;\nimpl T for S {\n  pub fn f() {\n    g();\n  }\n}\nstruct S;\n", "rust"), ('import "x/y"\nfunc (s S) F() {\n\tg()\n}\ntype S struct {\n}\n', "go"), ("import a.b;\npublic class A extends B {\n  public void f() {\n    g();\n  }\n}\n", "java"), ("import a\nclass A(B):\n    def f(self):\n        g()\n", "python")])
def test_named_relations_are_those_of_the_whole_parse(text, language):
    whole = code.parse_file("x", language, text)
    assert whole["symbols"] and whole["imports"] and whole["calls"]
    for part in code.RELATIONS:
        assert code.parse_file("x", language, text, [part])[part] == whole[part]
