import pytest

from codeweft.llm.origin import canonical, file_origins, judged, layout, lexed, origin, spaced

HAND = "import { a } from './b';\n\n// keep the order\nexport function f(x) {\n  if (!x) {\n    return null;\n  }\n  return a(x, 3);\n}\n" * 3
MIN = "".join(f"function f{i}(a,b){{return a<b?c{i}(a):d(b)}}var x{i}=f{i}(1,2);" for i in range(60))
DATA = "static const int t[] = {\n" + "0x1f, 0x2e, 0x3d, 0x4c, 0x5b, 0x6a,\n" * 40 + "};\n"


@pytest.mark.parametrize(
    "path,content,size,kind",
    [
        ("r/src/a.js", HAND, 1, None),
        ("r/src/a.js", MIN, 1, "minified"),
        ("r/src/a.js", 'x = "' + "Ab3+" * 500, 1, "data"),
        ("r/src/a.c", DATA, 1, "data"),
        ("r/src/a.js", "// Code generated by foo. DO NOT EDIT.\n" + HAND, 1, "generated"),
        ("r/src/a.js", "const banner = 'Code generated by foo. DO NOT EDIT.';\n" + HAND, 1, None),
        ("r/src/a.js", "// vendored from upstream foo at 12ab, do not patch here\n" + HAND, 1, "vendored"),
        ("r/src/a.js", "// Copyright r team, Apache License 2.0\n" + HAND, 1, None),
        ("r/src/a.js", "// somelib-js release 1.2.3\n" + HAND, 1, "vendored"),
        ("r\\node_modules\\x\\a.js", HAND, 1, "vendored"),
        ("r/src/vendors/a.js", HAND, 1, None),
        ("r/static/somelib-1.2.3.js", HAND, 1, "vendored"),
        ("r/src/a_pb2.py", "x = 1", 1, "generated"),
        ("r/yarn.lock", None, 1, "generated"),
        ("r/app.js.map", None, 1, "generated"),
        ("r/settings.json", '{"a": "b"}' * 100, 1, None),
        ("r/README.md", None, 1, None),
        ("r/media/clip.ts", None, 20_000_000, "data"),
        ("r/public/clips/seg-19.ts", None, 0, "data"),
        ("r/src/a.ts", None, 4_000, None),
        ("r/src/a.ts", "   ", None, None),
        (None, HAND, 1, None),
    ],
)
def test_kinds(path, content, size, kind):
    assert origin(path, content, size) == kind


def test_lexing():
    code, head, literal = lexed("# top\n'''doc'''\nx = 'a#b' # c\n", "hash")
    assert head == "# top\n'''doc'''\n# c"
    assert "a#b" not in code and literal == 5
    assert canonical("if(a){b;c}\n") == ["if(a){", "b;", "c}"]
    assert layout(HAND, "slash").expansion < 2 and layout(MIN, "slash").expansion > 5 and layout("", "slash").expansion == 0


def test_formatter():
    assert spaced("f( a,b )  ;") == "f(a, b);" and spaced("x=1") == "x = 1" and spaced("a  ==b&&c") == "a == b && c" and spaced("x => y<=z") == "x => y <= z"
    assert layout(HAND, "slash").uniformity == 1 and layout(HAND.replace("  if", "   if"), "slash").uniformity < 1
    assert layout("def f():\n    return 1\n", "hash").uniformity == 1 and layout("def f( ):\n    return 1\n", "hash").uniformity == 0.5
    assert layout("a {\n\tb;\n\tc {\n\t\td;\n\t}\n}\n", "slash").uniformity == 1


def test_layout_alone_decides():
    uniform = "".join(f"func get{i}(a int) int {{\n\treturn table[a] + {i}\n}}\n\n" for i in range(300))
    assert judged("r/src/a.go", uniform) == ("generated", "layout")
    assert judged("r/src/a.js", MIN) == ("minified", "layout") and judged("r/src/a.c", DATA) == ("data", "layout")
    assert judged("r/src/a.unknown", MIN) == ("minified", "layout") and judged("r/.eslintrc", MIN) is None
    assert judged("r/src/a.js", "// Code generated by foo. DO NOT EDIT.\n" + HAND) == ("generated", "words")
    assert judged("r/src/a_pb2.py", "x = 1") == ("generated", "path")


@pytest.mark.parametrize("functions", [300, 9_998, 9_999, 10_500])
def test_the_step_of_long_files(functions):
    # the commonest step counts however many there are: one line that is set otherwise changes no verdict
    even = "".join(f"func get{i}(a int) int {{\n\treturn table[a] + {i}\n}}\n\n" for i in range(functions))
    assert judged("r/src/a.go", even + "func last(a int) int {\n  return a\n}\n") == ("generated", "layout")
    uneven = "".join(f"def f{i}(a):\n{' ' * (6 if i % 5 == 4 else 4)}return a\n" for i in range(functions))
    assert judged("r/src/a.py", uneven + "def last(a):\n return a\n") is None
    assert layout("a {\n  b;\n}\nc {\n    d;\n}\n" * functions, "slash").uniformity == pytest.approx(5 / 6)


def test_a_banner_that_is_only_spoken_of():
    assert judged("r/src/a.js", "// strips the line 'Code generated by foo. DO NOT EDIT.' from its input\n" + HAND) is None
    assert judged("r/src/a.js", None, 524_288) == judged("r/src/a.ts", None, 524_288) == ("data", "path")


def test_frames(spark):
    scanned = spark.createDataFrame([(1, "r/a.js", 9, "x"), (1, "r/a.js", 9, "y"), (2, "r/go.sum", None, "x"), (3, "r/v.ts", 9_000_000, "x"), (4, None, 1, "x"), (None, "r/go.sum", 1, "x"), (5, "r/b.js", 3, "x")], "file_id bigint, path string, size_bytes bigint, content string")
    files = spark.createDataFrame([(1, "r/a.js", MIN, 1), (1, "r/a.js", MIN, 1), (5, "r/b.js", "", 1), (3, "r/v.ts", None, 1)], "file_id bigint, path string, content string, size_bytes int")
    assert sorted(map(tuple, file_origins(scanned, files).collect())) == [(1, "minified", "layout"), (2, "generated", "path"), (3, "data", "path")]
    assert file_origins(scanned.limit(0), files.limit(0)).count() == 0
