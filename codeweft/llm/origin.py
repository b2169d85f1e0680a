"""Files that nobody wrote by hand in the repo: generated, minified, vendored, or data saved as code.

Each file is lexed into comments, literals and code and written again by a formatter: one statement a line, indentation by
bracket depth (by the file's own step where lines make the blocks), single blanks, none inside brackets, one around operators
that take two sides and after commas. The original layout is held against that form:
* a file whose canonical form has many times its lines was minified;
* one that is made of literals almost alone is data;
* one whose lines are the canonical ones throughout, and which says the same few statements over and over, was generated.
Perfect uniformity alone is none: people run formatters too (README has the figures).

Where the layout tells nothing, the head's comments are read, and never string literals, so that a program that writes banners
is not taken for its output: what a tool or an upstream says of itself. Last come paths: tools name their output, package
managers their folders. `evidence` tells which of the three it was. Files without indexed content are judged by path, and
those that were too large to be indexed are data.

Defined results: null and blank content counts as not indexed; a null path is hand-written; configuration and documentation are
hand-written by definition, so their layout is not judged; lock files and source maps are generated; files of every other
ending are lexed, those of unknown endings as a mixture; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Canonical lines for each line there is, from which on a file is minified.
EXPANSION = 5.0
#: Characters of code in a line on average, from which on that counts.
DENSE = 60
#: Part of a file's tokens, by characters, that are literals, from which on it is data.
LITERALS = 0.88
#: Characters of code that are always reckoned with, so that a file of one short literal is no data.
CODE_AT_LEAST = 50
#: Part of the lines that must be canonical, and part of the statements that may differ in shape, for a file to be generated.
UNIFORM, DISTINCT = 0.98, 0.03
#: What an index takes at most; a code file that is larger is data.
TOO_LARGE = 524_288

_HASH = frozenset("py pyi rb sh bash pl r yml yaml toml tf env properties cfg ini conf".split())
_SLASH = frozenset("js jsx mjs cjs ts tsx mts cts java kt kts go rs c h cc cpp cxx hpp hxx hh cs swift scala css scss less dart m mm".split())
_BOTH = frozenset(["php"])
# fixed values: endings of configuration and documentation
_OWN_WORDS = frozenset("json jsonc json5 yml yaml toml tf tfvars env properties cfg ini conf config xml plist sh bash md mdx rst txt adoc html htm csv staging production development local example sample template lock sum map".split())
_CONFIG_NAME = re.compile(r"(?i)^(?:\.|dockerfile|makefile|jenkinsfile|procfile|license|notice|readme|changelog|codeowners)")
_STRING = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*(?:"|\\?\Z)|\'(?:[^\'\\\n]|\\.)*(?:\'|\\?\Z)|`(?:[^`\\]|\\.)*(?:`|\\?\Z)'
#: A run that no name is as long as; a literal that is cut off or broken over lines is made of such.
_RUN = r"[A-Za-z0-9+/=_-]{60,}"
_NUMBER = r"(?<![\w.])[-+]?(?:0[xX][0-9A-Fa-f]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)\w*"
_LEX = {
    "hash": re.compile(rf"(?P<c>#[^\n]*)|(?P<l>{_STRING}|{_RUN}|{_NUMBER})"),
    "slash": re.compile(rf"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<l>{_STRING}|{_RUN}|{_NUMBER})"),
    "both": re.compile(rf"(?P<c>//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<l>{_STRING}|{_RUN}|{_NUMBER})"),
}

_GENERATED_WORDS = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\b|\b(?:code|file|source|automatically|was|been|is) generated (?:by|from|with)\b|\bgenerated by\b|\bdo not (?:hand-?)?(?:edit|modify|change)\b|\bdon't (?:edit|modify)\b|\bregenerate with\b|"
    r"\bchanges?\b[^\n]{0,40}\b(?:will be|are|is) (?:lost|overwritten)\b|\bmanual (?:edits?|changes?)\b[^\n]{0,24}\boverwritten\b|\bcreated automatically by\b|\b(?:was )?produced (?:by|with) [\w.-]+ from\b|\boutput of [\w.-]+\. any\b|\bmachine[- ](?:generated|written|made|produced)\b"
)
_VENDORED_WORDS = re.compile(
    r"(?i)\bvendored (?:from|copy)\b|\bupstream copy\b|\bkept verbatim\b|\bredistributed (?:unmodified|without)\b|\bsee upstream\b|\bterms of its own licen[cs]e\b|\(c\) (?:\d{4} )?the [\w.-]+ (?:contributors|authors|developers|project|team)|"
    r"\bcopyright (?:\(c\) )?(?:\d{4}(?:-\d{4})? )?the [\w.-]+ (?:contributors|authors|developers|project)|\bcopied (?:verbatim )?from upstream\b|\bthird[- ]party (?:code|copy|library)\b|\bimported from upstream\b|\bsynced from upstream\b|/\*! [\w.-]+ v?\d+\.\d+"
)
_QUOTED = re.compile(r"(?<!\w)(?:'[^'\n]{8,}'|\"[^\"\n]{8,}\"|`[^`\n]{8,}`)(?!\w)")
#: A head that begins with a package's name and release.
_RELEASE = re.compile(r"^\W*[a-z][\w]*(?:-[\w]+)* \(?(?:v|release |version )?\d+\.\d+\.\d+")
# fixed values: folders that package managers fill
_VENDOR_DIR = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|_?vendor|vendored|third[_-]?party|3rd[_-]?party|externals?|deps|godeps|_workspace|pods|carthage|site-packages|dist-packages|\.?venv|virtualenv|\.yarn|\.cargo)/")
_VENDOR_NAME = re.compile(r"(?i)^[a-z][a-z0-9]*(?:[-_][a-z0-9]+)*[-_.]v?\d+\.\d+\.\d+(?:[-.](?:min|slim|pack))?\.[a-z]{1,5}$")
_VENDOR_NAMED_DIR = re.compile(r"(?i)/[a-z][\w-]*-\d+\.\d+\.\d+/")
_GENERATED_DIR = re.compile(r"(?:^|/)(?:__generated__|generated|gen|build/generated|out/stubs|target/codegen|dist/types|obj/Debug|obj/Release|DerivedData|__snapshots__|\.next|\.nuxt)/")
# fixed values: how code generators name what they write
_GENERATED_NAME = re.compile(
    r"(?:^zz_generated[._]|^__generated__|[._-]generated\.\w+$|\.gen\.\w+$|_gen\.go$|_pb2(?:_grpc)?\.pyi?$|\.pb(?:\.gw)?\.(?:go|cc|h|swift|dart)$|_pb\.(?:js|ts|d\.ts|rb)$|_grpc\.pb\.|^moc_\w|^ui_\w+\.h$|^qrc_\w|^lex\.\w|\.yy\.c$|\.tab\.[ch]$|^parsetab[_.]|^bindings_\w+\.rs$|"
    r"OuterClass\.java$|^mock_\w+\.go$|_mock\.go$|_string\.go$|\.d\.ts$|\.Designer\.cs$|\.g\.(?:cs|dart|ts)$|\.g\.i\.cs$|^R_?\w*\.java$(?<=^R\.java)|^R_\w+\.java$|^BuildConfig\.java$|\.freezed\.dart$|\.snap$)"
)
_LOCK = re.compile(r"(?i)(?:^(?:package-lock\.json|npm-shrinkwrap\.json|go\.sum|bun\.lockb|pnpm-lock\.ya?ml|packages\.lock\.json|gradle\.lockfile|flake\.lock)$|\.lock$|\.map$)")
_MINIFIED_NAME = re.compile(r"(?i)(?:[.-]min\.(?:m?js|css)|\.bundle\.(?:m?js|css)|\.chunk\.(?:m?js|css)|\.prod\.(?:m?js|css)|\.pack\.js|\.[0-9a-f]{8,32}\.(?:m?js|css))$")


#: Recordings share an ending with TypeScript.
_CLIP = re.compile(r"(?i)(?:(?:^|/)(?:media|videos?|clips|recordings)/[^/]*|(?:^|/)(?:seg|segment|rec|clip)[-_]?\d+)\.ts$")


@dataclass
class Layout:
    expansion: float
    uniformity: float
    distinct: float
    lines: int
    literals: float
    dense: float


def _kind_of(path: str) -> str | None:
    """How a file is lexed, None for configuration and documentation."""
    name = path.rpartition("/")[2].lower()
    end = name.rpartition(".")[2] if "." in name else ""
    if end in _OWN_WORDS or _CONFIG_NAME.match(name):
        return None
    return "hash" if end in _HASH else "slash" if end in _SLASH else "both"


def lexed(text: str, kind: str) -> tuple[str, str, int]:
    """The code with literals made `0` and comments left out, the head's comments, and the characters in literals."""
    code: list[str] = []
    head: list[str] = []
    literal, at, in_head, doc = 0, 0, True, kind == "hash"
    for m in _LEX[kind].finditer(text):
        between = text[at : m.start()]
        code.append(between)
        at = m.end()
        if m.lastgroup == "c":
            if in_head and between.strip() not in ("", "<?php", "<?"):
                in_head = text.count("\n", 0, m.start()) < 8
            if in_head:
                head.append(m[0])
        else:
            token = m[0]
            literal += len(token)
            if doc and token.startswith(('"""', "'''")) and not "".join(code).strip():
                head.append(token)
                literal -= len(token)
            code.append("0")
    code.append(text[at:])
    return "".join(code), "\n".join(head), literal


_BREAK = re.compile(r"\s*([;{}])\s*")
_BLANKS = re.compile(r"[ \t]+")
_INNER = re.compile(r"(?<=[(\[]) | (?=[)\],;])")
_AFTER = re.compile(r",(?=[^\s)\]}])")
_AROUND = re.compile(r" ?(===|!==|==|!=|<=|>=|&&|\|\||[-+*/%|&^]=|=>|:=|(?<![=!<>:+\-*/%&|^~?])=(?![=>~])) ?")
_WORD = re.compile(r"[A-Za-z_$][\w$]*|\d+")


def canonical(code: str) -> list[str]:
    """One statement a line, without indentation, blanks as the formatter sets them."""
    return [spaced(x) for line in _BREAK.sub(r"\1\n", code).split("\n") if (x := line.strip())]


def spaced(line: str) -> str:
    """A line's blanks as the formatter sets them."""
    line = _AFTER.sub(", ", _INNER.sub("", _BLANKS.sub(" ", line)))
    return _AROUND.sub(r" \1 ", line).rstrip() if "=" in line or "&&" in line or "||" in line else line


def _regular(code: str, by_lines: bool) -> tuple[float, list[str]]:
    """The part of the lines that are where the formatter puts them, and all lines as it writes them."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for line in code.split("\n") if not (x := line.expandtabs(4).rstrip()).isspace() and x]
    if not rows:
        return 0.0, []
    steps = Counter(b[0] - a[0] for a, b in zip(rows, rows[1:]) if b[0] > a[0])
    unit = max(steps, key=lambda n: (steps[n], -n), default=4)
    depth, good, out = 0, 0, []
    for indent, text in rows:
        want = spaced(text)
        out.append(want)
        closers = len(text) - len(text.lstrip(")]}"))
        level = indent / unit
        good += want == text and (level == int(level) if by_lines else level == max(0, depth - closers))
        if not by_lines:
            depth = max(0, depth + sum(map(text.count, "([{")) - sum(map(text.count, ")]}")))
    return good / len(rows), out


def layout(text: str, kind: str, parts: tuple[str, str, int] | None = None) -> Layout:
    code, _, literal = parts or lexed(text, kind)
    uniformity, lines = _regular(code, kind == "hash")
    again = _BREAK.sub(r"\1\n", code)
    solid = sum(map(len, lines))
    n = max(1, len(lines))
    return Layout(
        expansion=sum(1 for x in again.split("\n") if x and not x.isspace()) / n,
        uniformity=uniformity,
        distinct=len({_WORD.sub("a", x) for x in lines}) / n,
        lines=len(lines),
        # each literal left one character in the code
        literals=literal / max(1, literal + max(CODE_AT_LEAST, len(re.sub(r"[\s,0\[\](){}:;]+", "", code)))),
        dense=solid / n,
    )


def by_layout(text: str, kind: str, parts: tuple[str, str, int]) -> str | None:
    shape = layout(text, kind, parts)
    if shape.literals >= LITERALS:
        return "data"
    if shape.expansion >= EXPANSION and shape.dense >= DENSE:
        return "minified"
    if shape.uniformity >= UNIFORM and shape.distinct <= DISTINCT:
        return "generated"
    return None


def by_words(head: str) -> str | None:
    """By what the head's comments say; what they quote is another's."""
    head = _QUOTED.sub(" ", head)
    if _GENERATED_WORDS.search(head):
        return "generated"
    return "vendored" if _VENDORED_WORDS.search(head) or _RELEASE.match(head) else None


def by_path(path: str, kind: str | None, there: bool, size: int | None) -> str | None:
    name = path.rpartition("/")[2]
    if _LOCK.search(name):
        return "generated"
    if _VENDOR_DIR.search(path):
        return "vendored"
    if kind is None:
        return None
    if _MINIFIED_NAME.search(name):
        return "minified"
    if _VENDOR_NAME.match(name) or _VENDOR_NAMED_DIR.search(path):
        return "vendored"
    if _GENERATED_NAME.search(name) or _GENERATED_DIR.search(path):
        return "generated"
    return "data" if not there and (_CLIP.search(path) or size is not None and size >= TOO_LARGE) else None


def judged(path: str | None, content: str | None, size: int | None = None) -> tuple[str, str] | None:
    """(kind, evidence): generated, minified, vendored or data, by layout, words or path; None for hand-written."""
    if not path:
        return None
    path = path.replace("\\", "/")
    kind, there = _kind_of(path), bool(content) and not content.isspace()
    if there and kind is not None:
        parts = lexed(content, kind)
        if (found := by_layout(content, kind, parts)) is not None:
            return found, "layout"
        if (found := by_words(parts[1])) is not None:
            return found, "words"
    found = by_path(path, kind, there, size)
    return None if found is None else (found, "path")


def origin(path: str | None, content: str | None, size: int | None = None) -> str | None:
    """generated, minified, vendored, data, or None for hand-written."""
    found = judged(path, content, size)
    return found and found[0]


def file_origins(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, kind, evidence) of the files not written by hand, one row each; the strongest evidence is layout, then words.

    scanned: file_id, path, size_bytes; files: file_id, path, content. Content is judged where it lies and is not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *k) for i, path, content, size in zip(*(b.column(c).to_pylist() for c in range(4))) if (k := judged(path, content, size)) is not None]
            ids, kinds, evidence = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(evidence, pa.string())], names=["file_id", "kind", "evidence"])

    there = files.where("file_id is not null and trim(content) != ''")
    rest = scanned.where("file_id is not null").join(there.select("file_id"), "file_id", "left_anti")
    rows = there.selectExpr("file_id", "path", "content", "cast(null as bigint) as size_bytes").unionByName(rest.selectExpr("file_id", "path", "cast(null as string) as content", "size_bytes"))
    found = rows.mapInArrow(run, "file_id bigint, kind string, evidence string")
    return found.groupBy("file_id").agg(F.min(F.struct("evidence", "kind")).alias("k")).select("file_id", "k.kind", "k.evidence")
