"""A read-only graph pattern language: MATCH of a node or one hop, WHERE of ANDed comparisons, RETURN of fields or COUNT(*), LIMIT.

A query is parsed on the driver and becomes a DataFrame plan; its literals are values of the plan, never parts of a text.
Writing keywords are refused where they stand as words outside of quotes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

DEFAULT_LIMIT = 100
#: The one kind of edge that a pattern may name.
EDGE_LABEL = "coderelation"
_WRITES = frozenset("create delete set merge remove drop alter copy detach".split())
_TOKEN = re.compile(r"""\s*(?:(?P<quoted>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<word>`[^`]+`|[A-Za-z_]\w*)|(?P<number>\d+)|(?P<sign>->|[-()\[\]{}:.,=*]))""")
NODE_FIELDS = {"id": "id", "name": "name", "label": "label", "type": "label", "filepath": "file_path", "file_path": "file_path", "startline": "start_line", "start_line": "start_line", "language": "language"}
EDGE_FIELDS = {"id": "id", "sourceid": "source_id", "source_id": "source_id", "targetid": "target_id", "target_id": "target_id", "type": "rel_type", "rel_type": "rel_type", "confidence": "confidence", "reason": "reason"}


class QueryError(ValueError):
    """The query isn't of this language."""


@dataclass
class Query:
    left: tuple[str, str | None]
    rel: tuple[str, str | None, str | None] | None = None
    right: tuple[str, str | None] | None = None
    where: list[tuple[str, str, str, str]] = field(default_factory=list)
    returns: list[tuple[str, str, str]] = field(default_factory=list)
    count_as: str | None = None
    limit: int = DEFAULT_LIMIT


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip().rstrip(";")
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if m is None:
                raise QueryError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            kind = m.lastgroup
            if kind == "word" and m[kind].lower() in _WRITES:
                raise QueryError(f"{m[kind]} is not allowed in a read-only query")
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str:
        k, v = self.peek()
        if k != kind or value is not None and v.lower() != value.lower():
            raise QueryError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def has(self, value: str) -> bool:
        k, v = self.peek()
        if k in ("word", "sign") and v.lower() == value.lower():
            self.at += 1
            return True
        return False

    def name(self) -> str:
        return self.take("word").strip("`")

    def text(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.take("quoted")[1:-1])

    def node(self) -> tuple[str, str | None]:
        self.take("sign", "(")
        out = self.name(), self.name() if self.has(":") else None
        self.take("sign", ")")
        return out

    def query(self) -> Query:
        self.take("word", "match")
        q = Query(self.node())
        if self.has("-"):
            self.take("sign", "[")
            var, label, kind = self.name(), None, None
            if self.has(":"):
                label = self.name()
            if self.has("{"):
                if self.name().lower() != "type":
                    raise QueryError("only type may be given within an edge")
                self.take("sign", ":")
                kind = self.text()
                self.take("sign", "}")
            self.take("sign", "]")
            self.take("sign", "->")
            q.rel, q.right = (var, label, kind), self.node()
        if self.has("where"):
            while True:
                var = self.name()
                self.take("sign", ".")
                prop = self.name()
                op = "contains" if self.has("contains") else "=" if self.take("sign", "=") else ""
                q.where.append((var, prop, op, self.text()))
                if not self.has("and"):
                    break
        self.take("word", "return")
        if self.has("count"):
            for s in "(*)":
                self.take("sign", s)
            q.count_as = self.name() if self.has("as") else "COUNT(*)"
        else:
            while True:
                var = self.name()
                self.take("sign", ".")
                prop = self.name()
                q.returns.append((var, prop, self.name() if self.has("as") else f"{var}.{prop}"))
                if not self.has(","):
                    break
        if self.has("limit"):
            q.limit = max(1, int(self.take("number")))
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]}")
        return q


def parse(text: str) -> Query:
    return _Parser(text).query()


def run(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The result of a query. Unknown variables and fields are null, and a null satisfies no condition. COUNT(*) has no limit."""
    q = parse(text)
    node_cols = [c for c in dict.fromkeys(NODE_FIELDS.values())]
    side = lambda mark: nodes.select(*[F.col(c).alias(f"{mark}_{c}") for c in node_cols])
    variables: dict[str, tuple[str, dict[str, str]]] = {}
    labels: list[tuple[str, str | None]] = []
    if q.rel is None:
        rows, key = side("l"), "l_id"
        variables[q.left[0]] = ("l", NODE_FIELDS)
        labels.append(("l", q.left[1]))
    else:
        edge_cols = [c for c in dict.fromkeys(EDGE_FIELDS.values())]
        e = edges.select(*[F.col(c).alias(f"e_{c}") for c in edge_cols])
        if q.rel[2] is not None:
            e = e.where(F.col("e_rel_type") == q.rel[2])
        if q.rel[1] is not None and q.rel[1].lower() != EDGE_LABEL:
            e = e.where(F.lit(False))
        rows, key = e.join(side("l"), F.col("e_source_id") == F.col("l_id")).join(side("r"), F.col("e_target_id") == F.col("r_id")), "e_id"
        variables |= {q.left[0]: ("l", NODE_FIELDS), q.rel[0]: ("e", EDGE_FIELDS), q.right[0]: ("r", NODE_FIELDS)}
        labels += [("l", q.left[1]), ("r", q.right[1])]

    def value(var: str, prop: str) -> Column | None:
        if var not in variables or prop.lower() not in variables[var][1]:
            return None
        mark, known = variables[var]
        return F.col(f"{mark}_{known[prop.lower()]}")

    for mark, label in labels:
        if label is not None:
            rows = rows.where(ascii_lower(F.col(f"{mark}_label")) == label.lower())
    for var, prop, op, want in q.where:
        c = value(var, prop)
        if c is None:
            rows = rows.where(F.lit(False))
        elif op == "=":
            rows = rows.where(c.cast("string") == want)
        else:
            rows = rows.where(F.contains(F.lower(c.cast("string")), F.lit(want.lower())))
    if q.count_as is not None:
        return rows.agg(F.count(F.lit(1)).alias(q.count_as))
    out = [(F.lit(None).cast("string") if (c := value(v, p)) is None else c).alias(alias) for v, p, alias in q.returns]
    return rows.orderBy(key).limit(q.limit).select(*out)


def markdown(df: DataFrame, most: int = DEFAULT_LIMIT) -> str:
    """A Markdown table of the first rows; empty without rows. Bars are escaped and line ends written out."""
    rows = df.limit(most).collect()
    if not rows:
        return ""
    cell = lambda v: ("" if v is None else str(v)).replace("|", "\\|").replace("\n", "\\n")
    lines = ["| " + " | ".join(map(cell, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
