"""Criteria in three-valued logic, built in Python and lowered to pairs of columns.

A criterion is an expression over named columns: `field("price") > 100`,
`a & b`, `~a`, `field("x").one_of(1, 2)`, `field("x").is_null()`.  Every node
lowers to its value, null for unknown, and the sorted names whose absence made it so.
There is no text language and no parser: callers write Python.  Kinds are checked
against the columns before anything runs.

A node that isn't a field or a constant is bound to columns of its own, one
projection for each level of depth, and what is above refers to these.  So the plan
grows with the number of nodes, however deep they are nested, and a criterion that
is used twice is worked out once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import BOUND

_NONE = "CAST(array() AS array<string>)"


@dataclass(frozen=True, eq=False)
class Criterion:
    """A node: how its value, as an SQL expression, follows from its parts', and whether it can be unknown."""

    make: Callable[..., str]
    parts: tuple[Criterion, ...] = ()
    name: str | None = None
    always_known: bool = False
    #: What it does with its parts, for the check of types, and the kind of a constant.
    does: str = "leaf"
    sign: str = ""
    kind: str | None = None

    def _with(self, other, make: Callable[[str, str], str], does: str, sign: str) -> Criterion:
        return Criterion(make, (self, other if isinstance(other, Criterion) else constant(other)), does=does, sign=sign)

    def __gt__(self, o) -> Criterion:
        return self._with(o, _compared(">", False), "order", ">")

    def __ge__(self, o) -> Criterion:
        return self._with(o, _compared(">=", False), "order", ">=")

    def __lt__(self, o) -> Criterion:
        return self._with(o, _compared("<", False), "order", "<")

    def __le__(self, o) -> Criterion:
        return self._with(o, _compared("<=", False), "order", "<=")

    def equals(self, o) -> Criterion:
        return self._with(o, _compared("=", False), "compare", "equals")

    def differs(self, o) -> Criterion:
        return self._with(o, _compared("<>", True), "compare", "differs")

    def __add__(self, o) -> Criterion:
        return self._with(o, _computed("(DOUBLE({a}) + DOUBLE({b}))"), "compute", "+")

    def __sub__(self, o) -> Criterion:
        return self._with(o, _computed("(DOUBLE({a}) - DOUBLE({b}))"), "compute", "-")

    def __mul__(self, o) -> Criterion:
        return self._with(o, _computed("(DOUBLE({a}) * DOUBLE({b}))"), "compute", "*")

    def __truediv__(self, o) -> Criterion:
        return self._with(o, _computed("try_divide(DOUBLE({a}), DOUBLE({b}))"), "compute", "/")

    def __neg__(self) -> Criterion:
        return Criterion(_computed("(-DOUBLE({a}))"), (self,), does="compute", sign="-")

    def __and__(self, o: Criterion) -> Criterion:
        return Criterion(lambda a, b: f"({a} AND {b})", (self, o), does="join", sign="and")

    def __or__(self, o: Criterion) -> Criterion:
        return Criterion(lambda a, b: f"({a} OR {b})", (self, o), does="join", sign="or")

    def __invert__(self) -> Criterion:
        return Criterion(lambda a: f"(NOT {a})", (self,), does="join", sign="not")

    def one_of(self, *options) -> Criterion:
        """Unknown if the value or any option is, even where another option matches."""
        nodes = tuple(o if isinstance(o, Criterion) else constant(o) for o in options)

        def make(a: str, *rest: str) -> str:
            known = " AND ".join(f"{x} IS NOT NULL" for x in (a, *rest))
            found = " OR ".join(f"{a} <=> {x}" for x in rest) or "false"
            return f"CASE WHEN {known} THEN ({found}) END"

        return Criterion(make, (self, *nodes), does="choose", sign="one of")

    def is_null(self) -> Criterion:
        return Criterion(lambda a: f"({a} IS NULL)", (self,), always_known=True, does="null", sign="is null")


def _compared(sign: str, with_nan: bool) -> Callable[[str, str], str]:
    """A comparison with NaN has a fixed answer, one with an unknown value is unknown."""
    nan = "(typeof({x}) IN ('double', 'float') AND coalesce(isnan(TRY_CAST({x} AS DOUBLE)), false))"

    def make(a: str, b: str) -> str:
        return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {nan.format(x=a)} OR {nan.format(x=b)} THEN {str(with_nan).lower()} ELSE {a} {sign} {b} END"

    return make


def _computed(form: str) -> Callable[[str, str], str]:
    """Arithmetic whose result is unknown where it is no number or beyond the bound."""

    def make(a: str, b: str = "") -> str:
        x = form.format(a=a, b=b)
        return f"CASE WHEN NOT isnan({x}) AND abs({x}) <= {BOUND!r}D THEN {x} END"

    return make


def field(name: str) -> Criterion:
    return Criterion(lambda: f"`{name.replace('`', '``')}`", name=name)


def constant(x) -> Criterion:
    if x is None:
        text = "NULL"
    elif isinstance(x, bool):
        text = str(x).lower()
    elif isinstance(x, int):
        text = f"{x}L" if abs(x) > 2**31 - 1 else str(x)
    elif isinstance(x, float):
        text = f"{x!r}D" if x == x and abs(x) != float("inf") else f"DOUBLE('{x}')"
    else:
        text = _quoted(str(x))
    kind = "anything" if x is None else "truth" if isinstance(x, bool) else "number" if isinstance(x, int | float) else "text"
    return Criterion(lambda: text, always_known=True, kind=kind)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_KINDS = {T.StringType: "text", T.BooleanType: "truth", T.NullType: "anything"}


def _kind_of(kind: T.DataType) -> str:
    """number, text, truth, anything (an untyped null), or the name of another type."""
    if isinstance(kind, T.NumericType):
        return "number"
    return _KINDS.get(type(kind), "text" if isinstance(kind, T.VarcharType | T.CharType) else kind.simpleString())


def complaints(criterion: Criterion, schema: T.StructType) -> list[str]:
    """Everything wrong with a criterion over the columns of a schema, in the order in which it is read.

    Names that aren't columns; comparisons of one kind of thing with another, and
    orderings of anything but numbers; arithmetic on what is no number; lists that are
    empty or mixed; and a criterion that isn't a question of yes or no.
    """
    columns = {f.name.lower(): f for f in schema.fields}
    found: list[str] = []
    known: dict[int, str | None] = {}

    def same(*kinds: str | None) -> bool:
        return len({k for k in kinds if k not in (None, "anything")}) < 2

    def kind(node: Criterion) -> str | None:
        if id(node) not in known:
            known[id(node)] = told(node)
        return known[id(node)]

    def told(node: Criterion) -> str | None:
        if node.name is not None:
            if node.name.lower() not in columns:
                found.append(f"there is no column {node.name!r}; there are {', '.join(sorted(f.name for f in schema.fields))}")
                return None
            return _kind_of(columns[node.name.lower()].dataType)
        if not node.parts:
            return node.kind
        kinds = [kind(p) for p in node.parts]
        if node.does == "choose":
            if len(node.parts) == 1:
                found.append("an empty list never holds anything")
            elif not same(*kinds[1:]):
                found.append("the things in a list must be of one kind")
            elif not same(*kinds):
                found.append(f"{kinds[0]} is never one of a list of {next(k for k in kinds[1:] if k not in (None, 'anything'))}")
        elif node.does in ("compare", "order") and not same(*kinds):
            found.append(f"{node.sign} compares {kinds[0]} with {kinds[1]}")
        elif node.does == "order" and not same(*kinds, "number"):
            found.append(f"{node.sign} orders numbers, not {next(k for k in kinds if k != 'number')}")
        elif node.does in ("compute", "join"):
            wanted = "number" if node.does == "compute" else "truth"
            found.extend(f"{node.sign} takes a {wanted}, not {k}" for k in kinds if not same(k, wanted))
        return "number" if node.does == "compute" else "truth"

    answer = kind(criterion)
    if not same(answer, "truth"):
        found.append(f"a criterion asks for yes or no, and this gives a {answer}")
    return found


def check(criteria: list[Criterion], schema: T.StructType) -> None:
    """One error for everything wrong with some criteria."""
    wrong = [f"{i}: {x}" if len(criteria) > 1 else x for i, c in enumerate(criteria) for x in complaints(c, schema)]
    if wrong:
        raise ValueError("; ".join(wrong))


def bind(rows: DataFrame, criteria: list[Criterion]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Rows with columns for every node that isn't a leaf, and the (value, missing names) of each criterion."""
    for c in criteria:
        wrong = [x for x in complaints(c, rows.schema) if not x.startswith("a criterion asks")]
        if wrong:
            raise ValueError("; ".join(wrong))
    depth: dict[int, int] = {}
    nodes: list[Criterion] = []

    def walk(node: Criterion) -> int:
        if id(node) not in depth:
            depth[id(node)] = 1 + max((walk(p) for p in node.parts), default=-1)
            nodes.append(node)
        return depth[id(node)]

    for c in criteria:
        walk(c)
    told: dict[int, tuple[str, str]] = {}
    for level in range(max(depth.values(), default=0) + 1):
        bound = []
        for i, node in enumerate(nodes):
            if depth[id(node)] != level:
                continue
            if not node.parts:
                value = node.make()
                told[id(node)] = value, f"CASE WHEN {value} IS NULL THEN array({_quoted(node.name)}) ELSE {_NONE} END" if node.name else _NONE
                continue
            value = node.make(*[told[id(p)][0] for p in node.parts])
            missing = ", ".join(told[id(p)][1] for p in node.parts if not p.always_known)
            merged = f"array_sort(array_distinct(concat({missing})))" if missing else _NONE
            bound.append(f"{value} AS _value{i}")
            bound.append(f"{_NONE if node.always_known else f'CASE WHEN ({value}) IS NULL THEN {merged} ELSE {_NONE} END'} AS _missing{i}")
            told[id(node)] = f"_value{i}", f"_missing{i}"
        if bound:
            rows = rows.selectExpr("*", *bound)
    return rows, [(F.expr(told[id(c)][0]), F.expr(told[id(c)][1])) for c in criteria]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    criterion: Criterion


def evaluate(rows: DataFrame, rules: list[Rule], key: str = "entity") -> DataFrame:
    """(key, rule_id, severity, verdict, missing): every rule on every row, in one pass without a join."""
    if len({r.rule_id for r in rules}) != len(rules):
        raise ValueError("rule ids must differ")
    check([r.criterion for r in rules], rows.schema)
    bound, found = bind(rows, [r.criterion for r in rules])
    told = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"),
            F.when(value.isNull(), "undetermined").when(value, "fired").otherwise("not-fired").alias("verdict"),
            F.when(value.isNull(), missing).otherwise(F.expr(_NONE)).alias("missing"),
        )
        for r, (value, missing) in zip(rules, found, strict=True)
    ]
    return bound.select(key, F.explode(F.array(*told)).alias("_v")).select(key, "_v.*")
