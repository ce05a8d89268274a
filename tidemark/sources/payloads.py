"""Payloads kept whole as VARIANT: parsed once, projected by path and type, and watched for fields that drift.

A feed changes without notice: a field goes, gets another name, or a number turns to text.
Kept whole, its payloads can be read again by better fields, and `drift` and `renames` say
what the present fields miss.  All of it is one pass over the payloads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"STRING": "text", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}


@dataclass(frozen=True)
class Field:
    """A field of payloads: its name as a column, its path (`$.a.b`), the type to read it as."""

    name: str
    path: str
    type: str = "string"

    @property
    def top(self) -> str:
        """The name at the top of the payload that the path begins with."""
        return self.path.removeprefix("$.").split(".")[0].split("[")[0]

    @property
    def kind(self) -> str | None:
        """The kind of JSON value that it should be; null where any is as good."""
        plain = self.type.split("(")[0].lower()
        if plain in ("int", "bigint", "double", "float", "decimal", "smallint"):
            return "number"
        return {"boolean": "boolean", "string": "text", "date": "text", "timestamp": "text"}.get(plain)


def keep(rows: DataFrame, column: str, broken: str = "broken") -> DataFrame:
    """Rows with a text column as VARIANT.  A text that isn't JSON, or names a key twice, gives null there and stays as it is in `broken`."""
    parsed = F.try_parse_json(column)
    lost = F.when(parsed.isNull(), F.col(column))
    rest = [F.col(c) for c in rows.columns if c != column]
    return rows.select(*rest, parsed.alias(column), lost.alias(broken))


def canonical(payload: Column) -> Column:
    """JSON text with keys in order at every level and numbers in their shortest form, so that equal payloads are equal texts."""
    return F.to_json(payload)


def kind_of(value: Column) -> Column:
    """text, number, boolean, null, object or array; null of what isn't there."""
    named = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return named[F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)]


def project(rows: DataFrame, column: str, fields: Sequence[Field]) -> DataFrame:
    """Fields as columns beside all others but the payload; what is missing or can't be read as its type is null."""
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, *[F.try_variant_get(column, f.path, f.type).alias(f.name) for f in fields])


def field_state(payload: Column, field: Field) -> Column:
    """ok, retyped (of another kind, but readable), unreadable, null or missing."""
    raw = F.try_variant_get(payload, field.path, "variant")
    other = (kind_of(raw) != field.kind) if field.kind else F.lit(False)
    return (
        F.when(raw.isNull(), "missing")
        .when(F.is_variant_null(raw), "null")
        .when(F.try_variant_get(payload, field.path, field.type).isNull(), "unreadable")
        .when(other, "retyped")
        .otherwise("ok")
    )


def observed(rows: DataFrame, column: str, at: str = "$") -> DataFrame:
    """(field, kind, n): every name that objects at a path have, by the kind of its values."""
    inner = rows.select(F.try_variant_get(column, at, "variant").alias("_v"))
    each = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return each.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("field"), kind_of(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


def drift(rows: DataFrame, column: str, fields: Sequence[Field]) -> DataFrame:
    """(field, state, n): how often each field was in which state, and names at the top that no field reads, as `unexpected`.

    Payloads that are null, broken ones among them, have no fields and aren't counted.
    """
    there = rows.where(F.col(column).isNotNull())
    states = F.array(*[F.struct(F.lit(f.name).alias("field"), field_state(F.col(column), f).alias("state")) for f in fields])
    read = there.select(F.inline(states)).groupBy("field", "state").agg(F.count("*").alias("n"))
    unread = observed(there, column).where(~F.col("field").isin(*sorted({f.top for f in fields})))
    return read.unionByName(unread.groupBy("field").agg(F.sum("n").alias("n")).select("field", F.lit("unexpected").alias("state"), "n"))


def renames(rows: DataFrame, column: str, fields: Sequence[Field]) -> DataFrame:
    """(field, candidate, n, missing): names that stand where a field is missing and no field reads, of the field's kind.

    `n` payloads have the name in the field's stead, of `missing` that lack the field: the nearer the two, the likelier it was renamed.
    """
    there = rows.where(F.col(column).isNotNull())
    lacks = F.filter(F.array(*[F.when(field_state(F.col(column), f) == "missing", F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("_kind"))) for f in fields]), lambda x: x.isNotNull())
    short = there.select(F.col(column).alias("_v"), lacks.alias("_lacks")).where(F.size("_lacks") > 0)
    missing = short.select(F.inline("_lacks")).groupBy("field").agg(F.count("*").alias("missing"))
    each = short.lateralJoin(short.sparkSession.tvf.variant_explode(F.col("_v").outer())).where(F.col("key").isNotNull() & ~F.col("key").isin(*sorted({f.top for f in fields})))
    beside = each.select(F.col("key").alias("candidate"), kind_of(F.col("value")).alias("_is"), F.inline("_lacks"))
    alike = beside.where(F.col("_kind").isNull() | (F.col("_kind") == F.col("_is")))
    return alike.groupBy("field", "candidate").agg(F.count("*").alias("n")).join(missing, "field").select("field", "candidate", "n", "missing")
