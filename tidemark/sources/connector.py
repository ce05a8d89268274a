"""Sources of one's own as Spark data sources: pages are partitions, filters are asked of the source, failures are rows.

    register(spark, "shop", "id long, price double", pages=["a", "b"], fetch=fetch, pushes=("price",))
    spark.read.format("shop").load()
    asked(spark, "shop", (">", "price", 6.0))

`fetch(page, filters)` runs in a task and yields tuples; `filters` are the (operator,
column, value) triples asked for of the columns in `pushes`, which it may use to ask for
less.  Spark filters again whatever it gives.  A page that fails gives one row of nulls
with its outcome, so that one bad page, or one bad source, never fails the read.

Filters belong to a read by `asked`, and Spark's own pushing of them is not used: Spark
keeps what it once pushed with a loaded source, so that later uses of the same DataFrame
would silently lack the rows that an earlier filter left out.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, list[tuple[str, str, object]]], Iterable[tuple]]

_SIGNS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
OK, FAILED, UNAVAILABLE = "ok", "failed", "unavailable"


class Unavailable(Exception):
    """Raised by `fetch` where a source can't be asked at all, which isn't a failure of it."""


class _Page(InputPartition):
    pass


def source(name: str, schema: str, pages: Sequence[str], fetch: Fetch, pushes: Sequence[str] = ()) -> type[DataSource]:
    """A data source of the given pages; its columns are those of the schema, then _page, _outcome and _detail."""
    fields = T.StructType.fromDDL(schema).fieldNames()

    class Reader(DataSourceReader):
        def __init__(self, filters: list[tuple[str, str, object]]) -> None:
            self.filters = filters

        def partitions(self):
            return [_Page(p) for p in pages]

        def read(self, partition):
            page = partition.value
            try:
                for row in fetch(page, self.filters):
                    yield (*row, page, OK, None)
            except Unavailable as e:
                yield (*[None] * len(fields), page, UNAVAILABLE, str(e))
            except Exception as e:  # noqa: BLE001 - one source's failure is a row, whatever it is
                yield (*[None] * len(fields), page, FAILED, f"{type(e).__name__}: {e}")

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"{schema}, _page string, _outcome string, _detail string"

        def reader(self, schema):
            return Reader([tuple(f) for f in json.loads(self.options.get("asks", "[]")) if f[1] in pushes])

    return Source


def register(spark: SparkSession, name: str, schema: str, pages: Sequence[str], fetch: Fetch, pushes: Sequence[str] = ()) -> None:
    spark.dataSource.register(source(name, schema, pages, fetch, pushes))


def asked(spark: SparkSession, name: str, *filters: tuple[str, str, object]) -> DataFrame:
    """A scan of the rows that meet every (operator, column, value); rows that tell of a failure stay.

    Operators are =, >, >=, < and <=, values numbers, texts or booleans.  A null meets
    none.
    """
    wrong = [f for f in filters if f[0] not in _SIGNS or not isinstance(f[2], int | float | str)]
    if wrong:
        raise ValueError(f"filters that can't be asked: {wrong}")
    scan = spark.read.format(name).option("asks", json.dumps(filters)).load()
    met = functools.reduce(operator.and_, [_SIGNS[sign](F.col(column), value) for sign, column, value in filters], F.lit(True))
    return scan.where((F.col("_outcome") != OK) | met)


def outcomes(scan: DataFrame) -> DataFrame:
    """(page, outcome, rows) of a scan; rows that came before a page failed don't make it a good one."""
    bad = F.max_by("_outcome", (F.col("_outcome") != OK).cast("int"))
    return scan.groupBy(F.col("_page").alias("page")).agg(bad.alias("outcome"), F.count_if(F.col("_outcome") == OK).alias("rows"))
