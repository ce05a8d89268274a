"""A paged source that plans its own partitions: queries split under a ceiling, pages walked, what is missing told as rows.

A source answers a query a page at a time, and gives no more than `ceiling` rows of any
query.  Planning asks each query's first page for its total, cuts those that are over in
two, level by level, and deals what is left of a budget of asks over the pages that will
be needed; every query that is left is a partition, whose task walks its pages.  Nothing
partial passes for whole: each way in which rows can be missing is an outcome of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.connector import FAILED, OK, UNAVAILABLE, Unavailable

OVER_CEILING, OUT_OF_BUDGET, EMPTY_PAGE, REFUSED = "over the ceiling", "out of budget", "empty page", "refused"
MAX_DEPTH = 20


@dataclass(frozen=True)
class Answer:
    """One page: its rows, how many the query has in all, and what to ask for the next page with (None after the last)."""

    rows: Sequence[tuple]
    total: int
    more: object = None


#: (query, token) -> Answer; the token is None for the first page.
Ask = Callable[[object, object], Answer]
#: A query in two, or None where it can't usefully be divided.
Split = Callable[[object], tuple[object, object] | None]


@dataclass(frozen=True)
class Piece:
    number: int
    query: object
    total: int
    over: bool
    asks: int  # pages that the budget leaves it
    refused: str | None = None
    unavailable: bool = False


def plan(queries: Sequence[object], ask: Ask, split: Split, ceiling: int | None, page_size: int, budget: int, max_depth: int = MAX_DEPTH) -> list[Piece]:
    """The queries to walk, in order.  Queries that the budget doesn't reach are pieces without an ask."""
    asked = 0
    pieces: list[tuple] = []

    def look(query: object, depth: int) -> None:
        nonlocal asked
        if asked >= budget:
            pieces.append((query, 0, False, None, False, False))
            return
        asked += 1
        try:
            total = ask(query, None).total
        except Unavailable as e:
            pieces.append((query, 0, False, str(e), True, True))
            return
        except Exception as e:  # noqa: BLE001 - a refusal is an outcome, whatever it is
            pieces.append((query, 0, False, f"{type(e).__name__}: {e}", False, True))
            return
        over = ceiling is not None and total > ceiling
        halves = split(query) if over and depth < max_depth else None
        if halves is None:
            pieces.append((query, total, over, None, False, True))
        else:
            for half in halves:
                look(half, depth + 1)

    for query in queries:
        look(query, 0)
    left, out = budget - asked, []
    for number, (query, total, over, refused, unavailable, seen) in enumerate(pieces):
        wanted = -(-(min(total, ceiling) if over else total) // page_size) if seen and not refused else 0
        given = min(wanted, left)
        left -= given
        out.append(Piece(number, query, total, over, given if seen else -1, refused, unavailable))
    return out


def walk(piece: Piece, ask: Ask, ceiling: int | None, page_size: int) -> Iterator[tuple[tuple | None, int, str, str | None]]:
    """(row, page, outcome, detail) of a piece: its rows, and a last one without values where some are missing.

    Repeats on later pages of the piece are left to the caller, who knows what a repeat is.
    """
    if piece.refused is not None:
        yield None, 0, UNAVAILABLE if piece.unavailable else FAILED, piece.refused
        return
    if piece.asks < 0:
        yield None, 0, OUT_OF_BUDGET, "the budget of asks was spent before this query"
        return
    wanted = min(piece.total, ceiling) if piece.over else piece.total
    token, page, got, lacking = None, 0, 0, None
    while got < wanted:
        if page >= piece.asks:
            lacking = OUT_OF_BUDGET, f"{wanted - got} of {wanted} rows were not asked for"
            break
        try:
            answer = ask(piece.query, token)
        except Exception as e:  # noqa: BLE001 - what came before is kept
            lacking = REFUSED, f"page {page}: {type(e).__name__}: {e}"
            break
        if not answer.rows:
            lacking = EMPTY_PAGE, f"page {page} is empty, {got} of {wanted} rows came"
            break
        for row in answer.rows[: wanted - got]:
            yield row, page, OK, None
        got += min(len(answer.rows), wanted - got)
        page += 1
        token = answer.more
        if token is None and got < wanted:
            lacking = EMPTY_PAGE, f"no page after {page - 1}, {got} of {wanted} rows came"
            break
    if lacking:
        yield None, page, *lacking
    elif piece.over:
        yield None, page, OVER_CEILING, f"{piece.total} rows, {wanted} are given, and the query can't be divided"


class _Partition(InputPartition):
    pass


def source(name: str, schema: str, queries: Sequence[object], ask: Ask, split: Split, ceiling: int | None, page_size: int, budget: int, max_depth: int = MAX_DEPTH) -> type[DataSource]:
    """A data source with the columns of the schema, then _piece, _page, _outcome and _detail."""
    width = len(T.StructType.fromDDL(schema).fieldNames())

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Partition(p) for p in plan(queries, ask, split, ceiling, page_size, budget, max_depth)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            piece = partition.value
            for row, page, outcome, detail in walk(piece, ask, ceiling, page_size):
                yield (*(row if row is not None else [None] * width), piece.number, page, outcome, detail)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{schema}, _piece int, _page int, _outcome string, _detail string"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    return Source


def register(spark: SparkSession, name: str, schema: str, queries: Sequence[object], ask: Ask, split: Split, ceiling: int | None, page_size: int, budget: int, max_depth: int = MAX_DEPTH) -> None:
    spark.dataSource.register(source(name, schema, queries, ask, split, ceiling, page_size, budget, max_depth))


def rows_of(scan: DataFrame) -> DataFrame:
    """The rows that a scan brought."""
    return scan.where(F.col("_outcome") == OK)


def report(scan: DataFrame) -> DataFrame:
    """(outcome, row_count, truncated, lacking) of a scan, one row: what it is worth as a whole, and the first thing that it lacks.

    A scan that brought rows is good, if only in part; one that brought none and lacks some
    has failed, or was unavailable where nothing could be asked.
    """
    lack = F.min(F.when(F.col("_outcome") != OK, F.struct("_piece", "_page", "_outcome")))
    told = scan.agg(F.count_if(F.col("_outcome") == OK).alias("row_count"), lack.alias("_lack"), F.coalesce(F.bool_and(F.col("_outcome") == UNAVAILABLE), F.lit(False)).alias("_shut"))
    outcome = F.when((F.col("row_count") > 0) | F.col("_lack").isNull(), OK).when(F.col("_shut"), UNAVAILABLE).otherwise(FAILED)
    return told.select(outcome.alias("outcome"), "row_count", (F.col("_lack").isNotNull() & (outcome == OK)).alias("truncated"), F.col("_lack._outcome").alias("lacking"))
