"""Declarative checks of columns and tables, fused into one aggregate per table.

A check is what a row must satisfy (null: it says nothing, and passes), or a measure of the whole table. All checks of a
table are counted in one scan; failing rows are fetched only where a check fails, and only when asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import rounded

#: Aggregates in one pass at most, as very wide ones are no longer compiled.
WIDTH = 100


@dataclass(frozen=True)
class Check:
    """One check. ok: a row's verdict, counted where it is false; or measure: an aggregate that must pass ``bounds``."""

    name: str
    category: str
    columns: tuple[str, ...] = ()
    ok: Column | None = None
    measure: Column | None = None
    bounds: tuple[float | None, float | None] = (0, 0)
    where: Column | None = None
    severity: str = "error"
    #: Share of the rows with a value that must be fine; None: all of them.
    mostly: float | None = None
    #: Failing rows where a row alone can't tell, such as duplicates.
    failing: Callable[[DataFrame], DataFrame] | None = None
    #: Counted in a pass of its own: distinct values of several columns in one aggregate would multiply every row.
    alone: bool = False

    def warn(self) -> Check:
        return replace(self, severity="warn")

    def given(self, where: Column) -> Check:
        return replace(self, where=where)

    def tolerating(self, mostly: float) -> Check:
        return replace(self, mostly=mostly)


# Generic checks


def not_null(column: str) -> Check:
    return Check(f"not_null_{column}", "Completeness", (column,), ok=F.col(column).isNotNull())


def accepted(column: str, values: list, kind: str = "accepted_values") -> Check:
    """Null passes. Values are compared as texts, so that a set may mix types."""
    texts = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    return Check(f"{kind}_{column}", "Validity", (column,), ok=F.col(column).cast("string").isin(texts))


def in_set(column: str, values: list) -> Check:
    return accepted(column, values, "in_set")


def length_is(column: str, length: int) -> Check:
    return Check(f"length_{column}", "Format", (column,), ok=F.length(F.col(column)) == length)


def length_between(column: str, low: int, high: int) -> Check:
    return Check(f"length_between_{column}", "Format", (column,), ok=F.length(F.col(column)).between(low, high))


def matches(column: str, pattern: str) -> Check:
    return Check(f"matches_{column}", "Format", (column,), ok=F.col(column).rlike(pattern))


def between(column: str, low, high) -> Check:
    """Both ends included; None leaves an end open."""
    c = F.col(column)
    parts = [c >= F.lit(low)] * (low is not None) + [c <= F.lit(high)] * (high is not None)
    return Check(f"between_{column}", "Range", (column,), ok=reduce(lambda a, b: a & b, parts, F.lit(True)))


def expression(name: str, ok: Column) -> Check:
    """A row-level rule; null counts as a failure, as a row must satisfy it."""
    return Check(name, "Expression", (), ok=F.coalesce(ok, F.lit(False)))


def unique(column: str) -> Check:
    return replace(unique_together([column]), name=f"unique_{column}", columns=(column,))


def unique_together(columns: list[str]) -> Check:
    """Values that occur more than once; rows with a null in a key are left out."""
    key = F.struct(*columns)
    given = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    excess = F.count(F.when(given, F.lit(1))) - F.count_distinct(F.when(given, key))

    def failing(df: DataFrame) -> DataFrame:
        return df.filter(given).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)

    return Check(f"unique_combination_{'_'.join(columns)}", "Uniqueness", tuple(columns), measure=excess, failing=failing, alone=True)


def duplicate_excess(column: str) -> Check:
    """Rows less distinct values: null keys count as excess too."""
    def failing(df: DataFrame) -> DataFrame:
        return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)

    return Check(f"duplicate_excess_{column}", "Uniqueness", (column,), measure=F.count(F.lit(1)) - F.count_distinct(column), failing=failing, alone=True)


def unique_share(column: str, low: float, high: float = 1.0) -> Check:
    return Check(f"unique_share_{column}", "Uniqueness", (column,), measure=F.try_divide(F.count_distinct(column).cast("double"), F.count(column).cast("double")), bounds=(low, high), alone=True)


def row_count_between(low: int | None, high: int | None) -> Check:
    return Check("row_count_between", "Volume", (), measure=F.count(F.lit(1)), bounds=(low, high))


def share_at_most(name: str, hit: Column, most: float) -> Check:
    """A share of all rows; an empty table has none and passes."""
    share = F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))
    return Check(name, "Business Rule", (), measure=share, bounds=(None, most))


def measure_between(name: str, measure: Column, low: float | None, high: float | None) -> Check:
    return Check(name, "Expression", (), measure=measure, bounds=(low, high))


def column_exists(df: DataFrame, column: str) -> Check:
    found = column.upper() in (c.upper() for c in df.columns)
    return Check(f"exists_{column}", "Schema", (column,), measure=F.count(F.lit(1)) * 0 + (0 if found else 1))


def has_type(df: DataFrame, column: str, kind: str) -> Check:
    """Declared types by family: a timestamp is one with or without a zone; varchar is any text."""
    own = dict(df.dtypes).get(column, "")
    families = {"varchar": ("string", "varchar", "char"), "text": ("string", "varchar", "char")}
    good = own.startswith(families.get(kind.lower(), (kind.lower(),)))
    return Check(f"type_{column}", "Schema", (column,), measure=F.count(F.lit(1)) * 0 + (0 if good else 1))


# Runner


def _counted(check: Check) -> tuple[Column, Column]:
    """(observed, base) of a check: failing rows and rows with a value, or its measure and the rows."""
    if check.ok is None:
        return check.measure.cast("double"), F.count(F.lit(1)).cast("double")
    given = check.where if check.where is not None else F.lit(True)
    value = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in check.columns), F.lit(True)) if check.category != "Completeness" else F.lit(True)
    return F.count_if(given & ~check.ok).cast("double"), F.count_if(given & value).cast("double")


def _verdict(check: Check, observed: Column, base: Column) -> Column:
    if check.ok is not None:
        allowed = (1 - check.mostly) * base + 1e-9 if check.mostly is not None else F.lit(0.0)
        good = observed <= allowed
    else:
        low, high = check.bounds
        parts = [observed >= low] * (low is not None) + [observed <= high] * (high is not None)
        good = reduce(lambda a, b: a & b, parts, F.lit(True))
    return F.when(F.coalesce(good, F.lit(True)), "PASS").otherwise("WARN" if check.severity == "warn" else "FAIL")


RESULTS = "table_name string, check_name string, category string, severity string, observed double, base_rows bigint, status string, error string"


def _pass(df: DataFrame, checks: list[Check], table: str) -> list[tuple]:
    """Results of some checks, from one aggregate. If it fails, halves are run, down to the checks that fail: what the
    analyser refuses and what breaks on a row is that check's result and nobody else's."""
    try:
        wide = df.agg(*(x.alias(f"{kind}{i}") for i, c in enumerate(checks) for kind, x in zip("ob", _counted(c))))
        rows = F.array(
            *(
                F.struct(
                    F.lit(table).alias("table_name"),
                    F.lit(c.name).alias("check_name"),
                    F.lit(c.category).alias("category"),
                    F.lit(c.severity).alias("severity"),
                    F.col(f"o{i}").alias("observed"),
                    F.col(f"b{i}").cast("bigint").alias("base_rows"),
                    _verdict(c, F.col(f"o{i}"), F.col(f"b{i}")).alias("status"),
                    F.lit(None).cast("string").alias("error"),
                )
                for i, c in enumerate(checks)
            )
        )
        return [tuple(r) for r in wide.select(F.inline(rows)).collect()]  # a row per check
    except Exception as error:  # noqa: BLE001  whatever it is, it is the result of the check that raised it
        if len(checks) == 1:
            c = checks[0]
            return [(table, c.name, c.category, c.severity, None, None, "ERROR", str(error).strip().split("\n")[0][:200])]
        half = len(checks) // 2
        return _pass(df, checks[:half], table) + _pass(df, checks[half:], table)


def run(df: DataFrame, checks: list[Check], table: str = "") -> DataFrame:
    """table_name, check_name, category, severity, observed, base_rows, status, error: a row per check, from one scan for
    all checks but those of distinct values, which have a scan each.

    The checks are run at once. One that can't be resolved, or that fails on some row, becomes an ERROR row and doesn't
    disturb the others. A measure that is null, as of an empty table, passes."""
    fused = [c for c in checks if not c.alone]
    passes = [fused[at : at + WIDTH] for at in range(0, len(fused), WIDTH)] + [[c] for c in checks if c.alone]
    found = {id(c): r for some in passes for c, r in zip(some, _pass(df, some, table))}
    return df.sparkSession.createDataFrame([found[id(c)] for c in checks], RESULTS)


def failing_rows(df: DataFrame, check: Check) -> DataFrame:
    """The rows that fail a check, as they are; none for a measure of the table."""
    if check.failing is not None:
        return check.failing(df)
    if check.ok is None:
        return df.limit(0)
    given = check.where if check.where is not None else F.lit(True)
    return df.filter(given & ~check.ok)


def captured(df: DataFrame, checks: list[Check]) -> DataFrame:
    """check_name and row (JSON) of every failing row of all row-level checks, from one scan."""
    rows = [c for c in checks if c.ok is not None]
    hit = F.array(*(F.when((c.where if c.where is not None else F.lit(True)) & ~c.ok, F.lit(c.name)) for c in rows))
    return df.select(F.explode(F.array_compact(hit)).alias("check_name"), F.to_json(F.struct(*df.columns)).alias("row"))


def summary(results: DataFrame) -> DataFrame:
    """Totals, and the share that passed in per cent, to one place; warnings are no failures, errors are."""
    total, passed = F.count(F.lit(1)), F.count_if(F.col("status") == "PASS")
    return results.agg(
        total.alias("n_checks"),
        passed.alias("n_pass"),
        F.count_if(F.col("status") == "WARN").alias("n_warn"),
        F.count_if(F.col("status").isin("FAIL", "ERROR")).alias("n_fail"),
        rounded(passed * 100.0 / F.greatest(total, F.lit(1)), 1).alias("pass_pct"),
    )
