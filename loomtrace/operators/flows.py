"""Evaluating flows against history: guards, dependency values, field-by-field comparison, replay."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace import constants as C

_GUARD = re.compile(r"\s*([A-Za-z_][\w.]*)\s*(>=|<=|==|!=|>|<)\s*(.+?)\s*")
# Inverse comparison operators.
INVERSE = {">": "<=", ">=": "<", "<": ">=", "<=": ">", "==": "!=", "!=": "=="}


def literal(text: str):
    """A guard's literal as int, float, bool or string."""
    bare = text.strip().strip("'\"")
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False}.get(bare.lower(), bare)


def guard(expression: str, values: Column) -> Column:
    """A ``field op literal`` guard over a map of strings; anything missing or not comparable is false.

    The expression is parsed here and never becomes SQL text.
    """
    found = _GUARD.fullmatch(expression or "")
    if not found:
        return F.lit(False)
    field, op, text = found.groups()
    have = F.coalesce(F.try_element_at(values, F.lit(field)), F.try_element_at(values, F.lit(field.split(".")[-1])))
    wanted = literal(text)
    number = have.try_cast("double")
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        ordered = {">": number > wanted, ">=": number >= wanted, "<": number < wanted, "<=": number <= wanted, "==": number == wanted, "!=": number.isNull() | (number != wanted)}
    else:
        shown = str(wanted).lower() if isinstance(wanted, bool) else wanted
        ordered = {">": have > shown, ">=": have >= shown, "<": have < shown, "<=": have <= shown, "==": have == shown, "!=": have != shown}
    return F.when(have.isNull(), F.lit(False)).otherwise(F.coalesce(ordered[op], F.lit(False)))


def inverted(expression: str) -> str:
    """The guard that holds exactly when this one does not (for present, comparable fields)."""
    field, op, text = _GUARD.fullmatch(expression).groups()
    return f"{field} {INVERSE[op]} {text}"


def values_match(a: Column, b: Column, numeric: bool) -> Column:
    """Numbers within the tolerance; strings without case and blanks around; null only equals null."""
    if numeric:
        same = F.abs(a - b) <= C.NUMERIC_TOLERANCE * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    else:
        same = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def compare(rows: DataFrame, fields: dict[str, tuple[Column, Column, bool]]) -> DataFrame:
    """``rows`` with score, critical_mismatch, compared and diff_fields over known fields (predicted, observed, numeric).

    One boolean column a field, evaluated once; ``replay.compare`` is the one for fields that only the data names.
    """
    flags = {f"same_{name}": F.coalesce(values_match(*pair), F.lit(False)) for name, pair in fields.items()}
    judged = rows.withColumns(flags)
    weight = {name: C.CRITICAL_WEIGHT if name in C.CRITICAL_FIELDS else 1 for name in fields}
    hit = sum((F.when(F.col(f"same_{n}"), w).otherwise(0) for n, w in weight.items()), F.lit(0))
    wrong = [F.when(~F.col(f"same_{n}"), F.lit(n)) for n in sorted(fields)]
    critical = [~F.col(f"same_{n}") for n in fields if n in C.CRITICAL_FIELDS]
    mismatch = critical[0] if critical else F.lit(False)
    for other in critical[1:]:
        mismatch = mismatch | other
    return judged.withColumns({"score": F.round(hit / sum(weight.values()), 4), "critical_mismatch": mismatch, "compared": F.lit(len(fields)).cast("long"), "diff_fields": F.concat_ws(",", *wrong)}).drop(*flags)


def replay_summary(outcomes: DataFrame, by: str, times: str | None = None) -> DataFrame:
    """Backtest totals of (by, status, correct): guard holds count as correct, the incomparable don't count.

    A row stands for as many runs as the column ``times`` says; for one without it.
    """
    n = F.col(times) if times else F.lit(1)

    def runs(which: Column) -> Column:
        return F.sum(F.when(which, n).otherwise(0))

    sums = outcomes.groupBy(by).agg(
        F.sum(n).alias("total"),
        runs((F.col("status") == "held") | ((F.col("status") == "ok") & F.col("correct"))).alias("correct"),
        runs(F.col("status") == "failed").alias("errored"),
        runs(F.col("status") == "not_comparable").alias("not_comparable"),
    )
    rest = F.col("total") - F.col("not_comparable")
    return sums.withColumn("accuracy", F.when(rest > 0, F.floor(F.col("correct") / rest * 10_000) / 10_000).otherwise(0.0))
