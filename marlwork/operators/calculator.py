"""Termination benefits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons that are known; retrenchment alone earns severance, misconduct no notice. Fixed values.
REASONS = ["retrenchment", "misconduct", "resignation", "retirement", "mutual_consent", "contract_expiry"]


def by_service(years: Column, steps: list[tuple[Column, float]], last: float) -> Column:
    out = None
    for below, value in steps:
        out = F.when(below, F.lit(value)) if out is None else out.when(below, F.lit(value))
    return out.otherwise(F.lit(last))


def severance(rows: DataFrame) -> DataFrame:
    """rows (wage, years, reason, leave_days, notice) with severance, notice_pay, leave_pay, total and error.

    Days for each year: none below one year, 10 below two, 15 up to five, 20 beyond; weeks of notice: 4, 6 up to five, 8.
    Amounts are rounded to cents, halves up. They are null where error says what is wrong.
    """
    wage, years, reason = F.col("wage"), F.col("years"), F.lower("reason")
    days = by_service(years, [(years < 1, 0.0), (years < 2, 10.0), (years <= 5, 15.0)], 20.0)
    weeks = by_service(years, [(years < 2, 4.0), (years <= 5, 6.0)], 8.0)
    error = F.when(wage <= 0, F.lit("wage")).when(years < 0, F.lit("years")).when(~reason.isin(REASONS), F.lit("reason"))
    ok = lambda x: F.when(error.isNull(), x)
    pay = F.when(reason == "retrenchment", days * years * wage / 30).otherwise(F.lit(0.0))
    notice = F.when(F.col("notice") & (reason != "misconduct"), weeks * wage / 4.33).otherwise(F.lit(0.0))
    leave = F.when(F.col("leave_days") > 0, F.col("leave_days") * wage / 30).otherwise(F.lit(0.0))
    named = {"severance": pay, "notice_pay": notice, "leave_pay": leave, "total": pay + notice + leave}
    return rows.select("*", *((F.floor(ok(x) * 100 + 0.5) / 100).alias(k) for k, x in named.items()), error.alias("error"))
