"""Columns that score companies and positioning; a null input makes the score null, but for flags, which count as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags(*tests: Column) -> Column:
    """How many of the tests hold."""
    total = F.lit(0)
    for t in tests:
        total = total + F.coalesce(t.cast("int"), F.lit(0))
    return total


def f_score(now: str, before: str) -> Column:
    """Nine signs of strength from two structs of net_income, cash_flow, assets, debt, current_ratio, shares, gross_margin, turnover."""
    a, b = (lambda x: F.col(f"{now}.{x}")), (lambda x: F.col(f"{before}.{x}"))
    roa = lambda s: F.try_divide(s("net_income"), s("assets"))
    return flags(
        a("net_income") > 0, a("cash_flow") > 0, roa(a) > roa(b), a("cash_flow") > a("net_income"),
        F.try_divide(a("debt"), a("assets")) < F.try_divide(b("debt"), b("assets")), a("current_ratio") > b("current_ratio"), a("shares") <= b("shares"),
        a("gross_margin") > b("gross_margin"), a("turnover") > b("turnover"),
    )


def m_score(dsri: Column, gmi: Column, aqi: Column, sgi: Column, depi: Column, sgai: Column, tata: Column, lvgi: Column) -> Column:
    """Eight ratios in the published weights; null if any is."""
    return -4.84 + 0.92 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi


def z_score(working: Column, retained: Column, ebit: Column, equity: Column, sales: Column, assets: Column, debt: Column) -> Column:
    over = lambda x: F.try_divide(x, assets)
    return 1.2 * over(working) + 1.4 * over(retained) + 3.3 * over(ebit) + 0.6 * F.try_divide(equity, debt) + over(sales)


def z_zone(z: Column) -> Column:
    return F.when(z > 2.99, "safe").when(z < 1.81, "distress").when(z.isNotNull(), "grey")


def crowding(long: Column, short: Column) -> Column:
    """By the whole per cent that are long: from 75 on, and up to 25."""
    share = F.floor(F.try_divide(long, long + short) * 100 + 0.5)
    return F.when(share >= 75, "crowded long").when(share <= 25, "crowded short").when(share.isNotNull(), "balanced")


def kelly(p: Column, ratio: Column, fraction: float = 1.0) -> Column:
    """p - (1 - p) / ratio in [0, 1], times the fraction."""
    return fraction * F.greatest(F.lit(0.0), F.least(F.lit(1.0), p - F.try_divide(1 - p, ratio)))


# Scores of two years' accounts; a missing amount counts as 0, missing total assets as 1 ------------


def _amount(year: str):
    return lambda name: F.coalesce(F.col(f"{year}.{name}").cast("double"), F.lit(0.0))


def _assets(year: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"{year}.assets").cast("double"), F.lit(0.0)), F.lit(1.0))


def strength(now: str, before: str) -> Column:
    """Nine signs of strength (0 to 9) of two structs of net_income, cash_flow, assets, debt, current_assets, current_liabilities, shares, gross_profit and revenue.

    Debt and ratios that stay as they are count as good, and up to 2 % more shares as none."""
    a, b, ta, tb = _amount(now), _amount(before), _assets(now), _assets(before)
    least = lambda x: F.greatest(x, F.lit(1.0))
    return flags(
        a("net_income") / ta > 0, a("cash_flow") > 0, a("net_income") / ta > b("net_income") / tb, a("cash_flow") / ta > a("net_income") / ta, a("debt") / ta <= b("debt") / tb,
        a("current_assets") / least(a("current_liabilities")) >= b("current_assets") / least(b("current_liabilities")), (b("shares") == 0) | (a("shares") <= b("shares") * 1.02),
        a("gross_profit") / least(a("revenue")) >= b("gross_profit") / least(b("revenue")), a("revenue") / ta >= b("revenue") / tb,
    )


def strength_label(score: Column) -> Column:
    return F.when(score >= 8, "high-quality").when(score >= 6, "above-average").when(score >= 4, "average").when(score >= 2, "weak").when(score.isNotNull(), "distressed")


def manipulation(now: str, before: str) -> Column:
    """The eight ratios of two structs of revenue, receivables, gross_profit, assets, current_assets, plant, depreciation, overhead, debt, current_liabilities, cash_flow and net_income, in the published weights.

    Null if a ratio has no denominator."""
    a, b, ta, tb = _amount(now), _amount(before), _assets(now), _assets(before)
    ratio = lambda x, y: F.try_divide(x, F.nullif(y, F.lit(0.0)))
    least = lambda x: F.greatest(x, F.lit(1.0))
    over = lambda f, name: f(name) / least(f("revenue"))
    soft = lambda f, t: 1 - (f("current_assets") + f("plant")) / t
    worn = lambda f: F.when(F.abs(f("depreciation")) > 0, F.abs(f("depreciation")) / least(F.abs(f("depreciation")) + f("plant")))
    owed = lambda f, t: (f("debt") + f("current_liabilities")) / t
    cost = lambda f: F.abs(f("overhead")) / least(f("revenue"))
    growth = F.when(b("revenue") > 0, a("revenue") / b("revenue"))
    return m_score(ratio(over(a, "receivables"), over(b, "receivables")), ratio(over(b, "gross_profit"), over(a, "gross_profit")), ratio(soft(a, ta), soft(b, tb)), growth, ratio(worn(b), worn(a)), ratio(cost(a), cost(b)), (a("net_income") - a("cash_flow")) / ta, ratio(owed(a, ta), owed(b, tb)))
