"""Entry permits: the candidates of a moment, best first, under caps that those before them use up.

What doesn't depend on other candidates (vetoes of the account, of news, of stops and edges; the size before caps) is a column of each candidate. The rest is one fold over the array of a
moment's candidates in SQL functions: it carries the positions that were permitted, at most as many as there are slots, beside sums of those open before; then each candidate is judged by what those
ahead of it added. So the work of a moment is linear in its candidates. Moments are independent, so the work spreads over them.

Checks in order, the first that fails is the reason: flat signal; daily loss; drawdown at the breaker; news; a full sleeve, or a full bucket of those without sleeve; all slots; stop; edge;
a ramp, scalar or regime of 0; the book's open risk; least size. Sizes are cut by: risk of a trade, the book's risk left, volatility target, gross exposure left, exposure left of positions that
are correlated with the candidate, size of a position. A cap that cut is named in caps.

Candidates (at, id, score, instrument, side, sleeve, bucket, price, stop, rate, ann_vol, p, payoff, news, regime, tail, corr: map of instruments to correlations) are taken by falling score, then by id.
Accounts (at, equity, drawdown, daily_loss, scalar, positions: array of instrument, sleeve, bucket, notional, risk). Defined results: a null score comes last; null side is flat; null sleeve is none, null bucket is swing; a null
news, rate, regime, tail or scalar is as if false or 1; an instrument that corr doesn't name is not correlated, the candidate's own is by 1; null or non-positive price, stop distance, volatility or edge has its
reason; a candidate whose moment has no account gets the reason no_account. Repeated rows are candidates of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    kelly: float = 0.0
    risk_of_trade: float = 0.01
    book_risk: float = 0.035
    vol_target: float = 0.10
    gross: float = 3.0
    correlated: float = 1.5
    correlation: float = 0.60
    breaker: float = 0.20
    reducing: float = 0.10
    daily_loss: float = 0.0
    slots: int = 10
    least: float = 0.0
    position: float = 0.0
    tail: tuple[float, float] = (1.0, 2.0)
    buckets: dict[str, int] = field(default_factory=lambda: {"swing": 10, "intraday": 8, "scalp": 6})
    other_bucket: int = 4
    sleeves: dict[str, int] = field(default_factory=lambda: {"trend": 10, "tom": 5, "crypto_xs": 4})


POSITION = "array<struct<instrument:string,sleeve:string,bucket:string,notional:double,risk:double>>"


def _first(*reasons: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in reasons])


def sized(candidates: DataFrame, limits: Limits) -> DataFrame:
    """Candidates joined with their accounts, with early and late reasons, and the risk and sizes that they ask for before the running caps."""
    x = F.col
    equity = x("equity")
    stop = F.abs(x("stop")) * x("rate")
    # Half of Kelly and the like; without it every candidate asks for the risk of a trade.
    kelly = limits.kelly * (x("p") - (1 - x("p")) / x("payoff")) if limits.kelly > 0 else F.lit(limits.risk_of_trade)
    ramp = F.when(x("drawdown") >= limits.reducing, (limits.breaker - x("drawdown")) / (limits.breaker - limits.reducing)).otherwise(1.0)
    filled = candidates.withColumns({"rate": F.coalesce("rate", F.lit(1.0)), "tail": F.least(F.lit(limits.tail[1]), F.greatest(F.lit(limits.tail[0]), F.coalesce("tail", F.lit(1.0)))), "scalar": F.coalesce("scalar", F.lit(1.0)), "regime": F.coalesce("regime", F.lit(1.0)), "sleeve": F.coalesce("sleeve", F.lit("")), "bucket": F.coalesce("bucket", F.lit("swing"))})
    asked = filled.withColumns({"_kelly": kelly, "_ramp": ramp, "_stop": stop, "_price": x("price") * x("rate")})
    risk = F.least(x("_kelly"), F.lit(limits.risk_of_trade)) * x("_ramp") * x("scalar") * x("regime")
    early = _first(
        (equity.isNull(), "no_account"),
        (F.coalesce(x("side"), F.lit(0)) == 0, "flat_signal"),
        ((x("daily_loss") >= limits.daily_loss) if limits.daily_loss > 0 else F.lit(False), "daily_loss_stop"),
        (x("drawdown") >= limits.breaker, "drawdown_breaker"),
        (F.coalesce("news", F.lit(False)), "news_veto"),
    )
    late = _first(
        (~F.coalesce((x("_stop") > 0) & (x("_price") > 0), F.lit(False)), "invalid_stop"),
        (~F.coalesce(x("_kelly") > 0, F.lit(False)), "no_edge"),
        (x("_ramp") <= 0, "drawdown_reducing_zero"),
        (x("scalar") <= 0, "vol_scalar_zero"),
        (x("regime") <= 0, "regime_zero"),
    )
    at_vol = F.try_divide(equity * limits.vol_target, x("ann_vol") * x("tail"))
    return asked.withColumns({"early": early, "late": late, "risk": risk, "at_vol": F.coalesce(F.when(x("ann_vol") > 0, at_vol), F.lit(0.0)), "over": x("_kelly") > limits.risk_of_trade})


def _bound(value: Column, name: str, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(F.struct(value.alias(name))), lambda s: then(s[name])), F.lit(0))


_SUMS = "array<struct<k:string,v:double>>"
_ADDED = "array<struct<instrument:string,sleeve:string,bucket:string,notional:double,risk:double,k:int>>"


def _add(parts: Column, start: Column | None = None) -> Column:
    return F.aggregate(parts, F.lit(0.0) if start is None else start, lambda s, v: s + v)


def _base(positions: Column) -> Column:
    """What the fold has to know of the positions that were open before: their number, counts, and sums, whose size is that of their different names."""

    def by(name: str, kept: Column, of) -> Column:
        return F.transform(F.array_distinct(F.transform(kept, lambda h: h[name])), lambda k: F.struct(k.alias("k"), of(F.filter(kept, lambda h: h[name].eqNullSafe(k))).cast("double").alias("v"))).cast(_SUMS)

    total = lambda name: _add(F.transform(positions, lambda h: F.abs(h[name])))
    return F.struct(
        F.size(positions).alias("n"),
        total("risk").alias("risk"),
        total("notional").alias("notional"),
        by("sleeve", positions, F.size).alias("sleeves"),
        by("bucket", F.filter(positions, lambda h: h["sleeve"] == ""), F.size).alias("buckets"),
        by("instrument", positions, lambda hs: _add(F.transform(hs, lambda h: F.abs(h["notional"])))).alias("instruments"),
    )


def _permit(base: Column, added: Column, c: Column, limits: Limits) -> Column:
    """The permit of a candidate, given the positions from before and those that candidates ahead of it have added."""
    equity = c["equity"]
    limit_of = F.element_at(F.create_map(*[F.lit(v) for kv in limits.sleeves.items() for v in kv]), c["sleeve"]) if limits.sleeves else F.lit(None).cast("int")
    bucket_limit = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in limits.buckets.items() for v in kv]), c["bucket"]), F.lit(limits.other_bucket))
    count = lambda name, k: F.coalesce(F.get(F.filter(base[name], lambda e: e["k"] == k), 0)["v"], F.lit(0.0))
    in_sleeve = count("sleeves", c["sleeve"]) + F.size(F.filter(added, lambda h: h["sleeve"] == c["sleeve"]))
    in_bucket = count("buckets", c["bucket"]) + F.size(F.filter(added, lambda h: (h["sleeve"] == "") & (h["bucket"] == c["bucket"])))
    full = F.when(limit_of.isNotNull(), F.when(in_sleeve >= limit_of, "sleeve_full")).when(in_bucket >= bucket_limit, "bucket_full")
    slots = F.coalesce(full, F.when(base["n"] + F.size(added) >= limits.slots, "all_slots_full"))
    total = lambda name: _add(F.transform(added, lambda h: F.abs(h[name])), base[name])
    alike = lambda name: F.when(name == c["instrument"], F.lit(1.0)).otherwise(F.abs(F.coalesce(F.element_at(c["corr"], name), F.lit(0.0)))) >= limits.correlation
    before = _add(F.transform(F.filter(base["instruments"], lambda e: alike(e["k"])), lambda e: e["v"]))
    near = _add(F.transform(F.filter(added, lambda h: alike(h["instrument"])), lambda h: F.abs(h["notional"])), before)
    room = F.struct(
        slots.alias("slots"),
        (limits.book_risk - total("risk") / equity).alias("risk"),
        F.greatest(F.lit(0.0), limits.gross * equity - total("notional")).alias("gross"),
        F.greatest(F.lit(0.0), limits.correlated * equity - near).alias("near"),
    )

    def judged(r: Column) -> Column:
        risk = F.least(c["risk"], r["risk"])
        by_risk = equity * risk / (c["stop"] * c["tail"]) * c["price"]
        sizes = [("vol_target", c["at_vol"]), ("gross_exposure", r["gross"]), ("correlated_exposure", r["near"])] + ([("position_size", limits.position * equity)] if limits.position > 0 else [])
        # Each cap cuts what those before it left.
        after = [by_risk]
        for _, cap in sizes:
            after.append(F.least(after[-1], cap))
        named = F.filter(F.array(F.when(c["over"], "risk_of_trade"), F.when(c["risk"] > r["risk"], "book_risk"), *[F.when(cap < left, name) for (name, cap), left in zip(sizes, after, strict=False)]), lambda v: v.isNotNull())
        reason = F.coalesce(c["early"], r["slots"], c["late"], F.when(r["risk"] <= 0, "book_risk_full"), F.when(~(after[-1] > limits.least), "below_least"))
        notional = F.when(reason.isNull(), after[-1]).otherwise(0.0)
        return F.struct(reason.alias("reason"), notional.alias("notional"), F.coalesce(notional / c["price"], F.lit(0.0)).alias("units"), F.coalesce(notional / c["price"] * c["stop"] / equity, F.lit(0.0)).alias("risk"), F.when(reason.isNull(), F.array_join(named, ",")).otherwise("").alias("caps"))

    return _bound(room, "room", judged)


def _step(base: Column, added: Column, c: Column, limits: Limits) -> Column:
    """added with the position of the candidate, if it is permitted; with all slots taken no candidate is."""

    def taken(p: Column) -> Column:
        position = F.struct(c["instrument"].alias("instrument"), c["sleeve"].alias("sleeve"), c["bucket"].alias("bucket"), p["notional"].alias("notional"), (p["risk"] * c["equity"]).alias("risk"), c["k"].alias("k"))
        return F.when(p["reason"].isNull(), F.concat(added, F.array(position))).otherwise(added).cast(_ADDED)

    closed = c["early"].isNotNull() | (base["n"] + F.size(added) >= limits.slots)
    return F.when(closed, added).otherwise(_bound(_permit(base, added, c, limits), "permit", taken)).cast(_ADDED)


def permits(candidates: DataFrame, accounts: DataFrame, limits: Limits | None = None) -> DataFrame:
    """at, id, instrument, permitted, reason (null if permitted), risk (share of equity), notional, units, caps of each candidate."""
    limits = limits or Limits()
    known = accounts.select("at", "equity", "drawdown", "daily_loss", "scalar")
    filled = F.transform(F.coalesce("positions", F.array().cast(POSITION)), lambda h: h.withField("sleeve", F.coalesce(h["sleeve"], F.lit(""))).withField("bucket", F.coalesce(h["bucket"], F.lit("swing"))))
    # One row a moment: no candidate carries the positions.
    bases = accounts.groupBy("at").agg(F.first("positions").alias("positions")).select("at", filled.alias("positions")).select("at", _base(F.col("positions")).alias("base"))
    each = sized(candidates.join(known, "at", "left"), limits)
    row = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("by"), F.col("id").cast("bigint").alias("id"), "instrument", "sleeve", "bucket", F.col("_price").alias("price"), F.col("_stop").alias("stop"), "equity", "risk", "at_vol", "over", "tail", "early", "late", F.coalesce("corr", F.create_map().cast("map<string,double>")).alias("corr"))
    ranked = each.groupBy("at").agg(F.array_sort(F.collect_list(row), lambda p, q: F.when(p["by"] < q["by"], -1).when(p["by"] > q["by"], 1).when(p["id"] < q["id"], -1).when(p["id"] > q["id"], 1).otherwise(0)).alias("rows"))
    rows = ranked.join(bases, "at", "left").select("at", F.transform("rows", lambda c, i: c.withField("k", i)).alias("rows"), F.coalesce("base", _base(F.array().cast(POSITION))).alias("base"))
    fold = rows.withColumn("added", F.aggregate("rows", F.array().cast(_ADDED), lambda s, c: _step(F.col("base"), s, c, limits)))
    # The fold keeps only what it permits; each candidate is then judged by what was added ahead of it.
    c = F.col("c")
    ahead = F.filter("added", lambda h: h["k"] < c["k"])
    done = fold.select("at", "base", "added", F.explode("rows").alias("c")).select("at", "c", _bound(ahead, "ahead", lambda a: _permit(F.col("base"), a, c, limits)).alias("x"))
    return done.select("at", "c.id", "c.instrument", F.col("x.reason").isNull().alias("permitted"), "x.reason", "x.risk", "x.notional", "x.units", "x.caps")
