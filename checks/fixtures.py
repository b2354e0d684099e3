"""Stock-panel views derived from the driver tables.

A supplier is a stock, a region an industry. Money is summed as whole cents so that every
engine gets the same doubles. ``Data`` builds each view once, as a DataFrame; the views that
several queries read more than once are staged.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.conformal import conformal_predictions
from alphaloom.operators.cross_section import composite_score, model_panel
from alphaloom.operators.factors import compute_factors, excess_return_label
from alphaloom.operators.joins import asof_join, asof_series, join_date_series, two_channel_total
from alphaloom.operators.nav import daily_nav
from alphaloom.operators.order_stats import keep_top
from alphaloom.operators.staging import per_date, stage
from alphaloom.operators.positions import equal_weight_book, prepare_snapshot, snapshots

FEATURES = ("ret_20", "volatility_20", "turnover_20", "roe", "ep_ttm")
TRAIN_MONTHS = 12
MIN_ROWS = 30
EMBARGO = 20


def r(c, digits: int = 6):
    """Round for comparison; adding 0.0 turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def view(build):
    """Build a view once per ``Data``; the ones in STAGED are written and read back."""

    @wraps(build)
    def once(self):
        name = build.__name__
        if name not in self._views:
            df = build(self)
            self._views[name] = stage(df) if name in STAGED else df
        return self._views[name]

    return once


STAGED = {"trades", "labeled", "model", "series", "book", "nav", "conformal", "conformal_five", "prepared", "membership"}


def traded() -> list:
    """Amount, volume and turnover rate, from the sums of a code and day."""
    return [
        (F.col("cents") / F.lit(100.0)).alias("amount"),
        F.col("qty").cast("double").alias("vol"),
        F.when(F.col("mx") % 17 != 0, F.col("qty") / (100 + F.col("ts_code") % 7)).alias("turnover_rate"),
    ]


class Data:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @view
    def trades(self):
        """Sums of a code and day, from which the columns of ``daily`` follow."""
        li = self.table("lineitem")
        return li.groupBy(F.col("l_suppkey").alias("ts_code"), F.col("l_shipdate").cast("date").alias("trade_date")).agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
            F.sum(F.col("l_quantity").cast("long")).alias("qty"),
            F.max("l_orderkey").alias("mx"),
        )

    @view
    def daily(self):
        return self.trades().select("ts_code", "trade_date", "cents", "qty", "mx", *traded())

    @view
    def bars(self):
        w = W.partitionBy("ts_code").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
        close = F.sum("cents").over(w) / F.lit(100.0) / F.sum("qty").over(w)
        # what follows from a row is derived after the window, so that its shuffle moves the sums alone
        return self.trades().withColumn("close", close).select("ts_code", "trade_date", *traded(), "close")

    @view
    def industry(self):
        s, n, g = self.table("supplier"), self.table("nation"), self.table("region")
        return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("s_suppkey").alias("ts_code"),
            F.when(F.col("s_suppkey") % 11 != 0, F.col("r_name")).alias("industry_name"),
            (F.col("s_acctbal") / 100).alias("pe_ttm"),
        )

    @view
    def benchmark(self):
        w = W.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
        days = self.daily().groupBy("trade_date").agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"))
        return days.select("trade_date", (F.sum("cents").over(w) / F.lit(100.0) / F.sum("qty").over(w)).alias("close"))

    @view
    def financials(self):
        li = self.table("lineitem").select(
            F.col("l_suppkey").alias("ts_code"),
            F.year("l_shipdate").alias("y"),
            F.quarter("l_shipdate").alias("q"),
            F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
            F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
        )
        g = li.groupBy("ts_code", "y", "q").agg(
            (F.sum("disc") / F.count(F.lit(1)) / F.lit(100.0)).alias("roe"), (F.sum("tax") / F.count(F.lit(1)) / F.lit(100.0)).alias("netprofitmargin")
        )
        ann = F.expr(
            "CASE q WHEN 4 THEN make_date(y+1,4,30) WHEN 1 THEN make_date(y,4,30) WHEN 2 THEN make_date(y,8,31) ELSE make_date(y,10,31) END"
        )
        return g.select("ts_code", ann.alias("ann_date"), F.expr("make_date(y, q*3, 1)").alias("end_date"), "roe", "netprofitmargin")

    @view
    def macro(self):
        m = self.table("orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total")
        )
        yoy = F.col("total") / F.lag("total", 12).over(W.orderBy("y", "m")) - 1
        day = F.expr("CASE WHEN m <= 10 THEN make_date(y, m+2, 10) ELSE make_date(y+1, m-10, 10) END")
        return m.select(day.alias("trade_date"), yoy.alias("macro_yoy"))

    @view
    def membership(self):
        monthly = self.daily().groupBy(F.date_trunc("month", "trade_date").cast("date").alias("month"), "ts_code").agg(F.sum("cents").alias("amt"))
        return keep_top(
            monthly, ["month"], F.col("amt"), F.col("ts_code"), lambda n: F.ceil(n * 0.6), 0.6, calendar_keyed=True
        ).select("month", "ts_code")

    @view
    def panel(self):
        p = asof_join(self.bars(), self.financials()).join(self.industry(), "ts_code", "left")
        return asof_series(p, self.macro())

    @view
    def labeled(self):
        return excess_return_label(compute_factors(self.panel()), self.benchmark())

    @view
    def model(self):
        return model_panel(self.labeled(), list(FEATURES))

    @view
    def series(self):
        """The external series on the model panel's dates: two-channel flow by day, a monthly series as of the day."""
        side = lambda k, n: self.daily().where(F.col("ts_code") % 7 == k).groupBy("trade_date").agg((F.sum("cents") / F.lit(100.0)).alias(n))
        flow = two_channel_total(side(0, "sh"), side(1, "sz"), "trade_date", "sh", "sz", "northbound_net_inflow")
        m = self.table("orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        urgent = F.col("o_orderpriority") < "3"
        m = m.agg(F.sum(F.when(urgent, cents)).alias("high"), F.sum(cents).alias("every"))
        day = F.expr("CASE WHEN m <= 11 THEN make_date(y, m+1, 5) ELSE make_date(y+1, m-11, 5) END")
        spread = m.select(day.alias("trade_date"), (F.col("high") / F.col("every")).alias("cn_spread_10y_2y"))
        days = join_date_series(self.model().select("trade_date").distinct(), flow.select("trade_date", "northbound_net_inflow"))
        return asof_series(days, spread)

    @view
    def external(self):
        """The model panel with the three external series; only the series are staged, a row a date."""
        return self.model().withColumnRenamed("macro_yoy", "m2_yoy").join(per_date(self.series()), "trade_date", "left")

    @view
    def scored(self):
        """Composite score, rounded so that equal z-scores tie in every engine."""
        return self.model().withColumn("score", r(composite_score(FEATURES), 8))

    @view
    def book(self):
        return equal_weight_book(self.scored(), 20)

    @view
    def nav(self):
        return daily_nav(self.scored(), self.book())

    @view
    def conformal(self):
        """Embargoed rolling conformal predictions with the closed-form estimator on ret_20."""
        return conformal_predictions(
            self.model(), ["ret_20"], train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO, split_key=split_key()
        ).predictions

    @view
    def conformal_five(self):
        """The same on all features."""
        return conformal_predictions(
            self.model(), FEATURES, train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO, split_key=split_key()
        ).predictions

    @view
    def prepared(self):
        """Optimiser snapshots: membership amount as benchmark weight, composite score as alpha."""
        snap = snapshots(self.scored().withColumn("benchmark_weight", F.col("amount")))
        return prepare_snapshot(snap.select("rebalance_date", "ts_code", "industry_name", "benchmark_weight", "score"))


def split_key(seed: int = 42):
    """Arithmetic scramble of (code, day), the same in every engine."""
    day = F.datediff(F.col("trade_date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((F.col("ts_code") * 100003 + day + seed) * 48271) % 2147483647


_kept: dict[tuple[str, str], Data] = {}


def data(spark: SparkSession, sf_dir: str) -> Data:
    """Shared views of one session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = Data(spark, sf_dir)
    return _kept[key]


def reset() -> None:
    """Forget shared views."""
    _kept.clear()
