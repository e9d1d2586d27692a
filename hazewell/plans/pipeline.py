"""The composed jobs: hourly feature table, feature selection, and air-quality category hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.functions import rules as R
from hazewell.functions import scalars as S
from hazewell.operators import clean as C
from hazewell.operators import joins as J
from hazewell.operators import select as K
from hazewell.operators import windows as W

TIME = "datetime_utc"
KEYS = ["station_id", TIME]


def category_hours(readings: DataFrame, rows: int = 24, least: int = 12) -> DataFrame:
    """Hours of each station per air-quality category of its rolling mean."""
    rolled = W.rolling(readings, ["pm25"], [rows], ("mean",), least=lambda n: least)
    index = S.aqi(F.col(f"mean_{rows}_pm25"))
    return rolled.select("station_id", R.aqi_label(index).alias("category")).groupBy("station_id", "category").agg(F.count("*").alias("hours"))


def temporal_features(df: DataFrame) -> DataFrame:
    """Lags, rolling statistics and slopes in one window group, then calendar columns."""
    out = W.lags(df, "pm25", [1, 2, 3, 6, 12, 24])
    out = W.rolling(out, ["pm25"], [6, 12, 24])
    out = W.rolling_slope(out, "pm25", [6, 24])
    ts = F.col(TIME)
    return out.withColumns(S.calendar_cols(ts) | S.calendar_flags(ts) | S.season_cols(ts) | S.cyclical_cols(ts) | S.time_since_cols(ts))


def weather_features(df: DataFrame) -> DataFrame:
    """Weather lags, statistics and derived indices; the same window key and order as the temporal ones."""
    ts, speed, temp, blh = F.col(TIME), F.col("wind_speed"), F.col("t2m_celsius"), F.col("blh")
    out = df
    for v in ("wind_speed", "wind_direction", "t2m_celsius", "blh"):
        out = W.lags(out, v, [1, 3, 6, 12])
    out = W.rolling(out, ["wind_speed", "t2m_celsius", "blh"], [6, 24])
    out = W.diffs(W.diffs(out, "wind_speed", [1, 3, 6], "shear"), "t2m_celsius", [1, 3, 6], "gradient", per_hour=True)
    out = W.temp_range(W.wind_consistency(out, "wind_direction", [6, 12, 24]), "t2m_celsius")
    out = out.withColumns({"wind_class": R.wind_class(speed), "wind_sector": R.wind_sector(F.col("wind_direction")), "temp_class": R.temp_class(temp),
                           "stability_class": R.stability_class(speed, ts), "bl_class": R.bl_class(blh)})
    return out.withColumns(S.comfort(temp, speed) | S.stability_cols(speed, blh, F.col("gradient_1"), ts) | S.pollution_potential(speed, blh, ts))


def domain_features(df: DataFrame) -> DataFrame:
    ts, speed, temp, blh, pm = F.col(TIME), F.col("wind_speed"), F.col("t2m_celsius"), F.col("blh"), F.col("pm25")
    index = S.aqi(pm)
    named = {
        "aqi": {"index": index} | R.aqi_category(index, pm),
        "emission": R.emission_flags(ts),
        "dispersion": {"class": R.pasquill_class(speed, ts)} | S.dispersion_cols(speed, blh, temp, R.pasquill_class(speed, ts)),
        "season": R.regional_seasons(ts),
        "urban": S.urban_cols(temp, speed, ts),
        "topo": R.topo_flags(F.col("wind_direction"), speed, blh, temp, ts),
        "daily": R.daily_patterns(ts),
        "threshold": R.threshold_flags(pm, speed, blh, temp),
    }
    return df.withColumns({f"{g}_{n}": c for g, cols in named.items() for n, c in cols.items()})


def build_features(readings: DataFrame, weather: DataFrame, rain: DataFrame, domain: bool = True) -> DataFrame:
    """Joined hourly table with all feature groups, one lazy plan: two equi-joins and one window exchange on the station."""
    joined = J.join_rain(J.join_weather(readings, weather), rain)
    filled = C.interpolate_limit(joined, 6, ["blh", "t2m_celsius", "wind_speed"])
    for c in ("blh", "t2m_celsius", "wind_speed"):
        filled = filled.withColumn(c, F.col(f"{c}_filled")).drop(f"{c}_filled")
    out = weather_features(temporal_features(filled))
    return domain_features(out) if domain else out


def select_features(df: DataFrame, cols: Sequence[str], min_variance: float = 0.001, max_corr: float = 0.95, max_null: float = 0.5) -> DataFrame:
    """The table without constant, low-variance, sparse and correlated features.

    Each decision comes from one aggregate; only the lists of column names reach the driver.
    """
    def names(rows: DataFrame) -> set[str]:
        return {r["feature"] for r in rows.select("feature").collect()}

    gone = names(K.constant_cols(df, cols)) | names(K.drop_sparse(df, cols, max_null))
    gone |= names(K.low_variance(df, [c for c in cols if c not in gone], min_variance))
    left = [c for c in cols if c not in gone]
    gone |= names(K.drop_correlated(df, left, max_corr)) if len(left) > 1 else set()
    return df.select(*[c for c in df.columns if c not in gone])
