"""Domain rules: classes and 0/1 flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazewell.functions.scalars import flag, ladder, to_local

# Fixed values.
HOLIDAYS = {
    "dashain": [(9, d) for d in range(15, 25)],
    "tihar": [(10, d) for d in range(8, 13)],
    "new_year": [(1, 1)],
    "republic_day": [(5, 29)],
    "constitution_day": [(9, 20)],
    "independence_day": [(8, 15)],
}
SEASON_WEIGHTS = {"winter": 0.8, "spring": 0.6, "summer": 0.4, "autumn": 0.7}
FEATURE_FAMILIES = {
    "lag": ["lag_"],
    "rolling": ["rolling_", "met_rolling_"],
    "calendar": ["calendar_"],
    "cyclical": ["cyclical_", "seasonal_"],
    "meteorological": ["wind_", "temp_", "stability_", "comfort_", "pollution_", "bl_", "weather_"],
    "temporal": ["time_since_", "trend_"],
}


def wind_class(speed: Column) -> Column:
    steps = [(1, "calm"), (3, "light"), (5, "gentle"), (8, "moderate"), (12, "fresh")]
    return F.when(speed.isNull() | (speed < 0), "nan").otherwise(ladder(speed, steps, "strong"))


def wind_sector(direction: Column) -> Column:
    return F.pmod(F.floor((direction + 11.25) / 22.5), F.lit(16))


def temp_class(temp: Column) -> Column:
    return F.when(temp.isNull(), "nan").otherwise(ladder(temp, [(5, "cold"), (15, "cool"), (25, "mild"), (35, "warm")], "hot"))


def stability_class(speed: Column, ts: Column) -> Column:
    daytime = F.hour(ts).between(6, 18)
    return (
        F.when((speed < 2) & daytime, "unstable")
        .when(speed < 2, "stable")
        .when((speed <= 5) & daytime, "neutral_unstable")
        .when(speed <= 5, "neutral_stable")
        .otherwise("neutral")
    )


def bl_class(blh: Column) -> Column:
    steps = [(200, "very_low"), (500, "low"), (1000, "moderate"), (2000, "high")]
    return F.when(blh.isNull() | (blh <= 0), "nan").otherwise(ladder(blh, steps, "very_high"))


def weather_patterns(temp: Column, speed: Column, warming: Column, ts: Column) -> dict[str, Column]:
    """``warming`` is the change of temperature over six rows."""
    return {
        "hot_calm": flag((temp > 25) & (speed < 2)),
        "cold_windy": flag((temp < 15) & (speed > 5)),
        "inversion": flag((warming > 0) & (speed < 1.5) & (F.hour(ts) < 10)),
    }


def aqi_label(index: Column) -> Column:
    """Bins open on the left: an index of 0 has no class."""
    steps = [(50, "Good"), (100, "Moderate"), (150, "USG"), (200, "Unhealthy"), (300, "Very Unhealthy")]
    return F.when(index.isNull() | (index <= 0), "nan").otherwise(ladder(index, steps, "Hazardous"))


def aqi_category(index: Column, pm25: Column) -> dict[str, Column]:
    return {
        "category": aqi_label(index),
        "risk_low": flag(index <= 50),
        "risk_moderate": flag((index > 50) & (index <= 100)),
        "risk_high": flag(index > 150),
        "over_daily": flag(pm25 > 15),
        "over_annual": flag(pm25 > 5),
    }


def emission_flags(ts: Column) -> dict[str, Column]:
    local = to_local(ts)
    hour, workday, month = F.hour(local), F.weekday(local) < 5, F.month(local)
    return {
        "traffic_morning": flag(hour.between(7, 10) & workday),
        "traffic_evening": flag(hour.between(17, 20) & workday),
        "traffic_weekend": flag(hour.between(10, 18) & ~workday),
        "industrial": flag(hour.between(8, 18) & workday),
        "cooking_morning": flag(hour.between(6, 9)),
        "cooking_evening": flag(hour.between(18, 21)),
        "heating_winter": flag(month.isin(11, 12, 1, 2) & ((hour >= 18) | (hour <= 7))),
        "crop_burning": flag(month.isin(3, 4, 5) & hour.between(10, 15)),
    }


def pasquill_class(speed: Column, ts: Column) -> Column:
    """Classes 1..6; where ranges touch the later rule holds, so the rules are tested from last to first."""
    hour = F.hour(ts)
    daytime = hour.between(6, 18)
    return (
        F.when(speed >= 3, 4)
        .when((speed >= 2) & ~daytime, 5)
        .when(speed >= 2, 2)
        .when(~daytime, 6)
        .when(hour.between(10, 16), 1)
        .otherwise(4)
    )


def regional_seasons(ts: Column) -> dict[str, Column]:
    month = F.month(to_local(ts))
    months = {
        "pre_monsoon": (3, 4, 5),
        "monsoon": (6, 7, 8, 9),
        "post_monsoon": (10, 11),
        "winter": (12, 1, 2),
        "festival": (9, 10, 11),
        "planting": (5, 6, 7),
        "harvest": (10, 11, 12),
        "burning": (3, 4, 5, 10, 11),
    }
    return {name: flag(month.isin(*m)) for name, m in months.items()}


def topo_flags(direction: Column, speed: Column, blh: Column, temp: Column, ts: Column) -> dict[str, Column]:
    """The northern sector wraps over 0 degrees, so it is two ranges joined by OR."""
    hour = F.hour(to_local(ts))
    north = (direction >= 315) | (direction <= 45)
    south = direction.between(135, 225)
    return {
        "valley_breeze": flag(hour.between(8, 16) & south),
        "mountain_breeze": flag(((hour >= 18) | (hour <= 6)) & north),
        "cold_pool": flag((blh < 300) & (temp < 15)),
        "channelling": flag((north | south) & (speed > 2)),
    }


def daily_patterns(ts: Column) -> dict[str, Column]:
    local = to_local(ts)
    hour, workday = F.hour(local), F.weekday(local) < 5
    return {
        "morning_peak": flag(hour.between(7, 10)),
        "evening_peak": flag(hour.between(18, 21)),
        "quiet_night": flag(hour <= 6),
        "weekday_pattern": flag(workday),
        "weekend_pattern": flag(~workday),
        "school_hours": flag((hour.between(6, 8) | hour.between(10, 17)) & workday),
    }


def threshold_flags(pm25: Column, speed: Column, blh: Column, temp: Column) -> dict[str, Column]:
    return {
        "pm_daily": flag(pm25 > 15),
        "pm_annual": flag(pm25 > 5),
        "pm_unhealthy": flag(pm25 > 55.4),
        "pm_very_unhealthy": flag(pm25 > 150.4),
        "pm_hazardous": flag(pm25 > 250.4),
        "wind_low": flag(speed < 1.5),
        "wind_very_low": flag(speed < 0.5),
        "blh_low": flag(blh < 200),
        "blh_very_low": flag(blh < 100),
        "hot": flag(temp > 30),
        "cold": flag(temp < 10),
        "stagnant": flag((speed < 1.5) & (blh < 300)),
    }


def uhi_class(excess: Column) -> Column:
    return F.when(excess.isNull() | (excess <= 0), "nan").otherwise(
        ladder(excess, [(2, "None"), (5, "Weak"), (8, "Moderate")], "Strong")
    )


def regressor_dummies(speed: Column, temp: Column, ts: Column) -> dict[str, Column]:
    month, dow, hour = F.month(ts), F.weekday(ts), F.hour(ts)
    out = {
        "wind_calm": flag(speed < 2),
        "wind_light": flag((speed >= 2) & (speed < 5)),
        "wind_moderate": flag((speed >= 5) & (speed < 10)),
        "wind_strong": flag(speed >= 10),
        "temp_cold": flag(temp < 10),
        "temp_mild": flag((temp >= 10) & (temp < 25)),
        "temp_warm": flag(temp >= 25),
        "weekend": flag(dow >= 5),
        "in_winter": flag(month.isin(12, 1, 2)),
        "in_spring": flag(month.isin(3, 4, 5)),
        "in_summer": flag(month.isin(6, 7, 8)),
        "in_autumn": flag(month.isin(9, 10, 11)),
    }
    out |= {f"dow_{d}": flag(dow == d) for d in range(7)}
    out |= {f"hour_{h}": flag(hour == h) for h in (6, 7, 8, 9, 17, 18, 19, 20)}
    out |= {f"month_{m}": flag(month == m) for m in range(1, 13)}
    return out


def holiday_cols(ts: Column) -> dict[str, Column]:
    """0/1 per holiday and their sum, from the fixed (month, day) table."""
    code = F.month(ts) * 100 + F.dayofmonth(ts)
    out = {f"holiday_{n}": flag(code.isin(*[m * 100 + d for m, d in days])) for n, days in HOLIDAYS.items()}
    total = F.lit(0)
    for c in out.values():
        total = total + c
    return out | {"is_holiday": total}


def season_name(ts: Column) -> Column:
    m = F.month(ts)
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    )


def season_weight(ts: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in SEASON_WEIGHTS.items():
        out = F.when(season_name(ts) == name, w).otherwise(out)
    return out


def cross_border(south: Column, north: Column, south_lag: Column, north_lag: Column, ts: Column) -> dict[str, Column]:
    """Index, transport potential, gradient and season-weighted values of two neighbouring source regions."""
    w = season_weight(ts)
    return {
        "season_weight": w,
        "south_seasonal": south * w,
        "north_seasonal": north * w,
        "border_index": south * 0.6 + north * 0.4,
        "transport_potential": south_lag * 0.7 + north_lag * 0.3,
        "gradient": south - north,
    }


def feature_family(name: Column) -> Column:
    """Family of a feature by its name prefix."""
    out = F.lit("other")
    for family, prefixes in FEATURE_FAMILIES.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | name.startswith(p)
        out = F.when(hit, family).otherwise(out)
    return out
