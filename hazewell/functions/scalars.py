"""Scalar column functions: calendar, weather, health index, geometry, nested values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOCAL_OFFSET_MINUTES = 345
EARTH_RADIUS_KM = 6371.0
AQI_PM25 = [0.0, 12.0, 35.4, 55.4, 150.4, 250.4, 350.4]
AQI_INDEX = [0, 50, 100, 150, 200, 300, 400]
MAX_DISTANCE_KM = 2000.0
SEASON_OF_MONTH = {"winter": [12, 1, 2], "spring": [3, 4, 5], "summer": [6, 7, 8], "autumn": [9, 10, 11]}


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(cond, 1).otherwise(0)


def ladder(x: Column, steps: list[tuple[float, object]], last: object) -> Column:
    """First label whose upper edge (inclusive) is not below x."""
    out = F.lit(last)
    for edge, label in reversed(steps):
        out = F.when(x <= edge, F.lit(label)).otherwise(out)
    return out


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x
    if low is not None:
        out = F.when(x.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(x.isNotNull(), F.least(out, F.lit(high)))
    return out


# --- calendar -------------------------------------------------------------------------------

def calendar_cols(ts: Column) -> dict[str, Column]:
    return {
        "cal_hour": F.hour(ts),
        "cal_dow": F.weekday(ts),
        "cal_day": F.dayofmonth(ts),
        "cal_doy": F.dayofyear(ts),
        "cal_week": F.weekofyear(ts),
        "cal_month": F.month(ts),
        "cal_quarter": F.quarter(ts),
        "cal_year": F.year(ts),
    }


def calendar_flags(ts: Column) -> dict[str, Column]:
    day = F.to_date(ts)
    quarter_start = F.trunc(day, "quarter")
    return {
        "is_weekend": flag(F.weekday(ts) >= 5),
        "is_month_start": flag(F.dayofmonth(ts) == 1),
        "is_month_end": flag(day == F.last_day(day)),
        "is_quarter_start": flag(day == quarter_start),
        "is_quarter_end": flag(day == F.last_day(F.add_months(quarter_start, 2))),
    }


def season_cols(ts: Column) -> dict[str, Column]:
    month = F.month(ts)
    return {
        "season": F.floor((month % 12) / 3),
        "is_monsoon": flag(month.between(6, 8)),
        "is_dry": flag((month >= 10) | (month <= 5)),
    }


def cycle(position: Column, period: float) -> tuple[Column, Column]:
    angle = position * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def cyclical_cols(ts: Column) -> dict[str, Column]:
    out = {}
    for name, pos, period in [
        ("hour", F.hour(ts), 24),
        ("dow", F.weekday(ts), 7),
        ("doy", F.dayofyear(ts), 365.25),
        ("month", F.month(ts), 12),
    ]:
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(pos, period)
    return out


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600


def phase_cols(ts: Column, start: Column, periods=(24, 168)) -> dict[str, Column]:
    """Position in each cycle counted from a common start."""
    out = {}
    for p in periods:
        out[f"phase_{p}_sin"], out[f"phase_{p}_cos"] = cycle(F.pmod(hours_between(ts, start), F.lit(p)), p)
    return out


def time_since_cols(ts: Column) -> dict[str, Column]:
    return {f"since_{u}": hours_between(ts, F.date_trunc(u, ts)) for u in ("day", "week", "month")}


def to_local(ts: Column) -> Column:
    """UTC to the fixed local offset of +5:45."""
    return ts + F.expr(f"INTERVAL {LOCAL_OFFSET_MINUTES} MINUTES")


def round_hour(ts: Column) -> Column:
    """Nearest hour; an exact half goes to the even hour."""
    base = F.date_trunc("hour", ts)
    past = F.unix_micros(ts) - F.unix_micros(base)
    half = 1_800_000_000
    up = (past > half) | ((past == half) & (F.hour(ts) % 2 == 1))
    return F.when(up, base + F.expr("INTERVAL 1 HOUR")).otherwise(base)


# --- weather --------------------------------------------------------------------------------

def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column, wrap: bool = True) -> Column:
    deg = F.degrees(F.atan2(v, u))
    return F.pmod(deg, F.lit(360.0)) if wrap else deg


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def relative_humidity(temp_c: Column, dew_c: Column) -> Column:
    """Magnus formula, limited to 0..100."""
    def vapour(t: Column) -> Column:
        return F.exp(t * 17.67 / (t + 243.5))

    return clip(vapour(dew_c) / vapour(temp_c) * 100, 0.0, 100.0)


def weather_indices(temp: Column, blh: Column, speed: Column, ts: Column) -> dict[str, Column]:
    vent = speed * blh
    hour = F.hour(ts)
    return {
        "temp_gradient": temp / (blh / 1000),
        "stability_index": blh / (temp + 273.15),
        "ventilation_index": vent,
        "pollution_potential": 1 / (vent + 1),
        "is_night": flag((hour < 6) | (hour > 18)),
        "is_morning": flag(hour.between(6, 11)),
        "is_afternoon": flag(hour.between(12, 17)),
    }


def comfort(temp: Column, speed: Column) -> dict[str, Column]:
    kmh = F.pow(speed * 3.6, F.lit(0.16))
    return {
        "wind_chill": F.when(temp < 10, 13.12 + temp * 0.6215 - kmh * 11.37 + temp * kmh * 0.3965).otherwise(temp),
        "heat_index": F.when(temp > 20, temp + (temp - 20) * (temp - 20) * 0.1).otherwise(temp),
        "effective_temp": temp - (temp - 10) * 0.4 * F.pow(speed * 3.6 / 10, F.lit(0.16)),
    }


def stability_cols(speed: Column, blh: Column, gradient: Column, ts: Column) -> dict[str, Column]:
    daytime = F.hour(ts).between(6, 18)
    depth = F.log(blh + 1)
    return {
        "richardson": F.when(speed > 0, gradient / (speed * speed + 0.1)).otherwise(0.0),
        "mixing_potential": speed * depth,
        "ventilation": speed * blh,
        "stability_indicator": clip(speed / 10 + F.when(daytime, 0.3).otherwise(-0.3) + depth / 10, 0.0, 1.0),
    }


def pollution_potential(speed: Column, blh: Column, ts: Column) -> dict[str, Column]:
    disp = F.log(speed + 0.1) * F.log(blh + 1) / 10
    return {
        "dispersion_score": disp,
        "accumulation_score": 1 / (disp + 0.1),
        "stagnation": flag((speed < 2) & (blh < 500)),
        "traffic_alignment": flag(F.hour(ts).isin(7, 8, 9, 17, 18, 19, 20) & (speed < 3)),
    }


def dispersion_cols(speed: Column, blh: Column, temp: Column, stability: Column) -> dict[str, Column]:
    return {
        "sigma_y": F.sqrt(speed + 0.1) * stability / 40,
        "sigma_z": F.sqrt(blh / 1000) * 0.3 / stability,
        "effective_height": F.least(blh * 0.8, F.lit(200.0)),
        "plume_rise": F.greatest(F.lit(0.0), 25 - temp) * 2,
        "dispersion_potential": speed * F.log(blh + 1) / (stability + 1),
    }


def urban_cols(temp: Column, speed: Column, ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    return {
        "heat_excess": F.greatest(F.lit(0.0), temp - 22),
        "peak_heating": flag(hour.between(8, 10)),
        "night_cooling": flag(hour.between(13, 18)),
        "wind_reduction": F.exp(-speed / 3),
        "canyon": flag((speed < 2) & (temp > 25)),
    }


# --- health index ---------------------------------------------------------------------------

def aqi(pm25: Column, legacy: bool = False) -> Column:
    """Piecewise linear index, open at the top; ``legacy`` lets the fourth piece climb to 250 before it drops."""
    tops = list(AQI_INDEX)
    pieces = []
    for i in range(6):
        top = 250 if legacy and i == 3 else tops[i + 1]
        lo = AQI_PM25[i]
        pieces.append((AQI_PM25[i + 1], (pm25 - lo) * (top - tops[i]) / (AQI_PM25[i + 1] - lo) + tops[i]))
    out = pieces[-1][1]
    for edge, value in reversed(pieces[:-1]):
        out = F.when(pm25 <= edge, value).otherwise(out)
    return out


def aqi_to_pm25(index: Column) -> Column:
    """Half-slope table: every piece has slope one half and starts at half of its edge."""
    return index * 0.5


# --- geometry -------------------------------------------------------------------------------

def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def distance_weight(weight: Column, km: Column) -> Column:
    """Weight that falls with distance and is 0 beyond the limit."""
    return F.when(km <= MAX_DISTANCE_KM, weight / (1 + km / 100)).otherwise(0.0)


# --- pairs, strings, nested -----------------------------------------------------------------

def interact(a: Column, b: Column, kind: str) -> Column:
    if kind == "multiplicative":
        return a * b
    if kind == "ratio":
        return F.when(b + 1e-8 != 0, a / (b + 1e-8))
    if kind == "difference":
        return a - b
    if kind == "polynomial":
        return a * a + b * b
    if kind == "log_ratio":
        return F.when((a > 0) & (b > 0), F.log(a + 1) - F.log(b + 1))
    raise ValueError(f"unknown interaction kind {kind!r}")


def feature_name(prefix: str, n: int, target: str) -> str:
    return f"{prefix}_{n}h_{target}"


def quantile_key(q: Column) -> Column:
    return F.format_string("q%.2f", q)


def partition_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def gap_key(station: Column, start: Column) -> Column:
    return F.concat_ws("_", F.lit("gap"), station.cast("string"), F.date_format(start, "yyyyMMddHH"))


def array_stats(path: Column) -> dict[str, Column]:
    """First, last, greatest value and its 0-based step of a forecast path."""
    return {
        "first_value": F.element_at(path, 1),
        "last_value": F.element_at(path, -1),
        "max_value": F.array_max(path),
        "peak_step": F.array_position(path, F.array_max(path)) - 1,
        "steps": F.size(path),
    }


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# --- aggregates -----------------------------------------------------------------------------

def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over rows where both are present; null for a constant side (the built-in divides by zero there)."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
