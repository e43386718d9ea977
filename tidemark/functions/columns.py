"""Column-expression builders: calendar keys, geometry and statistics that stay inside codegen."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ missing values


def nan_to_null(c: ColumnLike) -> Column:
    """NaN counts as missing; Spark would otherwise order it highest and let it poison aggregates."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def row_sum(cols: list[ColumnLike]) -> Column:
    """Row-wise sum that skips missing cells; an all-missing row sums to zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) for c in cols])


def row_mean(cols: list[ColumnLike]) -> Column:
    """Row-wise mean over the present cells; NULL when none is present."""
    present = reduce(lambda a, b: a + b, [F.when(col(c).isNotNull(), 1).otherwise(0) for c in cols])
    return F.try_divide(row_sum(cols), present.cast("double"))


def strict_sum(c: ColumnLike) -> Column:
    """Aggregate sum that is NULL as soon as one input is missing."""
    c = col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def safe_ratio(num: ColumnLike, den: ColumnLike) -> Column:
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct_change(new: ColumnLike, old: ColumnLike) -> Column:
    return safe_ratio(col(new) - col(old), old) * 100.0


def significant(p: ColumnLike, alpha: float = 0.05) -> Column:
    return col(p) < F.lit(alpha)


# ------------------------------------------------------------------ calendar

# Month numbers of each meteorological season.
DJF_SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Autumn": (9, 10, 11)}
# Right-closed month bins of the calendar-quarter seasons.
QUARTER_SEASONS = (("Winter", 3), ("Spring", 6), ("Summer", 9), ("Autumn", 12))


def season_djf(month: ColumnLike) -> Column:
    m = col(month)
    expr = None
    for name, months in DJF_SEASONS.items():
        cond = m.isin(*months)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def season_quarter(month: ColumnLike) -> Column:
    """Quarter seasons: January to March is Winter, and so on; months outside 1..12 give NULL."""
    m = col(month)
    expr = F.when((m <= 0) | (m > 12), F.lit(None).cast("string"))
    for name, upper in QUARTER_SEASONS:
        expr = expr.when(m <= upper, name)
    return expr


def decade(year: ColumnLike) -> Column:
    return (F.floor(col(year) / 10) * 10).cast("long")


def month_start(ts: ColumnLike) -> Column:
    return F.trunc(col(ts).cast("date"), "MM")


def mid_year(year: ColumnLike) -> Column:
    return F.make_date(col(year).cast("int"), F.lit(7), F.lit(1))


def days_in_month(date: ColumnLike) -> Column:
    return F.dayofmonth(F.last_day(col(date)))


def seasonal_pair(month: ColumnLike, period: float = 12.0) -> tuple[Column, Column]:
    angle = col(month) * (2.0 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def step_weight(year: ColumnLike, steps: tuple[tuple[int, float], ...] = ((2018, 8.0), (2015, 4.0), (2010, 2.0))) -> Column:
    """Recency weight that doubles at each step year; rows before the first step weigh 1."""
    expr = None
    for start, weight in steps:
        cond = col(year) >= start
        expr = F.when(cond, weight) if expr is None else expr.when(cond, weight)
    return expr.otherwise(1.0)


# ------------------------------------------------------------------ normal distribution

# Cody's 1969 rational approximations of erf and erfc, highest power first.
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_MID_NUM = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
ERFC_MID_DEN = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
ERFC_FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERFC_FAR_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def erfc(c: ColumnLike) -> Column:
    x = col(c).cast("double")
    y = F.abs(x)
    near = 1.0 - y * polynomial(ERF_NUM, y * y) / polynomial(ERF_DEN, y * y)
    mid = F.exp(-y * y) * polynomial(ERFC_MID_NUM, y) / polynomial(ERFC_MID_DEN, y)
    inv = 1.0 / (y * y)
    far = F.exp(-y * y) / y * (F.lit(0.5641895835477563) - inv * polynomial(ERFC_FAR_NUM, inv) / polynomial(ERFC_FAR_DEN, inv))
    upper = F.when(y <= 0.46875, near).when(y <= 4.0, mid).otherwise(far)
    return F.when(x < 0, 2.0 - upper).otherwise(upper)


def normal_cdf(z: ColumnLike) -> Column:
    return 0.5 * erfc(-col(z) / F.lit(2.0**0.5))


def normal_two_sided_p(z: ColumnLike) -> Column:
    return erfc(F.abs(col(z)) / F.lit(2.0**0.5))


# ------------------------------------------------------------------ earth geometry

# Mean earth radius in km, WGS84 axes in metres.
EARTH_RADIUS_KM = 6371.0
WGS84_A = 6378137.0
WGS84_B = 6356752.3


def haversine_km(lon1: ColumnLike, lat1: ColumnLike, lon2: ColumnLike, lat2: ColumnLike) -> Column:
    lon1, lat1, lon2, lat2 = (F.radians(col(c)) for c in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would hide a missing point


def earth_radius_m(lat: ColumnLike) -> Column:
    """Geocentric radius of the ellipsoid below a geodetic latitude."""
    c, s = F.cos(F.radians(col(lat))), F.sin(F.radians(col(lat)))
    top = F.pow(c * WGS84_A**2, 2) + F.pow(s * WGS84_B**2, 2)
    bottom = F.pow(c * WGS84_A, 2) + F.pow(s * WGS84_B, 2)
    return F.sqrt(top / bottom)


def pixel_area_m2(lat: ColumnLike, dlon: float, dlat: float) -> Column:
    """Area of a ``dlon`` x ``dlat`` degree cell centred on ``lat``."""
    return abs(dlon * dlat) * (3.141592653589793 / 180.0) ** 2 * F.pow(earth_radius_m(lat), 2) * F.cos(F.radians(col(lat)))


def bearing_side(lon: ColumnLike, lat: ColumnLike, lon0: ColumnLike, lat0: ColumnLike) -> Column:
    """Compass side of a point seen from a centre, by quadrants around the axes."""
    angle = F.pmod(F.degrees(F.atan2(col(lat) - col(lat0), col(lon) - col(lon0))), F.lit(360.0))
    return (
        F.when((angle >= 45) & (angle < 135), "North")
        .when((angle >= 135) & (angle < 225), "West")
        .when((angle >= 225) & (angle < 315), "South")
        .otherwise("East")
    )


# ------------------------------------------------------------------ equal-area projection

WGS84_F = 1 / 298.257223563


class EqualArea:
    """Lambert azimuthal equal-area projection of the ellipsoid (Snyder 1987, section 24) in columns."""

    def __init__(self, lat0: float = 42.0, lon0: float = 51.0):
        self.e2 = WGS84_F * (2 - WGS84_F)
        self.e = math.sqrt(self.e2)
        self.lon0 = math.radians(lon0)
        sin0 = math.sin(math.radians(lat0))
        self.qp = self._q_value(1.0)
        self.rq = WGS84_A * math.sqrt(self.qp / 2)
        beta0 = math.asin(self._q_value(sin0) / self.qp)
        self.sin_b0, self.cos_b0 = math.sin(beta0), math.cos(beta0)
        self.d = WGS84_A * math.cos(math.radians(lat0)) / math.sqrt(1 - self.e2 * sin0**2) / (self.rq * self.cos_b0)

    def _q_value(self, s: float) -> float:
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - math.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))

    def project(self, df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
        """Add projected metres.  Intermediate terms are columns, so no term is spelled out twice."""
        s, e2 = F.col("_s"), self.e2
        steps = [
            {"_s": F.sin(F.radians(lat)), "_dl": F.radians(lon) - self.lon0},
            {"_sb": (1 - e2) / self.qp * (s / (1 - e2 * s * s) - F.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))},
            {"_cb": F.sqrt(1 - F.col("_sb") * F.col("_sb"))},
            {"_b": self.rq * F.sqrt(2 / (1 + self.sin_b0 * F.col("_sb") + self.cos_b0 * F.col("_cb") * F.cos("_dl")))},
            {
                x: F.col("_b") * self.d * F.col("_cb") * F.sin("_dl"),
                y: F.col("_b") / self.d * (self.cos_b0 * F.col("_sb") - self.sin_b0 * F.col("_cb") * F.cos("_dl")),
            },
        ]
        return reduce(lambda d, cols: d.withColumns(cols), steps, df).drop("_s", "_dl", "_sb", "_cb", "_b")

    def unproject(self, df: DataFrame, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
        """Add longitude and latitude of projected metres."""
        rho, c, beta = F.col("_rho"), F.col("_c"), F.col("_beta")
        at_pole = rho < 1e-9
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        latitude = (
            beta
            + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
            + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
            + 761 * e6 / 45360 * F.sin(6 * beta)
        )
        across = F.atan2(F.col(x) * F.sin(c), self.d * rho * self.cos_b0 * F.cos(c) - self.d**2 * F.col(y) * self.sin_b0 * F.sin(c))
        steps = [
            {"_rho": F.sqrt(F.pow(F.col(x) / self.d, 2) + F.pow(F.col(y) * self.d, 2))},
            {"_c": 2 * F.asin(rho / (2 * self.rq))},
            {"_beta": F.asin(F.when(at_pole, self.sin_b0).otherwise(F.cos(c) * self.sin_b0 + self.d * F.col(y) * F.sin(c) * self.cos_b0 / rho))},
            {lon: F.degrees(F.when(at_pole, self.lon0).otherwise(self.lon0 + across)), lat: F.degrees(latitude)},
        ]
        return reduce(lambda d, cols: d.withColumns(cols), steps, df).drop("_rho", "_c", "_beta")
