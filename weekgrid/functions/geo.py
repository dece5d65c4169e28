"""Distances and geohash-4 cells as pure expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import bind, let

# Geohash alphabet, earth radius, centre pin of unlocated UK rows.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_KM = 6371.0
UK_CENTRE = (55.378, -3.436)

AXIS = 1024  # 10 bits per axis in a 4-character cell


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lng), F.lit(2.0)
    )
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def _axis(value: Column, low: float, span: float) -> Column:
    """Cell index on one axis; a value on a border belongs to the lower cell."""
    at = F.ceil((value - low) / span * AXIS).cast("int") - 1
    return F.least(F.greatest(at, F.lit(0)), F.lit(AXIS - 1))


def _pair_table() -> str:
    """Letter for every (3-bit, 2-bit) pair: one letter interleaves three bits of one axis with two of the other."""
    letters = []
    for three in range(8):
        for two in range(4):
            bits = (three >> 2, two >> 1, (three >> 1) & 1, two & 1, three & 1)
            letters.append(ALPHABET[int("".join(map(str, bits)), 2)])
    return "".join(letters)


PAIRS = _pair_table()


def _bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def _letters(x: Column, y: Column) -> Column:
    """Longitude leads in the odd letters, latitude in the even ones."""

    def letter(three: Column, two: Column) -> Column:
        return F.substr(F.lit(PAIRS), three * 4 + two + 1, F.lit(1))

    return F.concat(
        letter(_bits(x, 7, 7), _bits(y, 8, 3)),
        letter(_bits(y, 5, 7), _bits(x, 5, 3)),
        letter(_bits(x, 2, 7), _bits(y, 3, 3)),
        letter(_bits(y, 0, 7), _bits(x, 0, 3)),
    )


def geohash4(lat: Column, lng: Column) -> Column:
    """Cell of a pin; a pin without either coordinate has none."""
    cell = _letters(_axis(lng, -180.0, 360.0), _axis(lat, -90.0, 180.0))
    return F.when(lat.isNotNull() & lng.isNotNull(), cell)


def _cell_axes(cell: Column) -> tuple[Column, Column]:
    """Cell text back to its two axis indices."""
    at = [F.instr(F.lit(PAIRS), F.substring(cell, i, 1)) - 1 for i in range(1, 5)]
    three = [_bits(a, 2, 7) for a in at]
    two = [_bits(a, 0, 3) for a in at]
    x = three[0] * 128 + two[1] * 32 + three[2] * 4 + two[3]
    y = two[0] * 256 + three[1] * 32 + two[2] * 8 + three[3]
    return x, y


# Centre, then clockwise from north.
RING = ((0, 0), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def neighbors(cell: Column) -> Column:
    """The cell and its ring: longitude wraps, latitude stops at the poles."""
    x, y = _cell_axes(cell)

    def around(at: Column) -> Column:
        return F.array(
            *[
                _letters(
                    F.pmod(at["x"] + dx, F.lit(AXIS)),
                    F.least(F.greatest(at["y"] + dy, F.lit(0)), F.lit(AXIS - 1)),
                )
                for dy, dx in RING
            ]
        )

    return F.when(cell.isNotNull(), F.array_distinct(let(F.struct(x.alias("x"), y.alias("y")), around)))


def explode_ring(df: DataFrame, source: str, name: str) -> DataFrame:
    """One row per cell of the ring around `source`, centre included, as the new column `name`.

    The ring is built from the axis numbers and spelt out afterwards, all in generated code.
    """
    x, y = _cell_axes(F.col(source))
    df = bind(df, _x=x, _y=y)
    codes = [
        F.when(
            (F.col("_y") + dy).between(0, AXIS - 1),
            F.pmod(F.col("_x") + dx, F.lit(AXIS)) * AXIS + F.col("_y") + dy,
        )
        for dy, dx in RING
    ]
    df = df.withColumn("_code", F.explode(F.array(*codes))).where(F.col("_code").isNotNull())
    cell = _letters(F.shiftright("_code", 10), F.col("_code").bitwiseAND(F.lit(AXIS - 1)))
    return df.withColumn(name, cell).drop("_x", "_y", "_code")


def is_adjacent(left: Column, right: Column) -> Column:
    """Both cells are the same or touch."""
    (x1, y1), (x2, y2) = _cell_axes(left), _cell_axes(right)
    return (F.pmod(x1 - x2 + 1, F.lit(AXIS)) <= 2) & (F.abs(y1 - y2) <= 1)


def valid_pin(lat: Column, lng: Column) -> Column:
    finite = ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce(finite & lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def with_geo(lat: Column, lng: Column) -> Column:
    """{lat, lng, geohash4}; all null unless both are in range."""
    ok = valid_pin(lat, lng)
    return F.struct(
        F.when(ok, lat).alias("lat"),
        F.when(ok, lng).alias("lng"),
        F.when(ok, geohash4(lat, lng)).alias("geohash4"),
    )


def is_uk_centre(lat: Column, lng: Column) -> Column:
    return (F.abs(lat - UK_CENTRE[0]) < 0.01) & (F.abs(lng - UK_CENTRE[1]) < 0.01)


def format_distance(km: Column) -> Column:
    """Metres below one, one decimal below ten, whole kilometres beyond."""
    return (
        F.when(km < 1, F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit(" m")))
        .when(km < 10, F.format_string("%.1f km", km))
        .when(km.isNotNull(), F.concat(F.floor(km + 0.5).cast("string"), F.lit(" km")))
    )


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors; a zero vector scores 0."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    dot = total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))
    norm_left = F.sqrt(total(F.transform(left, lambda v: v.cast("double") * v.cast("double"))))
    norm_right = F.sqrt(total(F.transform(right, lambda v: v.cast("double") * v.cast("double"))))
    scale = norm_left * norm_right
    return F.when(scale > 0, dot / scale).when(scale == 0, F.lit(0.0))
