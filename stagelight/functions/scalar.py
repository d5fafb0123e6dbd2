"""Column expressions: durations, sizes, limits, contrast, names, paths, flags and point transforms."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def round_even(v: Column | str, digits: int = 0) -> Column:
    """Round half to even, as numpy does."""
    return F.bround(_c(v).cast("double"), digits)


def format_duration(seconds: Column | str) -> Column:
    """``2h 3m 4s`` / ``3m 4s`` / ``4s``; NULL gives ``n/a``; negative counts as 0."""
    s = F.greatest(F.lit(0), round_even(seconds).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(_c(seconds).isNull(), F.lit("n/a"))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, r))
        .when(m > 0, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def format_day_duration(seconds: Column | str) -> Column:
    """``Dd, Hh, Mm`` truncated to the minute; under a minute ``Ns``."""
    s = round_even(seconds).cast("long")
    minutes = F.floor(s / 60)
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(
        F.format_string("%dd, %dh, %dm", F.floor(minutes / 1440), F.floor(minutes % 1440 / 60), minutes % 60)
    )


def format_bytes(n: Column | str, digits: int = 1) -> Column:
    """Binary units, B without decimals, the largest unit is TiB."""
    b = _c(n).cast("double")
    units = ["KiB", "MiB", "GiB", "TiB"]
    out = F.when(b < 1024, F.concat(_c(n).cast("long").cast("string"), F.lit(" B")))
    for i, u in enumerate(units, start=1):
        text = F.format_string(f"%.{digits}f {u}", b / float(1024**i))
        out = out.when(b < float(1024 ** (i + 1)), text) if u != "TiB" else out.otherwise(text)
    return out


def nice_limit(percentile_of_abs: Column | str, floor: float = 10.0) -> Column:
    """Round a positive number up to 1, 2 or 5 times a power of ten; NULL or <= 0 gives ``floor``."""
    hi = _c(percentile_of_abs)
    safe = F.when(hi > 0, hi).otherwise(F.lit(1.0))
    mag = F.pow(F.lit(10.0), F.floor(F.log10(safe)))
    stepped = F.when(safe <= mag, mag)
    for m in (2, 5, 10):
        stepped = stepped.when(safe <= m * mag, m * mag)
    return F.when(hi > 0, stepped.otherwise(10 * mag)).otherwise(F.lit(float(floor)))


# fixed values: camera channel of each excitation wavelength (nm), per instrument family
FIVE_LASER_CHANNELS = {405: 4, 488: 3, 560: 2, 650: 1, 750: 0}
FOUR_LASER_CHANNELS = {405: 3, 488: 2, 560: 1, 650: 0}
CHANNELS = {
    **{name: FIVE_LASER_CHANNELS for name in ("MF2", "MF3", "MF4", "MF5")},
    **{name: FOUR_LASER_CHANNELS for name in ("MFX", "ST2")},
}


def channel_map(color: Column | str, mapping: dict[int, int]) -> Column:
    """Wavelength to channel number: blank stays NULL, an unknown wavelength is an error when evaluated."""
    c = round_even(color).cast("int")
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(pairs, c)
    return F.when(_c(color).isNull(), F.lit(None).cast("int")).when(hit.isNotNull(), hit).otherwise(
        F.raise_error(F.concat(F.lit("no channel for wavelength "), c.cast("string"))).cast("int")
    )


def power_list(powers: dict[float, float], mapping: dict[int, int], default: float = 1.0) -> Column:
    """Power per channel in channel order, ``default`` where no wavelength of the channel is given."""
    by_channel = {}
    for color, value in powers.items():
        if round(color) not in mapping:
            raise ValueError(f"no channel for wavelength {color}; known: {sorted(mapping)}")
        by_channel[mapping[round(color)]] = float(value)
    return F.array(*[F.lit(by_channel.get(i, float(default))) for i in range(max(mapping.values()) + 1)])


def contrast_stretch(v: Column | str, lo: Column, hi: Column) -> Column:
    """clip((v-lo)/(hi-lo),0,1)*255 truncated; an empty range gives 0."""
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_c(v) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return F.when(hi <= lo, F.lit(0)).otherwise((unit * 255).cast("int"))


def contrast_stretch_array(values: Column | str, lo: Column, hi: Column) -> Column:
    return F.transform(_c(values), lambda v: contrast_stretch(v, lo, hi))


def similarity(x: Column | str, y: Column | str, *, scale: float = 1.0, angle_deg: float = 0.0,
               flip_x: bool = False, flip_y: bool = False, tx: float = 0.0, ty: float = 0.0) -> tuple[Column, Column]:
    """Flip, rotate, scale, then shift a point."""
    fx = -_c(x) if flip_x else _c(x)
    fy = -_c(y) if flip_y else _c(y)
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    return scale * (c * fx - s * fy) + tx, scale * (s * fx + c * fy) + ty


def affine(x: Column | str, y: Column | str, matrix: list[list[float]]) -> tuple[Column, Column]:
    """2x3 matrix [[a, b, tx], [c, d, ty]] applied to a point."""
    (a, b, tx), (c, d, ty) = matrix
    return a * _c(x) + b * _c(y) + tx, c * _c(x) + d * _c(y) + ty


def pad_number(n: Column | str, width: Column | int) -> Column:
    """Zero-pad to ``width`` without ever cutting a longer number."""
    s = _c(n).cast("string")
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.repeat(F.lit("0"), F.greatest(w - F.length(s), F.lit(0)).cast("int")), s)


def pad_width(n_total: Column) -> Column:
    """Digits of the largest id of ``n_total`` ids."""
    return F.length(F.greatest(n_total - 1, F.lit(0)).cast("string"))


def expected_name(pattern: Column | str, fov_id: Column | str) -> Column:
    """Fill ``{fov}`` or ``{fov:0Nd}`` of a series pattern."""
    p = _c(pattern)
    width = F.coalesce(F.nullif(F.regexp_extract(p, r"\{fov:0(\d+)d\}", 1), F.lit("")), F.lit("0")).cast("int")
    return F.replace(p, F.regexp_extract(p, r"(\{fov(?::[^}]*)?\})", 1), pad_number(fov_id, width))


def series_regex(pattern: str) -> str:
    """Anchored regular expression of a series pattern: literal parts escaped, ``{fov...}`` becomes digits."""
    parts = re.split(r"\{fov[^}]*\}", pattern)
    return "^" + r"(\d+)".join(re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", p) for p in parts) + "$"


def series_regex_column(pattern: Column | str) -> Column:
    """Column form of :func:`series_regex`, for patterns held in a table."""
    escaped = F.regexp_replace(_c(pattern), r"([\\.\[\]()*+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\{fov[^}]*\}", r"(\\d+)"), F.lit("$"))


def fov_from_name(name: Column | str, pattern: str) -> Column:
    """The FOV number of a file name, NULL when the pattern does not match."""
    return F.nullif(F.regexp_extract(_c(name), series_regex(pattern), 1), F.lit("")).cast("long")


def series_stem(pattern: Column | str) -> Column:
    """Drop a ``_{...}`` placeholder, then one trailing ``_NN`` number."""
    return F.regexp_replace(F.regexp_replace(_c(pattern), r"_\{[^}]+\}$", ""), r"_\d{2}$", "")


def reroot_path(path: Column | str, data_root: str, sample_root: str, local_prefix: str = "/") -> Column:
    """Resolve a stored folder on this system.

    A path of this system is kept. A drive or network path of another system keeps its tail after the first
    ``data`` part, under ``data_root`` (its last part when it has none). A relative path goes under ``sample_root``.
    """
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    foreign = p.rlike(r"^([A-Za-z]:/|//)")
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    at = F.array_position(parts, F.lit("data")).cast("int")
    tail = F.when(
        at > 0, F.array_join(F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0))), "/")
    ).otherwise(F.element_at(parts, -1))
    joined = F.concat_ws("/", F.lit(data_root.rstrip("/")), F.nullif(tail, F.lit("")))
    return (
        F.when(foreign, joined)
        .when(p.startswith(local_prefix), p)
        .otherwise(F.concat_ws("/", F.lit(sample_root.rstrip("/")), F.nullif(p, F.lit(""))))
    )


# fixed values: accepted spellings of a boolean
TRUE_TEXT = ["True", "true", "1", "1.0"]
FALSE_TEXT = ["False", "false", "0", "0.0"]


def coerce_bool(v: Column | str) -> Column:
    """The accepted spellings as BOOLEAN; anything else is NULL (see ``check_bool`` for the error)."""
    s = _c(v).cast("string")
    return F.when(s.isin(TRUE_TEXT), True).when(s.isin(FALSE_TEXT), False)


def strict_bool(v: Column | str) -> Column:
    """As ``coerce_bool`` but an unknown spelling is an error when evaluated; NULL stays NULL."""
    s = _c(v).cast("string")
    return F.when(s.isNull() | s.isin(TRUE_TEXT + FALSE_TEXT), coerce_bool(v)).otherwise(
        F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean")
    )
