"""Column functions: names, numbers, text, colours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for true and false in the languages that answers come in.
TRUE_WORDS = ("true", "yes", "y", "1", "是", "对", "排除")
FALSE_WORDS = ("false", "no", "n", "0", "否", "不", "保留")
# Fixed value: electronvolt nanometres.
EV_NM = 1239.842


def canonical(name: Column, aliases: Mapping[str, str]) -> Column:
    """A name without case, blanks and marks, looked up among aliases; unknown ones stay as cleaned."""
    clean = F.regexp_replace(F.lower(F.trim(name)), r"[\s_\-]+", "")
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(known, clean), clean)


def as_bool(word: Column) -> Column:
    w = F.lower(F.trim(word.cast("string")))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def confidence(value: Column) -> Column:
    """A number from 0 to 1; what is none counts as 0."""
    x = F.coalesce(F.expr("null").cast("double") if value is None else value.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(x), 0.0).otherwise(x)))


def json_part(text: Column) -> Column:
    """The outermost braces of a text, for answers with words around a JSON object; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def human_bytes(n: Column) -> Column:
    """A size in the largest unit that it fills, to a tenth, halves to even."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(
            n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(1024**power)), 1)), F.lit(f" {unit}"))
        ).otherwise(out)
    return out


def wavelength_to_energy(nm: Column) -> Column:
    return F.try_divide(F.lit(EV_NM), nm)


def vertex(left: Column, middle: Column, right: Column) -> Column:
    """Sub-sample place of a parabola's top through three samples; 0 where they do not bend."""
    bend = left - 2 * middle + right
    return F.when(F.abs(bend) < 1e-12, 0.0).otherwise(F.try_divide(0.5 * (left - right), bend))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def shape_of(name: Column) -> Column:
    """A name with each run of digits as one mark."""
    return F.regexp_replace(name, "[0-9]+", "#")


def grid_place(name: Column) -> tuple[Column, Column]:
    """Row and column of a name like ``mosaic_r12_c3``; null without them."""
    part = lambda i: F.nullif(F.regexp_extract(name, r"_r(\d+)_c(\d+)", i), F.lit("")).cast("int")
    return part(1), part(2)


def gauss(x: Column, centre: Column, width: Column, height: Column) -> Column:
    return height * F.exp(-F.pow(x - centre, 2) / (2.0 * F.pow(width, 2)))


def area_mm2(pixels: Column, um_per_px: float) -> Column:
    return pixels * (um_per_px * um_per_px / 1e6)


def apply_gain(value: Column, gain: Column) -> Column:
    """Half-even rounding, clamped to a byte."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(value * gain))).cast("int")


def canonical_hash(columns: Sequence[Column | str]) -> Column:
    """SHA-256 of the columns as JSON, keys in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def redact_map(m: Column, secret: str = r"(?i)(secret|token|password|key)") -> Column:
    return F.map_filter(m, lambda k, v: ~k.rlike(secret))


def parse_stamp(stamp: Column) -> Column:
    """Local folder stamps ``YYYYmmdd_HHMMSS``; null if it is none."""
    return F.try_to_timestamp(F.regexp_extract(stamp, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))


def nfc(text: Column) -> Column:
    """Unicode normal form C, in Arrow batches: the JVM side has no function for it."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return normal(text)


def region_key(sample: Column, x: Column, y: Column, area: Column) -> Column:
    """The identity of a region: its sample, its middle to a tenth, and its area."""
    return F.struct(sample.alias("sample"), F.round(x, 1).alias("x"), F.round(y, 1).alias("y"), area.alias("area"))


def safe_number(text: Column, default: float | None = 0.5) -> Column:
    """A finite number, or the default."""
    x = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.lit(default).cast("double"))


def safe_int(text: Column, default: int = 0) -> Column:
    """A number's whole part, or the default."""
    return F.coalesce(safe_number(text, None).cast("long"), F.lit(default).cast("long"))


def direction(x: Column) -> Column:
    return F.signum(x).cast("int")


def countable(decision: Column) -> Column:
    """Whether an answer's decision can be counted: a word for true or for false."""
    return as_bool(decision).isNotNull()


def parse_utc(text: Column) -> Column:
    """A time in ISO form as UTC: without a zone it counts as UTC; null if it is none."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def local_date(text: Column) -> Column:
    """The date as written, whatever the zone; null if it is none."""
    return F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def now_utc() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_share(x: Column) -> Column:
    return F.format_string("%.2f %%", F.bround(100.0 * x, 2))


def readback(value: Column, status: Column) -> Column:
    """A value with its status, or the status alone where there is no value."""
    return F.when(value.isNull(), status).otherwise(F.concat(value, F.when(status != "", F.concat(F.lit(" ("), status, F.lit(")"))).otherwise("")))


def report_line(name: str, n: str, matched: str) -> Column:
    return F.format_string("container %s: %d files, %d matched (%.1f %%)", F.col(name), F.col(n), F.col(matched), 100.0 * F.col(matched) / F.col(n))


def grid_step(field: Column, overlap: Column) -> Column:
    """The step that leaves an overlap of a field of view, rounded half to even."""
    return F.rint(field - overlap).cast("long")


def box_key(sample: Column, x0: Column, x1: Column, y0: Column, y1: Column, area: Column) -> Column:
    return region_key(sample, (x0 + x1) / 2.0, (y0 + y1) / 2.0, area.cast("long"))


def two_peaks(x: Column, first: tuple[Column, Column, Column], second: tuple[Column, Column, Column], ground: tuple[Column, Column, Column]) -> Column:
    """Two Gaussians ``(centre, width, height)`` on a quadratic ground."""
    return gauss(x, *first) + gauss(x, *second) + ground[0] + ground[1] * x + ground[2] * x * x


def inside(path: Column) -> Column:
    """A relative path in plain form; null for one that is absolute or leads out of its folder."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda done, p: F.when(done.isNull(), done).when(p == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))).otherwise(F.concat(done, F.array(p)))
    plain = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~path.startswith("/") & plain.isNotNull(), F.array_join(plain, "/"))
