"""Time codes, names, levels and encodings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clock(seconds: Column, unit: int) -> tuple[Column, Column, Column, Column]:
    """Hours, minutes, seconds and the fraction in units; negative times are 0; the fraction is held, never carried."""
    t = F.greatest(seconds.cast("double"), F.lit(0.0))
    part = F.least(F.round((t - F.floor(t)) * unit).cast("long"), F.lit(unit - 1))
    return (t / 3600).cast("long"), ((t % 3600) / 60).cast("long"), t.cast("long") % 60, part


def ass_time(seconds: Column) -> Column:
    h, m, s, c = _clock(seconds, 100)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, c)


def vobsub_time(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d:%03d", *_clock(seconds, 1000))


def srt_time(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(seconds, 1000))


def shifted(seconds: Column, hundredths: int) -> Column:
    return seconds + F.lit(hundredths * 0.01)


def rounded(value: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.round(value * scale) / scale


def image_number(name: Column) -> Column:
    """The number in 'subtitle_<number>[_part].<ext>', null for other names."""
    digits = F.regexp_extract(name, r"^subtitle_([0-9]+)", 1)
    return F.when(name.rlike(r"^subtitle_[0-9]+([_.].*)?$"), digits).try_cast("bigint")


def level(name: Column) -> Column:
    """A known level as it is, anything else (null too) as INFO."""
    return F.when(name.isin("ERROR", "WARN", "DEBUG"), name).otherwise(F.lit("INFO"))


def image_extension(name: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.trim(name), r"^\.+", ""))
    return F.when(bare.isin("jpg", "jpeg"), F.lit("jpg")).when(bare == "bmp", F.lit("bmp")).otherwise(F.lit("png"))


def resize_filter(name: Column) -> Column:
    bare = F.lower(F.trim(name))
    return (
        F.when(bare == "nearest", F.lit("nearest"))
        .when(bare.isin("triangle", "bilinear"), F.lit("triangle"))
        .when(bare.isin("catmullrom", "bicubic"), F.lit("catmullrom"))
        .when(bare == "gaussian", F.lit("gaussian"))
        .otherwise(F.lit("lanczos3"))
    )


#: Extension and media type.
MEDIA_TYPES = {
    "png": "image/png",
    "ass": "text/plain; charset=utf-8",
    "sub": "application/octet-stream",
    "idx": "text/plain; charset=utf-8",
    "json": "application/json",
}


def media_type(path: Column) -> Column:
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream"))


def base64_text(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), r"\s", "")


def log_line(ts: Column, lvl: Column, msg: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] ["), level(lvl), F.lit("] "), msg)
