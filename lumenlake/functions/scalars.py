"""Derived values of photos, collections and jobs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.functions.geo import _c

EN_DASH = "–"


_EPOCH = "1970-01-01 00:00:00"


def wall_micros(at: Column | str) -> Column:
    """Microseconds of a local wall-clock time since 1970 on the same clock, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), _c(at).cast("timestamp_ntz"))


def wall_time(micros: Column | str) -> Column:
    """The inverse of ``wall_micros``."""
    return F.timestamp_add("MICROSECOND", _c(micros), F.lit(_EPOCH).cast("timestamp_ntz"))


def effective_quality(quality: str = "quality_score", rating: str = "manual_rating") -> Column:
    """Stored quality (0.35 if null or NaN), mixed 70:30 with a rating that is neither null nor 0, within [0, 1]."""
    q, r = F.coalesce(F.nanvl(F.col(quality), F.lit(None).cast("double")), F.lit(0.35)), F.col(rating)
    mixed = F.when(r.isNotNull() & (r != 0), q * 0.7 + r / 5 * 0.3).otherwise(q)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))


def reason(prefix: str = "") -> Column:
    """Up to three traits of a photo; NaN scores reach no threshold."""
    over = lambda c, least: ~F.isnan(F.coalesce(F.col(c), F.lit(0.0))) & (F.coalesce(F.col(c), F.lit(0.0)) >= least)
    faces = F.coalesce(F.col("face_count"), F.lit(0))
    traits = F.array(
        F.when(over("sharpness_score", 0.72), "sharp"), F.when(over("exposure_score", 0.78), "balanced light"), F.when(over("color_score", 0.65), "strong color"),
        F.when(faces != 0, F.concat(faces.cast("string"), F.when(faces == 1, " face").otherwise(" faces"))), F.when(F.col("latitude").isNotNull(), "has location"),
    )
    text = F.array_join(F.slice(F.filter(traits, lambda t: t.isNotNull()), 1, 3), ", ")
    text = F.when(text == "", "representative frame").otherwise(text)
    return F.concat(F.lit(f"{prefix}: "), text) if prefix else text


def hex_distance(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hex numbers of up to 16 digits; 65 if one is null, empty or no number."""
    a, b = F.trim(_c(a)), F.trim(_c(b))
    ok = F.coalesce(a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$"), F.lit(False))

    def half(x: Column, at: int) -> Column:
        return F.conv(F.substring(F.lpad(x, 16, "0"), at, 8), 16, 10).cast("long")

    return F.when(ok, F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).otherwise(65).cast("int")


def time_label(start: Column | str, end: Column | str) -> Column:
    s, e = _c(start), _c(end)
    full = "MMM d, yyyy"
    return (
        F.when(F.to_date(s) == F.to_date(e), F.date_format(s, full))
        .when(F.year(s) == F.year(e), F.concat(F.date_format(s, "MMM d"), F.lit(f" {EN_DASH} "), F.date_format(e, full)))
        .otherwise(F.concat(F.date_format(s, full), F.lit(f" {EN_DASH} "), F.date_format(e, full)))
    )


def place_label(city: Column | str = "place_city", country: Column | str | None = None) -> Column:
    """Non-empty city and country, joined; null if neither is there."""
    parts = [F.nullif(_c(x), F.lit("")) for x in (city, country) if x is not None]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def folder(path: Column | str = "relative_path") -> Column:
    """Path up to the last slash; null for files at the root."""
    return F.nullif(F.regexp_extract(_c(path), "^(.*)/[^/]*$", 1), F.lit(""))


def folder_title(path: Column | str) -> Column:
    """Last part of a folder with separators as blanks and each run of letters capitalised."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    clean = F.trim(F.regexp_replace(name, "[_-]", " "))
    runs = F.regexp_extract_all(clean, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    title = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(title == "", name).otherwise(title)


def key_digest(text: Column | str, digits: int = 16) -> Column:
    return F.substring(F.sha1(_c(text)), 1, digits)


def cache_path(path: Column | str, kind: str = "thumbs") -> Column:
    key = F.sha1(_c(path))
    return F.concat(F.lit(f"{kind}/"), F.substring(key, 1, 2), F.lit("/"), key, F.lit(".jpg"))


def clean_text(text: Column | str, longest: int = 150) -> Column:
    """Without NUL characters and outer white space, cut at ``longest``; null if nothing is left."""
    bare = F.regexp_replace(F.replace(_c(text), F.lit("\0"), F.lit("")), r"^\s+|\s+$", "")
    return F.nullif(F.substring(bare, 1, longest), F.lit(""))


def as_float(text: Column | str) -> Column:
    """A number, or a fraction ``n/d``; null if it is none or d is 0."""
    t = F.trim(_c(text))
    parts = F.split(t, "/")
    number = F.when(F.size(parts) == 2, F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")))
    return F.when(t.contains("/"), number).otherwise(t.try_cast("double"))


def exposure_text(seconds: Column | str) -> Column:
    """``1/n`` below a second (n rounded half to even), else up to six decimals and ``s``; null stays null."""
    x = _c(seconds)
    whole = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")
    return F.when((x > 0) & (x < 1), F.concat(F.lit("1/"), F.bround(1 / x, 0).cast("long").cast("string"))).when(x.isNotNull(), F.concat(whole, F.lit("s")))


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    """Degrees, minutes and seconds as signed degrees; null if one of the numbers is."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(F.trim(reference)).isin("S", "W"), -value).otherwise(value)


def in_range(value: Column | str, top: float) -> Column:
    """The value if it is finite and within ±top, else null."""
    v = _c(value)
    return F.when(~F.isnan(v) & v.between(-top, top), v)


#: Fixed value: the times that file names may hold.
_NAMED_TIME = r"(?<!\d)((?:19|20)\d{2})[-_]?([01]\d)[-_]?([0-3]\d)[ T_-]?([0-2]\d)[-_.:]?([0-5]\d)[-_.:]?([0-5]\d)(?!\d)"


def capture_time(exif: list[Column], file_name: Column | str, mtime: Column | str) -> Column:
    """Struct ``capture_at, capture_source``: first readable EXIF time, then the name's, then the file's (UTC)."""
    read = []
    for text in exif:
        t = F.substring(clean_text(text, 40), 1, 19)
        for form in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss"):
            read.append(F.try_to_timestamp(t, F.lit(form)).cast("timestamp_ntz"))
    stem = F.regexp_replace(_c(file_name), r"(?<=.)\.[^.]*$", "")
    part = lambda k: F.regexp_extract(stem, _NAMED_TIME, k).try_cast("int")
    named = F.try_make_timestamp_ntz(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(8,6)"))
    file = wall_time((_c(mtime) * 1_000_000).cast("long"))
    from_exif = F.coalesce(*read) if read else F.lit(None).cast("timestamp_ntz")
    at = F.coalesce(from_exif, named, file)
    source = F.when(from_exif.isNotNull(), "exif").when(named.isNotNull(), "filename").when(file.isNotNull(), "mtime")
    return F.struct(at.alias("capture_at"), source.alias("capture_source"))


def unit_interval(x: Column) -> Column:
    """Null for null and NaN."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def metric_scores(laplacian_variance: Column, midpoint: Column, clipped: Column, deviation: Column, colorfulness: Column, megapixels: Column) -> dict[str, Column]:
    """Scores in [0, 1] from raw pixel statistics."""
    return {
        "sharpness_score": unit_interval(F.log1p(laplacian_variance) / F.log1p(F.lit(1200.0))),
        "exposure_score": unit_interval(0.7 * midpoint + 0.3 * (1 - clipped)),
        "contrast_score": unit_interval(deviation / 0.24),
        "color_score": unit_interval(colorfulness / 90),
        "resolution_score": unit_interval(F.log1p(megapixels) / F.log1p(F.lit(12.0))),
    }


def overall_quality(largest_face: Column | str) -> Column:
    """Weighted scores plus a bonus for the largest face's share of the picture (null: no face)."""
    weights = {"sharpness_score": 0.30, "exposure_score": 0.24, "contrast_score": 0.14, "color_score": 0.12, "resolution_score": 0.20}
    face = _c(largest_face)
    bonus = F.when(face.isNotNull(), F.least(F.lit(0.08), 0.025 + 0.25 * face)).otherwise(0.0)
    return unit_interval(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) + bonus)


def oriented_size(width: Column | str, height: Column | str, orientation: Column | str) -> Column:
    """Struct ``width, height`` after turning by EXIF orientation 5 to 8."""
    turned = _c(orientation).isin(5, 6, 7, 8)
    return F.struct(F.when(turned, _c(height)).otherwise(_c(width)).alias("width"), F.when(turned, _c(width)).otherwise(_c(height)).alias("height"))


def display_time(at: Column | str) -> Column:
    return F.coalesce(F.date_format(_c(at), "MMM d, yyyy HH:mm"), F.lit("Unknown"))


def display_bytes(size: Column | str) -> Column:
    """Binary units up to TB, one decimal above bytes."""
    s = F.coalesce(_c(size), F.lit(0)).cast("double")
    out = F.when(s == 0, "0 B").when(s < 1024, F.format_string("%.0f B", s))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(s < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", s / 1024.0**k))
    return out.otherwise(F.format_string("%.1f TB", s / 1024.0**4))


def iso_time(at: Column | str) -> Column:
    """UTC time with seconds and offset."""
    return F.date_format(_c(at), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def age_seconds(at: Column | str, now: Column) -> Column:
    """Whole seconds since ``at``, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", _c(at), now))


def progress_percent(current: Column | str, total: Column | str) -> Column:
    """Percent to one decimal, half to even; null without a total."""
    return F.when(_c(total) > 0, F.bround(_c(current) * 100.0 / _c(total), 1))


def redacted(text: Column | str, secrets: dict[str, str] | None = None, limit: int = 800) -> Column:
    """Secrets (of at least three characters, longest first) and credentials replaced, blanks collapsed, cut with an ellipsis."""
    out = _c(text)
    for secret in sorted((s for s in secrets or {} if len(s) >= 3), key=len, reverse=True):
        out = F.replace(out, F.lit(secret), F.lit(secrets[secret]))
    out = F.regexp_replace(out, r"(?i)(password|token|secret)=([^\s,;]+)", "$1=<redacted>")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit - 1), F.lit("…"))).otherwise(out)


def csv_guard(text: Column | str) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula."""
    t = _c(text)
    return F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)


def safe_file_name(title: Column | str) -> Column:
    """Letters and digits, all else as hyphens; none outside, at most 80 characters, never empty."""
    plain = F.regexp_replace(_c(title), r"[^\p{L}\p{N}]", "-")
    short = F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, 80)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("collection"))


def safe_path(path: Column | str) -> Column:
    """Path with slashes and no empty or ``.`` parts; null if absolute or with ``..``."""
    p = F.regexp_replace(_c(path), r"\\", "/")
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    return F.when(~p.startswith("/") & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))
