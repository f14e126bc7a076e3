"""Scalar functions of the inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ellipse_area(length: Column, width: Column) -> Column:
    """F4."""
    return F.pi() / 4 * length * width


def flux_parts(code: Column) -> tuple[Column, Column, Column]:
    """base letter, partial flag (ends in p), hotspot flag (starts with hs)."""
    hot = F.coalesce(F.startswith(code, F.lit("hs")), F.lit(False))
    return F.when(hot, F.substring(code, 3, 1)).otherwise(F.substring(code, 1, 1)), F.coalesce(F.endswith(code, F.lit("p")), F.lit(False)), hot


def size_class(area_cm2: Column) -> Column:
    """cuts at 137 and 520 square centimetres (fixed values), the upper class on a cut."""
    return F.when(area_cm2 < 137, "A").when(area_cm2 < 520, "B").otherwise("C")


def digitize(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (value >= F.lit(float(e))).cast("int")
    return out


def logit(p: Column, eps: float = 1e-6) -> Column:
    """log odds of a clipped probability."""
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(c / (1 - c))


def inv_logit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def odds(p: Column, eps: float = 1e-12) -> Column:
    """F11."""
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return c / (1 - c)


def evidence_label(bf: Column) -> Column:
    """verbal label of a Bayes factor (cuts and labels are fixed values); a cut belongs to the stronger label."""
    labels = [
        (1 / 10, "strong evidence for H0 (no effect)"), (1 / 3, "moderate evidence for H0"), (1.0, "anecdotal evidence for H0"),
        (3.0, "anecdotal evidence for H1 (effect)"), (10.0, "moderate evidence for H1"), (30.0, "strong evidence for H1"), (100.0, "very strong evidence for H1"),
    ]
    out = F.when(bf.isNull(), F.lit(None).cast("string"))
    for cut, label in labels:
        out = out.when(bf < cut, label)
    return out.otherwise("extreme evidence for H1")


def jeffreys_label(bf: Column) -> Column:
    """Five verbal levels of a Bayes factor above 1 (fixed values)."""
    return F.when(bf < 3, "anecdotal").when(bf < 10, "moderate").when(bf < 30, "strong").when(bf < 100, "very strong").otherwise("extreme")


#: The metrics between 0 and 1, and those of which more is better (fixed values).
BOUNDED = ("IoU", "dice_coef", "normalized_surface_distance", "mean_epistemic_uncertainty", "mean_aleatoric_uncertainty")
MAXIMIZE = ("IoU", "dice_coef")


def base_metric(name: Column) -> Column:
    """a validation metric's own name."""
    return F.regexp_replace(name, "^val_", "")


def is_bounded(name: Column) -> Column:
    """whether a metric lies between 0 and 1."""
    return base_metric(name).isin(*BOUNDED)


def higher_is_better(name: Column) -> Column:
    """whether more of a metric is better."""
    return base_metric(name).isin(*MAXIMIZE)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """F17."""
    zone = F.floor((lon + 180) / 6) + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def safe_string(text: Column, fallback: str) -> Column:
    """F19."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(fallback))


def guarded_date(text: Column) -> Column:
    """eight digits as a date, anything else null."""
    return F.when(F.rlike(text, F.lit(r"^\d{8}$")), F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def metres_to_pixels(metres: Column, resolution: float) -> Column:
    """half-even rounding."""
    return F.bround(metres / resolution, 0).cast("int")


def elapsed_seconds(text: Column) -> Column:
    """HH:MM:SS to seconds."""
    part = F.split(text, ":")
    return part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")


def elapsed_text(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def infer_sensor(text: Column) -> Column:
    """ordered rules on the upper-cased names."""
    s = F.upper(F.coalesce(text, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words))
    return F.when(has("_AE", "AE_", " AE "), "AE").when(has("AERIAL"), "Aerial").when(has("S2", "SENTINEL-2", "SENTINEL2"), "Sentinel-2").otherwise("Other")


def infer_model(run: Column) -> Column:
    """ordered rules on the lower-cased run name."""
    s = F.lower(F.coalesce(run, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words))
    return F.when(has("terramind", "terraminf"), "FN").when(has("unet"), "UNet").when(has("swin"), "Swin").when(has("fn"), "FN").otherwise("Other")


def split_label(label: Column) -> tuple[Column, Column]:
    """F16: model and dataset of a label "model | dataset", null for other labels."""
    parts = F.split(label, r" \| ")
    two = F.size(parts) == 2
    arch = F.when(F.contains(parts[0], F.lit("Swin")), "Swin").when(F.contains(parts[0], F.lit("Terramind")), "Terramind").otherwise("U-Net")
    return F.when(two, arch), F.when(two, F.trim(parts[1]))


def date_window(day: Column, days: int, now: Column) -> tuple[Column, Column]:
    """some days around a date; the year before ``now`` where there is none."""
    step, year = F.make_interval(days=F.lit(days)), F.make_interval(days=F.lit(365))
    return F.coalesce(day - step, now - year), F.coalesce(day + step, now)


def degrees_to_metres(x: Column, y: Column, lat: Column) -> tuple[Column, Column]:
    """111320 and 110540 metres a degree (fixed values)."""
    return x * (F.lit(111320) * F.cos(F.radians(F.abs(lat)))), y * F.lit(110540.0)


def compact_number(x: Column) -> Column:
    """a power of ten such as 1e3; empty for what is not positive."""
    power = F.floor(F.log10(x)).cast("int")
    lead = F.round(x / F.pow(F.lit(10.0), power)).cast("int")
    return F.when((x > 0) & (x < float("inf")), F.concat(lead.cast("string"), F.when(power != 0, F.concat(F.lit("e"), power.cast("string"))).otherwise(""))).otherwise("")


def first_number(text: Column) -> Column:
    """the first element of a tuple in text form."""
    return F.regexp_extract(text, r"^\(?\s*([-+0-9.eE]+)", 1).try_cast("double")


def to_uint16(x: Column) -> Column:
    """times 10000, cut off at the type's ends and truncated."""
    return F.floor(F.least(F.greatest(x * 10000, F.lit(0.0)), F.lit(65535.0))).cast("int")


def log_area(area: Column) -> Column:
    """null for areas that are not positive."""
    return F.when(area > 0, F.log10(area))


def split_of(split: Column, default: str = "unknown") -> Column:
    """F30."""
    return F.coalesce(split, F.lit(default))


def assemble_time(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """F32."""
    return F.make_timestamp(year, month, day, hour, F.lit(0), F.lit(0.0))


def finite_or(x: Column, default: float) -> Column:
    """a default for null, not-a-number and infinite values."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(F.lit(default))


def carbon(km2: Column) -> Column:
    """driftwood carbon of a catchment, 3100000 tonnes over 1800000 square kilometres (fixed values)."""
    return km2 * F.lit(3100000.0) / F.lit(1800000)


def file_name(text: Column) -> Column:
    """a name that file systems take."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def slug(text: Column) -> Column:
    """lower-case letters and digits, joined by hyphens."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("item"))


def strict_log(y: Column, eps: float = 1e-12) -> Column:
    """Logarithm that clamps noise down to -1e-6 to zero and raises an error below."""
    return F.when(y < -1e-6, F.raise_error(F.lit("negative values have no logarithm")).cast("double")).otherwise(F.ln(F.greatest(y, F.lit(eps))))


def wanted_file(name: Column, suffix: str, words: list[str]) -> Column:
    """E24."""
    return F.endswith(name, F.lit(suffix)) & F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(name, w))


def pixel_centre(col: Column, row: Column, x0: float, dx: float, rx: float, y0: float, ry: float, dy: float) -> tuple[Column, Column]:
    """A pixel's centre by an affine transform."""
    return x0 + (col + 0.5) * dx + (row + 0.5) * rx, y0 + (col + 0.5) * ry + (row + 0.5) * dy


def clamped_channel(channels: Column, index: Column) -> Column:
    """A channel by number, cut off at the last one."""
    return F.element_at(channels, (F.least(F.greatest(index, F.lit(0)), F.size(channels) - 1) + 1).cast("int"))


def snap(size: Column, patch: int, window: int, levels: int) -> Column:
    """A side enlarged so that patches and windows divide it at every level."""
    need = window * 2**levels
    return (F.ceil(F.ceil(size / patch) / need) * need * patch).cast("int")


def driver_name(path: Column) -> Column:
    """Null for other extensions."""
    p = F.lower(path)
    return F.when(F.endswith(p, F.lit("tif")), "GTiff").when(F.endswith(p, F.lit("jp2")), "JP2OpenJPEG").when(F.endswith(p, F.lit("shp")), "ESRI Shapefile").when(F.endswith(p, F.lit("gpkg")), "GPKG")


def resume_epoch(text: Column) -> Column:
    """The first number of "n/m"."""
    return F.split(text, "/")[0].try_cast("int")
