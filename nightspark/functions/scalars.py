"""Column expressions: parsing, labels, bins, quality ranges, reactivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightspark import config as C


def out_of_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """True when null or outside the inclusive bounds."""
    if low is None and high is None:
        raise ValueError("range check needs at least one bound")
    bad = value.isNull()
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return F.coalesce(bad, F.lit(True))


def clean(value: Column, invalid: Column) -> Column:
    return F.when(~invalid, value.cast("double"))


def collapse_stage(stage: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for raw, name in C.STAGE_NAMES.items():
        out = out.when(stage == raw, F.lit(name))
    return out


def parse_ampm_seconds(text: Column) -> Column:
    """Seconds since midnight of ``h:mm:ss AM/PM`` (narrow and plain NBSP allowed)."""
    plain = F.trim(F.translate(text, "\u202f\u00a0", "  "))
    shape = r"^(\d{1,2}):(\d{2}):(\d{2})\s*([AaPp][Mm])$"
    part = lambda i: F.regexp_extract(plain, shape, i)
    hour = part(1).try_cast("int")
    half_day = F.when(F.upper(part(4)) == "PM", 12).otherwise(0)
    hour24 = F.when(hour == 12, half_day).otherwise(hour + half_day)
    return hour24 * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("int")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds (double) between two zone-less timestamps, whatever the session's zone."""
    elapsed = later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")
    return elapsed.cast("interval second").cast("decimal(20,6)").cast("double")


def add_seconds(ts: Column, seconds: Column) -> Column:
    """A zone-less timestamp some seconds later."""
    return ts.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def parse_datetime(text: Column, formats: Sequence[str]) -> Column:
    """First format that parses, else null; a clock time that the session's zone skips is kept as it is."""
    at = F.coalesce(*[F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{f} xx")) for f in formats])
    return add_seconds(F.lit("1970-01-01"), F.unix_micros(at).cast("decimal(20,0)") / 1000000)


def parse_birthdate(text: Column, pivot: int = 25) -> tuple[Column, Column]:
    """(date or null, audit flag): d/m/y; two-digit years up to ``pivot`` are 20yy.

    The flag is 1 only for two-digit years that land in 2000 or later.
    """
    parts = F.split(F.trim(text), "/")
    year_text = F.trim(F.get(parts, F.lit(2)))
    day, month = (F.trim(F.get(parts, F.lit(i))).try_cast("int") for i in (0, 1))
    year = year_text.try_cast("int")
    short = F.length(year_text) <= 2
    full = F.when(short & (year <= pivot), year + 2000).when(short, year + 1900).otherwise(year)
    iso = F.format_string("%04d-%02d-%02d", full, month, day)
    whole = (F.size(parts) == 3) & day.isNotNull() & month.isNotNull() & full.isNotNull()
    date = F.when(whole, F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))
    flag = F.when(date.isNotNull() & short & (full >= 2000), 1).otherwise(0)
    return date, flag


def record_id(content_sha: Column, started_iso: Column) -> Column:
    return F.concat(F.lit("NR_"), F.substring(F.md5(F.concat_ws("|", content_sha, started_iso)), 1, 10))


def safe_ratio(num: Column, den: Column, offset: float = 0.0) -> Column:
    """num / (den + offset); 0 when an input is null or the divisor is ~0."""
    d = den + F.lit(offset)
    return F.coalesce(F.when(F.abs(d) < 1e-6, F.lit(0.0)).otherwise(num / d), F.lit(0.0))


def reactivity_components(
    drop_pct: Column, baseline_spo2: Column, delta_hr: Column, baseline_hr: Column,
    peak_mov: Column, baseline_mov: Column,
) -> dict[str, Column]:
    return {
        "ird_spo2_comp": safe_ratio(drop_pct, baseline_spo2),
        "ird_hr_comp": safe_ratio(delta_hr, F.coalesce(baseline_hr, F.lit(0.0))),
        "ird_mov_comp": safe_ratio(peak_mov - baseline_mov, baseline_mov, 0.01),
    }


def reactivity_score(spo2: Column, hr: Column, mov: Column, weights: Mapping[str, float] = C.IRD_WEIGHTS) -> Column:
    return weights["spo2"] * spo2 + weights["hr"] * hr + weights["mov"] * mov


def severity_right_closed(value: Column, labels: Sequence[str]) -> Column:
    """(-1,5], (5,15], (15,30], (30,999]; outside is null."""
    a, b, c, d = labels
    return (
        F.when((value > -1) & (value <= 5), a).when((value > 5) & (value <= 15), b)
        .when((value > 15) & (value <= 30), c).when((value > 30) & (value <= 999), d)
    )


def severity_left_closed(value: Column, labels: Sequence[str]) -> Column:
    """<5, <15, <30, rest; null stays null."""
    a, b, c, d = labels
    return F.when(value < 5, a).when(value < 15, b).when(value < 30, c).when(value.isNotNull(), d)


def label_of(prefix: str, index: Column) -> Column:
    return F.when(index >= 0, F.concat(F.lit(prefix), index.cast("string")))


def index_of(label: Column) -> Column:
    """Trailing digits of a label as a number (S3 -> 3)."""
    return F.regexp_extract(label, r"(\d+)$", 1).try_cast("int")


def greek_of(index: Column) -> Column:
    return F.when(index >= 0, F.get(F.array(*[F.lit(g) for g in C.GREEK]), index))


def severe_label(label: Column) -> Column:
    """C4 and C5 are the severe curve labels; null stays null."""
    return label.isin("C4", "C5")


def low_high(label: Column) -> Column:
    return F.when(label.isNotNull(), F.when(severe_label(label), "high").otherwise("low"))


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    metres = height_cm / 100.0
    return weight_kg / F.nullif(metres * metres, F.lit(0.0))


def normalize_sex(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("m", "masculino"), "M").when(t.isin("f", "femenino"), "F").otherwise("")


def to_int_string(text: Column) -> Column:
    """'72.0' -> '72'; unparsable or blank -> ''."""
    return F.coalesce(F.trim(text).try_cast("double").try_cast("long").cast("string"), F.lit(""))


def risk_score(mean_event_p: Column, p99: Column, top: Column, night_p: Column) -> Column:
    """100 * (0.4 * min(p, p99) / max + 0.6 * night p), clipped to 0..100, 1 decimal."""
    part = F.least(mean_event_p, p99) / F.nullif(top, F.lit(0.0))
    raw = 100.0 * (0.4 * part + 0.6 * night_p)
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 1)


def risk_label(score: Column, labels: Sequence[str] = ("low", "moderate", "high", "unknown")) -> Column:
    return F.when(score.isNull(), labels[3]).when(score < 30, labels[0]).when(score < 60, labels[1]).otherwise(labels[2])


def gain(delta: Column, drop: Column) -> Column:
    """delta / drop, null for a zero drop."""
    return delta / F.nullif(drop, F.lit(0.0))


def entropy_term(p: Column) -> Column:
    """-p log2 p with 0 log 0 = 0, ready for a sum."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
