"""Number, density and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions.text import filled, spoken_units, strip


def relevance(distance: Column) -> Column:
    """Cosine distance 0..2 to relevance 1..0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - distance / 2.0))


def percent_to_gain(percent: Column, curve: float = fv.ORIGINAL_VOICE_CURVE) -> Column:
    share = F.least(F.greatest(F.coalesce(percent, F.lit(fv.ORIGINAL_VOICE_PERCENT)), F.lit(0.0)), F.lit(100.0))
    return F.round(F.pow(share / 100.0, F.lit(curve)), 6)


def stored_voice_percent(percent: Column) -> Column:
    """Old records carry no value and had no original voice in the mix."""
    return F.coalesce(percent.cast("double"), F.lit(0.0))


def clean_null(value: Column) -> Column:
    return F.when(~value.isin("", fv.NAN), value)


def numeric(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(clean_null(value).try_cast("double"), F.lit(default))


def duration_min(duration: Column) -> Column:
    return F.round(duration.try_cast("double") / 60.0, 3)


def run_mode(preset: Column, engine: Column, default_preset: str = "cpu") -> Column:
    p = F.lower(F.coalesce(filled(preset), F.lit(default_preset)))
    e = F.lower(F.coalesce(engine, F.lit("")))
    return (
        F.when(p.startswith("cpu"), "cpu")
        .when(p.startswith("gpu"), "gpu")
        .when(e == "omnivoice", "gpu")
        .when(e == "supertonic", "cpu")
        .otherwise(F.coalesce(filled(p), F.lit("unknown")))
    )


def natural_duration(units: Column) -> Column:
    return units / fv.TARGET_UNITS_PER_SEC


def syllable_budget(duration: Column) -> Column:
    return F.greatest(F.lit(2), F.bround(F.coalesce(duration, F.lit(0.0)) * fv.SOURCE_UNITS_PER_SEC).cast("long"))


def _ceiling(base: Column) -> Column:
    """``base`` plus the tolerated overrun."""
    return base + F.greatest(F.lit(fv.TOLERANCE_MIN).cast("long"), F.ceil(base * fv.TOLERANCE_RATIO))


def budget_label(budget: Column) -> Column:
    """``[A-B tiếng]`` for a budget; the base here has a floor of 2 and ignores the target."""
    duration = F.greatest(F.lit(0.1), budget / fv.SOURCE_UNITS_PER_SEC)
    low = F.greatest(F.lit(1).cast("long"), F.floor(duration * fv.MIN_UNITS_PER_SEC))
    base = F.greatest(F.lit(2).cast("long"), F.floor(duration * fv.MAX_UNITS_PER_SEC))
    return F.format_string("[%d-%d tiếng]", low, _ceiling(base))


def density(units: Column, duration: Column, budget: Column | None = None) -> Column:
    """Density report of a spoken text of ``units`` syllables; null fields without a positive duration.

    ``units`` should be a column of its own: the report reads it several times.
    """
    if budget is not None:
        duration = F.coalesce(
            duration,
            F.when(budget != 0, F.greatest(F.lit(0.1), budget / fv.SOURCE_UNITS_PER_SEC)),
        )
    ok = duration > 0
    low = F.greatest(F.lit(1).cast("long"), F.floor(duration * fv.MIN_UNITS_PER_SEC))
    target = F.greatest(F.lit(2).cast("long"), F.bround(duration * fv.TARGET_UNITS_PER_SEC).cast("long"))
    base = F.greatest(target, F.floor(duration * fv.MAX_UNITS_PER_SEC))
    top = _ceiling(base)
    warning = F.when(
        ok & (units > top),
        F.format_string("over_budget: %d units in %.1fs, limit %d, aim for %d-%d", units, duration, top, target, top),
    )
    return F.struct(
        F.when(ok, F.round(duration, 3)).alias("duration"),
        F.when(ok, F.round(units / duration, 3)).alias("density"),
        F.when(ok, low).alias("min_units"),
        F.when(ok, target).alias("target_units"),
        F.when(ok, top).alias("max_units"),
        F.when(ok, base).alias("base_max_units"),
        F.when(ok, top - base).alias("tolerance_units"),
        F.array_compact(F.array(warning)).alias("warnings"),
        F.array().cast("array<string>").alias("errors"),
    )


def adaptive_speed(text: Column, slot: Column, alpha: float = fv.SPEED_ALPHA) -> Column:
    """Speaking speed for a slot, clamped to the range the synthesiser accepts."""
    need = F.when(
        F.coalesce(text, F.lit("")) != "",
        natural_duration(spoken_units(text)) / F.greatest(F.lit(0.1), F.coalesce(slot, F.lit(0.0))),
    ).otherwise(F.lit(1.0))
    raw = 1.0 + F.greatest(F.lit(0.0), need - 1.0) / max(1.0, alpha)
    return F.least(F.lit(fv.SPEED_MAX), F.greatest(F.lit(fv.SPEED_MIN), raw))


def generation_slot(
    text: Column,
    duration: Column,
    alpha: float = fv.GENERATION_DELTA_ALPHA,
    min_delta: float = fv.GENERATION_DELTA_MIN,
) -> Column:
    """Seconds handed to the generator: the slot plus the part the text really needs."""
    slot = F.greatest(F.lit(fv.MIN_SPEECH_SECONDS), F.coalesce(duration, F.lit(0.0)))
    natural = natural_duration(spoken_units(strip(F.coalesce(text, F.lit("")))))
    excess = F.greatest(F.lit(0.0), natural - slot)
    return F.greatest(F.lit(fv.MIN_SPEECH_SECONDS), slot + F.greatest(F.lit(min_delta), excess * alpha))


def fit_report(raw_samples: Column, slot_samples: Column, left_over_samples: Column, sample_rate: int) -> Column:
    """How a clip fits its slot: ratio, residual trim and warning codes."""
    longer = raw_samples > slot_samples
    ratio = raw_samples / F.greatest(F.lit(1).cast("long"), slot_samples)
    trimmed = F.round(left_over_samples / sample_rate, 3)
    tier = (
        F.when(longer & (ratio > 1.75), "tempo_strong")
        .when(longer & (ratio > 1.35), "tempo_fast")
        .when(longer & (ratio > 1.15), "tempo_light")
    )
    bad_slot = slot_samples <= 0
    return F.struct(
        F.round(raw_samples / sample_rate, 3).alias("raw_duration"),
        F.round(slot_samples / sample_rate, 3).alias("target_duration"),
        F.when(longer & ~bad_slot, F.round(ratio, 3)).otherwise(F.lit(1.0)).alias("fit_ratio"),
        F.when(bad_slot, F.lit(0.0)).otherwise(trimmed).alias("trimmed_duration"),
        F.when(bad_slot, F.array(F.lit("bad_slot")))
        .otherwise(F.array_compact(F.array(tier, F.when(trimmed > 0.03, "residual_trim"))))
        .alias("warnings"),
    )


def engine_label(engine: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in fv.ENGINE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, engine), filled(engine), F.lit("unknown"))


def voice_label(engine: Column, model: Column, voice_id: Column, voices: dict[str, str], source_voice: str) -> Column:
    """Label of a preset voice; ``voices`` is the small configured id-to-label table."""
    models = F.create_map(*[F.lit(x) for pair in fv.VOICE_LABELS.items() for x in pair])
    named = F.create_map(*[F.lit(x) for pair in voices.items() for x in pair])
    return F.when(engine == "supertonic", F.try_element_at(models, model)).when(
        engine == "omnivoice",
        F.when(voice_id == source_voice, "Giọng gốc video").otherwise(F.try_element_at(named, voice_id)),
    )


def bounded_override(value: Column, low: int, high: int, default: int) -> Column:
    return F.when(value.between(low, high), value).otherwise(F.lit(default).cast("long"))


def tier_of(value: Column, tiers: dict[float, str]) -> Column:
    """Value of the greatest threshold not above ``value``; the table is a literal, so no join."""
    out = F.lit(None).cast("string")
    for threshold in sorted(tiers):
        out = F.when(value >= float(threshold), F.lit(tiers[threshold])).otherwise(out)
    return out


def log_cell(value: Column, kind: str) -> Column:
    """Run-log text of a value: ``NaN`` for null, NaN, infinite or blank; floats with 3 decimals."""
    if kind == "float":
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        text = F.when(~bad, F.format_string("%.3f", value))
    elif kind == "int":
        text = value.cast("string")
    else:
        text = filled(strip(value))
    return F.coalesce(F.when(value.isNotNull(), text), F.lit(fv.NAN))
