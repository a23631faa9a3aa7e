"""Small SQL expressions shared by the DuckDB twins."""

from __future__ import annotations

from cuewright import fixed_values as fv


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def seg_text(vi: str = "text_vi", tts: str = "text_tts", text: str = "text") -> str:
    return (
        f"CASE WHEN {vi} <> '' THEN {strip(vi)} WHEN {tts} <> '' THEN {strip(tts)} "
        f"ELSE {strip(f'replace(coalesce({text}, {chr(39)*2}), chr(10), {chr(39)} {chr(39)})')} END"
    )


def fmt_time(x: str) -> str:
    return f"printf('%02d:%02d', floor(greatest({x}, 0))::BIGINT // 60, floor(greatest({x}, 0))::BIGINT % 60)"


def cue_time(x: str) -> str:
    return (
        f"printf('%02d:%02d:%06.3f', floor(({x}) / 3600)::BIGINT, floor((({x}) % 3600) / 60)::BIGINT, (({x}) % 60)::DOUBLE)"
    )


def units(x: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(regexp_extract_all(replace(coalesce({x}, ''), '-', ' '), "
        "'[\\p{L}\\p{N}_À-ỹ]+'), lambda t: CASE WHEN regexp_matches(t, '[À-ỹ]') THEN 1 "
        "ELSE greatest(1, len(regexp_extract_all(t, '[aeiouyAEIOUY]+'))) END)), 0)::BIGINT"
    )


def density_cols(text: str, duration: str) -> str:
    """Density report columns for a duration expression (budget already folded in)."""
    target = f"greatest(2, round_even({duration} * {fv.TARGET_UNITS_PER_SEC}::DOUBLE, 0)::BIGINT)"
    base = f"greatest({target}, floor({duration} * {fv.MAX_UNITS_PER_SEC}::DOUBLE)::BIGINT)"
    tol = f"greatest({fv.TOLERANCE_MIN}, ceil({base} * {fv.TOLERANCE_RATIO}::DOUBLE)::BIGINT)"
    ok = f"{duration} > 0"
    return (
        f"CASE WHEN {ok} THEN round({duration}, 3) END AS duration, "
        f"CASE WHEN {ok} THEN round({units(text)} / {duration}, 3) END AS density, "
        f"CASE WHEN {ok} THEN greatest(1, floor({duration} * {fv.MIN_UNITS_PER_SEC}::DOUBLE)::BIGINT) END AS min_units, "
        f"CASE WHEN {ok} THEN {target} END AS target_units, "
        f"CASE WHEN {ok} THEN {base} END AS base_max_units, "
        f"CASE WHEN {ok} THEN {tol} END AS tolerance_units, "
        f"CASE WHEN {ok} THEN {base} + {tol} END AS max_units, "
        f"coalesce({ok} AND {units(text)} > {base} + {tol}, false) AS over_budget"
    )
