"""Column-level housekeeping: header names, feature lists, artifacts, id columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.functions import text as T
from echotrail.functions.numbers import to_number

# Known header names and what they become (fixed values).
HEADER_NAMES = {"filepath": "audio_path", "file_path": "audio_path", "path": "audio_path", "wav_path": "audio_path",
                "duration": "duration_sec", "duration_seconds": "duration_sec", "length_sec": "duration_sec",
                "sr": "sample_rate", "sample_rate_hz": "sample_rate"}

# Acoustic feature names: prefixes and exact names (fixed values).
ACOUSTIC_PREFIXES = ("rms_", "spectral_", "mfcc_")
ACOUSTIC_EXACT = {"peak_amplitude", "mean_amplitude", "std_amplitude", "dc_offset", "zero_crossing_rate_mean",
                  "zero_crossing_rate_std", "clipping_ratio", "silence_ratio", "active_audio_ratio", "noise_floor_proxy",
                  "snr_proxy", "dynamic_range_proxy", "spectral_entropy_mean", "spectral_entropy_std",
                  "high_freq_rolloff_ratio", "bandwidth_occupied_95", "low_band_energy_ratio", "mid_band_energy_ratio",
                  "high_band_energy_ratio", "very_high_band_energy_ratio"}


def tidy_headers(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names with known aliases renamed."""
    low = [c.strip().lower() for c in df.columns]
    return df.toDF(*[HEADER_NAMES.get(c, c) for c in low])


def feature_columns(names: Sequence[str], kind: str) -> list[str]:
    """Feature columns of a table: acoustic, ssl or combined, in sorted order."""
    acoustic = sorted(n for n in names if n in ACOUSTIC_EXACT or n.startswith(ACOUSTIC_PREFIXES))
    ssl = sorted(n for n in names if n.startswith("ssl_emb_"))
    return {"acoustic": acoustic, "ssl": ssl, "combined": sorted(set(acoustic + ssl))}[kind]


def drop_artifacts(df: DataFrame, placeholders: set[str], version: str) -> DataFrame:
    """Drop placeholder and join-suffix columns and put one schema_version first."""
    bad = [n for n in df.columns if n in placeholders or n.endswith("_dup") or n.startswith("schema_version")]
    kept = df.drop(*bad)
    return kept.select(F.lit(version).alias("schema_version"), *kept.columns)


def first_filled_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate column with any non-blank value, found in one aggregation."""
    have = [x for x in candidates if x in df.columns]
    row = df.agg(*[F.count_if(T.not_blank(F.col(x).cast("string")).isNotNull()).alias(x) for x in have]).first()
    for x in have:
        if row[x]:
            return x
    raise ValueError(f"no filled id column among {list(candidates)}")


def guess_columns(names: Sequence[str], candidates: dict[str, Sequence[str]]) -> dict[str, str | None]:
    """For each role the first candidate that is a column, ignoring case."""
    low = {n.lower(): n for n in names}
    return {role: next((low[c.lower()] for c in cands if c.lower() in low), None) for role, cands in candidates.items()}


def clean_feature_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numeric features with blanks as null; all-missing and non-numeric columns go.

    One aggregation over the table decides which columns stay.
    """
    stats = df.agg(*[F.count(to_number(F.col(f))).alias(f"n_{f}") for f in features]).first()
    usable = [f for f in features if stats[f"n_{f}"] > 0]
    rest = [x for x in df.columns if x not in features]
    return df.select(*rest, *[to_number(F.col(f)).alias(f) for f in usable])


def enough_filled(columns: Sequence[str]):
    """At least max(1, n // 4) of the columns are filled."""
    present = sum(F.when(T.not_blank(F.col(x).cast("string")).isNotNull(), 1).otherwise(0) for x in columns)
    return present >= max(1, len(columns) // 4)
