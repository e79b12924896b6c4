"""Paths, names, slugs and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit("\\"), F.lit("/"))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(clean_path(c), "/"), -1)


def stem(c: Column) -> Column:
    """Base name without its last extension (a leading dot is part of the name)."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def lower_stem(c: Column) -> Column:
    return F.lower(stem(c))


def name_key(c: Column) -> Column:
    """Lower stem with every run of other characters than a-z, 0-9, _ as one underscore."""
    return F.regexp_replace(F.regexp_replace(lower_stem(c), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")


def slug(c: Column, length: int) -> Column:
    s = F.regexp_replace(F.trim(c), r"[^a-zA-Z0-9._-]+", "_")
    s = F.regexp_replace(F.substring(s, 1, length), r"^_+|_+$", "")
    return F.when(s == "", "row").otherwise(s)


def not_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def stable_id(prefix: Column, index: Column, name: Column, path: Column) -> Column:
    """prefix_000001_slug, or prefix_000001_<sha256 of path> when the row has no name."""
    digits = F.when(F.length(index.cast("string")) >= 6, index.cast("string")).otherwise(
        F.lpad(index.cast("string"), 6, "0"))
    tail = F.coalesce(slug(not_blank(name), 80), F.substring(F.sha2(not_blank(path), 256), 1, 12))
    return F.concat_ws("_", slug(prefix, 80), digits, tail)


def has_any(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule with a word inside the text."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words in rules:
        out = out.when(has_any(text, words), label)
    return out.otherwise(default)


# Words in a path that give the recording's domain, source set and attack, in priority
# order (fixed values).
DOMAIN_WORDS = [
    ("synthetic", ["synthetic", "tts", "fake"]), ("broadcast", ["broadcast", "news", "tv"]),
    ("podcast", ["podcast"]), ("phone", ["phone", "call"]), ("social", ["social", "tiktok"]),
    ("studio", ["studio", "vctk"]), ("read_speech", ["librispeech", "read"]),
    ("broadcast", ["voxceleb"]),
]
DATASET_WORDS = [
    ("librispeech", ["librispeech"]), ("vctk", ["vctk"]), ("voxceleb1", ["voxceleb"]),
    ("youtube", ["youtube"]), ("synthetic", ["synthetic", "tts", "fake"]), ("manual", ["manual"]),
]
SPOOF_WORDS = ["fake", "spoof", "synthetic", "tts"]
ATTACK_WORDS = [("replay", ["replay"]), ("synthesis", ["tts", "synthesis"]),
                ("conversion", ["conversion"])]


def path_labels(path: Column) -> dict[str, Column]:
    """domain, dataset, label and attack_type inferred from a path."""
    p = F.lower(path)
    spoof = has_any(p, SPOOF_WORDS)
    return {
        "domain": first_match(p, DOMAIN_WORDS, "unknown"),
        "dataset": first_match(p, DATASET_WORDS, "unknown"),
        "label": F.when(spoof, "spoof").otherwise("bonafide"),
        "attack_type": F.when(spoof, first_match(p, ATTACK_WORDS, "synthesis")).otherwise("bonafide"),
    }


def speaker_from_name(path: Column) -> Column:
    """First spk*/speaker* part or number of 3+ digits in the stem, else a hash of the stem."""
    name = stem(path)
    parts = F.split(name, "_")
    named = lambda p: p.startswith("spk") | p.startswith("speaker")
    hits = F.filter(parts, lambda p: named(p) | p.rlike(r"^[0-9]{3,}$"))
    first = F.try_element_at(hits, F.lit(1))
    return F.coalesce(F.when(named(first), first).otherwise(F.concat(F.lit("spk_"), first)),
                      F.concat(F.lit("spk_"), F.substring(F.md5(name), 1, 8)))


# Controlled folders and the categories they stand for (fixed values).
FOLDER_CATEGORIES = ["ai_fabricated", "human_fabricated", "ai_direct", "human_direct",
                     "human_clean", "ai_replay", "human_replay", "ai_repeat", "human_repeat",
                     "ai_mixer", "human_mixer"]


def file_category(path: Column) -> Column:
    """Category from the folder after /raw/, else from words in the stem and path."""
    p = F.lower(clean_path(path))
    name = lower_stem(p)
    folder = F.regexp_extract(p, r"(?:^|/)raw/([^/]+)", 1)
    human = name.startswith("human_")
    inside = lambda *words: has_any(p, [f"/{w}/" for w in words])
    return (F.when(folder.isin(FOLDER_CATEGORIES), folder)
            .when(name.contains("fabricated"),
                  F.when(human | inside("human_fabricated"), "human_fabricated").otherwise("ai_fabricated"))
            .when(name.contains("mixer") | inside("ai_mixer", "human_mixer"),
                  F.when(name.contains("ai_") | inside("ai_mixer"), "ai_mixer").otherwise("human_mixer"))
            .when(name.contains("replay") | name.contains("repeat"),
                  F.when(human | inside("human_repeat", "human_replay"), "human_replay").otherwise("ai_replay"))
            .when(name.contains("direct") | inside("ai_direct", "human_direct", "human_clean"),
                  F.when(human | p.contains("/human_"), "human_direct").otherwise("ai_direct"))
            .otherwise("unknown"))


def expected_category(path: Column) -> Column:
    """Test category from words in a path and file name, first rule wins."""
    text = F.lower(clean_path(path))
    name = base_name(text)
    has = lambda *w: has_any(text, list(w))
    return (
        F.when(has("bad_audio_short") | name.startswith("bad_short"), "bad_audio_short")
        .when(has("bad_audio_silent") | name.startswith("bad_silent"), "bad_audio_silent")
        .when(has("bad_audio_invalid") | name.endswith(".wav.txt") | (name == "bad_invalid.wav"),
              "bad_audio_invalid")
        .when(has("fabricated") & has("ai"), "ai_fabricated")
        .when(has("fabricated") & has("human"), "human_fabricated")
        .when(has("human_clean"), "human_direct")
        .when(has("ai_replay", "ai_repeat"), "ai_replay")
        .when(has("human_replay", "human_repeat"), "human_replay")
        .when(has("ai_mixer"), "ai_mixer").when(has("human_mixer"), "human_mixer")
        .when(has("mixer", "channel"),
              F.when(has("human"), "human_mixer").when(has("ai"), "ai_mixer").otherwise("mixer_channel"))
        .when(has("replay", "repeat", "rerecord"),
              F.when(has("human"), "human_replay").when(has("ai"), "ai_replay").otherwise("replay"))
        .when(text.rlike("ai[^/]*direct"), "ai_direct")
        .when(text.rlike("human[^/]*direct"), "human_direct")
        .when(name.contains("direct") & text.rlike(r"\bai\b"), "ai_direct")
        .when(name.contains("direct") & text.rlike(r"\bhuman\b"), "human_direct")
        .otherwise("unknown"))


# Eight recording variants (fixed values).
VARIANT_KEYS = ["ai_clean", "ai_fabricated", "ai_mixer", "ai_replayed",
                "human_clean", "human_fabricated", "human_mixer", "human_replayed"]


def variant_and_base(name: Column) -> tuple[Column, Column]:
    """Variant key and 3-digit base id from names like human_001_clean; null when unknown."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    speaker = F.regexp_extract(s, r"^(human|ai)_\d+", 1)
    digits = F.regexp_extract(s, r"^(?:human|ai)_(\d+)", 1)
    base = F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0"))
    rest = F.regexp_extract(s, r"^(?:human|ai)_\d+_?(.*)$", 1)
    kind = (F.when(has_any(rest, ["fabricated", "partial_fake", "fake_20pct"]), "fabricated")
            .when(rest.contains("mixer"), "mixer").when(rest.contains("replay"), "replayed")
            .when(rest.rlike("(^|_)(clean|direct)$"), "clean"))
    key = F.when((speaker != "") & kind.isNotNull(), F.concat_ws("_", speaker, kind))
    return key, F.when(key.isNotNull(), base)


def source_group(first_id: Column, fallback: Column) -> Column:
    """Lower-cased source id, else the file name with extension and variant words taken out.

    The words come out wherever they stand, also inside longer words.
    """
    s = F.regexp_replace(F.lower(F.trim(fallback)), r"\.(wav|mp3|flac|m4a|ogg)$", "")
    s = F.regexp_replace(
        s, "(replay|mixer|mix|partial|fabricated|ai|human|clean|segment|chunk|aug|copy|version|v[0-9]+)", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[_\-/\s]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.lower(not_blank(first_id)), F.nullif(s, F.lit("")), F.lit("unknown_group"))
