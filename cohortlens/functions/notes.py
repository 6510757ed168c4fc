"""Reading and writing patient notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import exprs as X


def _found(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL (not empty text) without one."""
    c = X.col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def age_from_note(c: Column | str) -> Column:
    """``N-year-old``, else ``N-month-old`` in years rounded half to even."""
    years = _found(c, r"(?i)\b(\d{1,3})-year-old\b").cast("int")
    months = X.half_even_div(_found(c, r"(?i)\b(\d{1,2})-month-old\b").cast("int"), 12)
    return F.coalesce(years, months)


def years_from_note(c: Column | str) -> Column:
    return _found(c, r"(?i)\b(\d{1,3})-year-old\b").cast("int")


def sex_from_note(c: Column | str) -> Column:
    """Male words are looked for first."""
    low = F.lower(X.col(c))
    return F.when(low.rlike(r"\b(man|boy|male)\b"), "male").when(
        low.rlike(r"\b(woman|girl|female)\b"), "female")


def diagnosis_from_keywords(c: Column | str, rules=K.DIAGNOSIS_RULES) -> Column:
    """First rule all of whose words occur."""
    low = F.lower(X.col(c))
    hits = []
    for diagnosis, keywords in rules:
        cond = F.lit(True)
        for word in keywords:
            cond = cond & low.contains(word)
        hits.append(F.when(cond, F.lit(diagnosis)))
    return F.coalesce(*hits)


def diagnosis_from_note(c: Column | str) -> Column:
    raw = F.coalesce(*[_found(c, p) for p in K.NOTE_DIAGNOSIS_PATTERNS])
    return F.when(raw.isNotNull(), F.regexp_replace(X.squeeze(raw), r"\.+$", ""))


def stage_from_note(c: Column | str) -> Column:
    hit = _found(c, r"(?i)stage (?:is recorded as )?(iv|iii|ii|i|4|3|2|1)\b")
    return F.upper(X.norm_stage(hit))


def ecog_from_note(c: Column | str) -> Column:
    return _found(c, r"(?i)\bECOG performance status is\s*([0-5])\b").cast("int")


def negated(text: Column | str, phrase: str) -> Column:
    """A negator up to 80 characters before the phrase, or an absence word after it."""
    t, p = X.col(text), re.escape(phrase)
    gap = f"[^.]{{0,{K.NEGATION_WINDOW}}}"
    return t.rlike(K.NEGATORS + gap + p) | t.rlike(p + gap + K.ABSENCE_WORDS)


def _map_of(entries: list[tuple[str, Column]], value_type: str) -> Column:
    """Map of the entries whose value is not NULL."""
    full = F.create_map(*[x for k, v in entries for x in (F.lit(k), v)])
    return F.map_filter(full, lambda k, v: v.isNotNull()).cast(f"map<string,{value_type}>")


def biomarkers_from_note(c: Column | str) -> Column:
    entries: dict[str, Column] = {}
    for marker in K.NOTE_BIOMARKERS:
        hit = _found(c, rf"(?i)\b{re.escape(marker)}\b[^.]*?({K.NOTE_BIOMARKER_VALUES})")
        name = "PD-L1" if marker == "PDL1" else marker
        entries[name] = F.coalesce(hit, entries[name]) if name in entries else hit
    return _map_of(list(entries.items()), "string")


def flags_from_note(c: Column | str) -> Column:
    low = F.lower(X.col(c))
    entries = []
    for flag in K.CANONICAL_FLAGS:
        phrase = flag.replace("_", " ")
        entries.append((flag, F.when(low.contains(phrase), ~negated(low, phrase))))
    return _map_of(entries, "boolean")


def platinum_from_text(c: Column | str) -> Column:
    low = F.lower(X.col(c))
    return F.when(low.contains("platinum"), ~negated(low, "platinum"))


def prior_from_note(c: Column | str) -> Column:
    low = F.lower(X.col(c))
    none = low.contains("no prior systemic therapy") | low.contains(
        "prior systemic therapy is not listed")
    known = F.coalesce(platinum_from_text(c), F.when(none, F.lit(False)))
    return _map_of([("prior_platinum_chemotherapy", known)], "boolean")


def location_from_note(c: Column | str) -> Column:
    state = _found(c, r"receives care in ([A-Z]{2})\b")
    return F.when(
        state.isNotNull(), F.create_map(F.lit("country"), F.lit("US"), F.lit("state"), state)
    ).otherwise(F.create_map().cast("map<string,string>"))


def extract_facts(notes: DataFrame, note: str = "note") -> DataFrame:
    """Facts a free note states.  One row in, one row out; no shuffle."""
    return notes.select("patient_id", *_fact_columns(note))


@X.reused
def _fact_columns(note: str) -> list[Column]:
    return [
        years_from_note(note).alias("age"),
        sex_from_note(note).alias("sex"),
        diagnosis_from_note(note).alias("diagnosis"),
        stage_from_note(note).alias("stage"),
        ecog_from_note(note).alias("ecog"),
        biomarkers_from_note(note).alias("biomarkers"),
        prior_from_note(note).alias("prior_treatments"),
        flags_from_note(note).alias("flags"),
        location_from_note(note).alias("location"),
        F.col(note).alias("source_note"),
    ]


def fact_summary() -> Column:
    """One line of the core facts that are known."""
    parts = []
    for name in ("age", "sex", "diagnosis", "stage", "ecog"):
        c = F.col(name).cast("string")
        parts.append(F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}="), c)))
    line = F.concat_ws(", ", *parts)
    return F.when(line == "", F.lit("No core patient facts were deterministically extracted.")
                  ).otherwise(line)


def is_oncology(c: Column | str) -> Column:
    low = F.lower(X.text_or_empty(c))
    cond = F.lit(False)
    for word in K.ONCOLOGY_WORDS:
        cond = cond | low.contains(word)
    return cond


@X.reused
def render_note(position: str = "patient_pos") -> Column:
    """Templated note of a structured patient; a note that exists is kept.

    Wording depends on whether the diagnosis is oncological and on an even or odd position.
    """
    onc = is_oncology("diagnosis")
    even = X.col(position) % 2 == 0
    prefix = (
        F.when(onc & even, "Oncology referral note").when(onc, "Tumor board intake")
        .when(even, "Clinical referral note").otherwise("Clinical intake")
    )
    known = F.col("age").isNotNull() & F.col("sex").isNotNull()
    who = F.when(known, F.concat(F.col("age").cast("string"), F.lit("-year-old "), F.col("sex"))
                 ).otherwise(F.lit("Adult patient"))
    has_dx = X.blank_to_null("diagnosis").isNotNull()
    dx = F.when(has_dx, F.concat(F.lit("with "), F.col("diagnosis"))).otherwise(
        F.lit("with diagnosis not clearly documented"))
    head = F.concat(prefix, F.lit(": "), F.col("patient_id"), F.lit(" is a "), who, F.lit(" "),
                    dx, F.lit("."))
    stage = F.when(
        X.blank_to_null("stage").isNotNull(),
        F.concat(F.lit("Stage is recorded as "), F.col("stage"), F.lit(".")),
    ).when(onc, F.lit("No formal stage is documented."))
    ecog = F.when(F.col("ecog").isNull(), F.lit("ECOG performance status is not documented.")
                  ).otherwise(F.concat(F.lit("ECOG performance status is "),
                                       F.col("ecog").cast("string"), F.lit(".")))
    has_bio = F.size("biomarkers") > 0
    listed = F.array_join(F.transform(
        F.map_entries("biomarkers"), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ", ")
    bio = F.when(has_bio, F.concat(F.lit("Molecular testing shows "), listed, F.lit("."))).when(
        onc, F.lit("Molecular testing results are not available in the note."))
    prior = F.when(
        F.size("prior_treatments") > 0,
        F.concat(F.lit("Prior therapy includes "), F.array_join("prior_treatments", ", "),
                 F.lit(".")),
    ).when(onc, F.lit("No prior systemic therapy is listed in the referral."))
    flags = F.when(F.size("flags") == 0,
                   F.lit("No explicit exclusion comorbidities are addressed.")).otherwise(
        F.array_join(F.transform(F.map_entries("flags"), lambda e: F.when(
            e["value"], F.concat(F.lit("The note reports "), X.spaced(e["key"]), F.lit("."))
        ).otherwise(F.concat(F.lit("No "), X.spaced(e["key"]), F.lit(" is reported.")))), " "))
    state = F.try_element_at("location", F.lit("state"))
    place = F.when(F.length(state) > 0,
                   F.concat(F.lit("The patient receives care in "), state, F.lit(".")))
    text = F.concat_ws(" ", head, stage, ecog, bio, prior, flags, place, F.lit(K.NOTE_CLOSING))
    return F.coalesce(F.nullif(F.col("clinical_note"), F.lit("")), text)


def _starting(items: Column, lead: str) -> Column:
    return F.filter(items, lambda x: F.lower(x).startswith(lead))


def listed_biomarkers(c: Column | str) -> Column:
    """Markers of a ``Molecular testing shows …`` sentence; a later mention wins."""
    body = _found(c, r"(?i)Molecular testing shows\s+([^.]*)\.")
    items = F.split(body, r"\s*,\s*")
    entries = []
    for marker in K.LISTED_BIOMARKERS:
        hit = _starting(items, marker.lower() + " ")
        value = F.try_element_at(hit, F.lit(-1))
        entries.append((marker, X.strip(F.substring(value, len(marker) + 1, 1 << 30))))
    return _map_of(entries, "string")


def listed_prior_treatments(c: Column | str) -> Column:
    body = _found(c, r"(?i)Prior therapy includes\s+([^.]*)\.")
    items = F.transform(F.split(body, r"\s*,\s*"), X.strip)
    return X.string_list(F.filter(items, lambda x: x != ""))


def reported_flags(c: Column | str) -> Column:
    c = X.col(c)
    entries = []
    for flag in K.CANONICAL_FLAGS:
        phrase = re.escape(flag.replace("_", " "))
        entries.append((flag, F.when(c.rlike(f"(?i)No {phrase} is reported"), F.lit(False)).when(
            c.rlike(f"(?i)reports {phrase}"), F.lit(True))))
    return _map_of(entries, "boolean")


def right_wins(left: Column, right: Column) -> Column:
    """Map union where the right side wins a shared key (safe under any dedup policy)."""
    only_left = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(only_left, right)


def overlay_note_facts(extraction: DataFrame, note: str = "note") -> DataFrame:
    """Given facts completed from the note; note-derived biomarkers and flags win."""
    return extraction.select("patient_id", *_overlay_columns(note))


@X.reused
def _overlay_columns(note: str) -> list[Column]:
    n = F.col(note)
    pair = r"(?i)\b(\d{2,3})-year-old\s+(female|male)\b"
    dx = X.strip(_found(n, r"(?i)\bwith\s+([^.;]+?)(?:\.| Stage| No formal stage)"))
    stage = X.strip(_found(n, r"(?i)\bStage is recorded as\s+([A-Za-z0-9]+)"))
    ecog = _found(n, r"(?i)\bECOG performance status is\s+(\d+)").cast("int")
    return [
        F.coalesce("age", _found(n, pair, 1).cast("int")).alias("age"),
        F.coalesce(F.col("sex"), F.lower(_found(n, pair, 2))).alias("sex"),
        F.coalesce(F.nullif("diagnosis", F.lit("")), dx).alias("diagnosis"),
        F.coalesce(F.nullif("stage", F.lit("")), stage).alias("stage"),
        F.coalesce("ecog", ecog).alias("ecog"),
        right_wins(X.string_map("biomarkers"), listed_biomarkers(n)).alias("biomarkers"),
        F.array_distinct(F.concat(X.string_list("prior_treatments"), listed_prior_treatments(n)))
        .alias("prior_treatments"),
        right_wins(X.bool_map("flags"), reported_flags(n)).alias("flags"),
        F.lit(True).alias("local_validator_applied"),
    ]
