"""Protocol text: cleaning, section splitting and what can be inferred from it."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K
from . import exprs as X


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """Character references to characters.  There is no built-in expression for it."""
    return texts.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


@F.pandas_udf(StringType())
def html_unescape_closed(texts: pd.Series) -> pd.Series:
    """As :func:`html_unescape`, but only references closed by ``;``: in pages with texts that were cut off,
    the rest of one (``&amp``) is text."""
    def one(m):
        return html.unescape(m[0]) if m[1].startswith("#") or m[1] in html5 else m[0]
    return texts.map(lambda t: _CLOSED.sub(one, t), na_action="ignore")


def ascii_text(c: Column | str) -> Column:
    """Comparison signs and dashes to ASCII, other non-ASCII dropped, blanks squeezed."""
    t = X.text_or_empty(c)
    t = F.replace(F.replace(t, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    t = F.translate(t, "–—−", "---")
    t = F.regexp_replace(t, r"[^\x00-\x7F]", "")
    return X.strip(F.regexp_replace(t, r"[ \t]+", " "))


def clean_text(c: Column | str, *, closed: bool = False) -> Column:
    """:func:`ascii_text` after unescaping; ``closed`` leaves references without ``;`` alone."""
    unescape = html_unescape_closed if closed else html_unescape
    return ascii_text(unescape(X.text_or_empty(c)))


def age_years(c: Column | str) -> Column:
    """Age limit in years: months round half to even, weeks and days give 0."""
    t = X.blank_to_null(c)
    n = F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")).cast("int")
    low = F.lower(t)
    return (F.when(t.isNull() | (F.upper(t) == "N/A") | n.isNull(), F.lit(None).cast("int"))
            .when(low.contains("month"), X.half_even_div(n, 12))
            .when(low.contains("week") | low.contains("day"), F.lit(0)).otherwise(n))


def sex_label(c: Column | str) -> Column:
    return X.label_in(c, ["female", "male"], "all")


def section_lines(c: Column | str, *, inclusion: str = "inclusion criteria",
                  exclusion: str = "exclusion criteria", cap: int | None = None) -> Column:
    """``struct(inclusion, exclusion)`` lists of a criteria text's lines, all unless ``cap`` is given.

    A line with a section phrase starts that section and is dropped.  The text is cut right
    before every such line, so a piece's section is known from its own first line and the
    whole text is read once, in its row: no window and no shuffle.
    """
    breaks = "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
    t = F.regexp_replace(X.text_or_empty(c), breaks, "\n")
    head = f"(?im)^(?=[^\n]*(?:{inclusion}|{exclusion}))"
    pieces = F.split(t, head)

    def lines(piece):
        raw = F.transform(F.split(piece, "\n"), lambda s: F.btrim(s, F.lit(" -*\t")))
        return F.filter(raw, lambda s: (F.length(s) >= K.SECTION_MIN_CHARS)
                        & ~F.lower(s).rlike(f"{inclusion}|{exclusion}"))

    def is_exclusion(piece):
        first = F.lower(F.substring_index(piece, "\n", 1))
        return F.contains(first, F.lit(exclusion)) & ~F.contains(first, F.lit(inclusion))

    def section(excluded):
        mine = F.filter(pieces, lambda p: is_exclusion(p) if excluded else ~is_exclusion(p))
        flat = F.flatten(F.transform(mine, lines))
        return flat if cap is None else F.slice(flat, 1, cap)
    return F.struct(section(False).alias("inclusion"), section(True).alias("exclusion"))


def _listed(hits: list[Column]) -> Column:
    return F.array_compact(F.array(*hits))


def _any_match(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda s: s.rlike(pattern))


def allowed_stages(c: Column | str) -> Column:
    """Stages named in ``STAGE …`` segments; advanced or metastatic disease adds IV."""
    up = F.upper(X.text_or_empty(c))
    segments = F.regexp_extract_all(up, F.lit(K.STAGE_SEGMENT), F.lit(0))
    hits = []
    for stage in K.STAGES:
        cond = _any_match(segments, rf"\b{stage}(?:A|B|C)?\b")
        if stage == "IV":
            cond = cond | up.contains("ADVANCED") | up.contains("METASTATIC")
        hits.append(F.when(cond, F.lit(stage)))
    return _listed(hits)


def max_ecog(c: Column | str) -> Column:
    found = F.regexp_extract_all(X.text_or_empty(c), F.lit(K.ECOG_LIMIT), F.lit(1))
    return F.array_max(F.transform(found, lambda d: d.cast("int")))


def required_biomarkers(c: Column | str, *, merge: bool = False) -> Column:
    """Required value per marker: the first pattern found without a negation before it.

    Only a pattern's first match is looked at.  ``merge`` joins the two specific EGFR values
    when both occur (``L858R_or_exon19del``) instead of keeping the first.
    """
    low = F.lower(X.text_or_empty(c))

    def value(pattern, v):
        at = F.regexp_instr(low, F.lit(pattern))
        start = F.greatest(F.lit(1), at - K.BIOMARKER_NEGATION_WINDOW)
        before = F.substr(low, start, at - start)
        return F.when((at > 0) & ~before.rlike(K.BIOMARKER_NEGATION), F.lit(v))
    entries = []
    for marker, patterns in K.BIOMARKER_PATTERNS.items():
        hits = [value(p, v) for p, v in patterns]
        found = F.coalesce(*hits)
        if merge and marker == "EGFR":
            found = F.when(hits[0].isNotNull() & hits[1].isNotNull(),
                           F.lit("L858R_or_exon19del")).otherwise(found)
        entries += [F.lit(marker), found]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def prior_treatments(c: Column | str) -> Column:
    low = F.lower(X.text_or_empty(c))
    return F.array_sort(_listed([F.when(low.contains(w), F.lit(v))
                                 for w, v in K.PRIOR_TREATMENT_WORDS]))


def exclusion_flags(c: Column | str) -> Column:
    low = F.lower(X.text_or_empty(c))
    return _listed([F.when(low.rlike(p), F.lit(f)) for f, p in K.EXCLUSION_FLAG_PATTERNS])


def required_fields(*, biomarkers: str = "required_biomarkers",
                    priors: str = "required_prior_treatments", stages: str = "allowed_stages",
                    ecog: str = "max_ecog") -> Column:
    """Patient fields a trial needs, from its own restrictions."""
    return _listed([
        F.lit("diagnosis"), F.when(F.size(stages) > 0, F.lit("stage")),
        F.when(F.col(ecog).isNotNull(), F.lit("ecog")),
        F.when(F.size(biomarkers) > 0, F.lit("biomarkers")),
        F.when(F.size(priors) > 0, F.lit("prior_treatments"))])
