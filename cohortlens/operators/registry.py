"""Registry studies to trial rows, and the quota-limited selection of landed pages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..functions import protocol as P
from ..session import written
from .ranking import keep_first, top_n


def normalize_studies(studies: DataFrame, *, merge_biomarkers: bool = False,
                      url_prefix: str = "https://clinicaltrials.gov/study/") -> DataFrame:
    """Nested studies (column ``study``) to the trial table, all inference included."""
    s = "study.protocolSection."
    ident, elig = s + "identificationModule.", s + "eligibilityModule."
    pos = [F.col(c) for c in ("trial_pos",) if c in studies.columns]
    clean_list = lambda c: F.coalesce(c, X.no_strings())
    raw = studies.select(
        *pos, X.text_or_empty(ident + "nctId").alias("trial_id"),
        F.coalesce(F.nullif(ident + "briefTitle", F.lit("")),
                   F.nullif(ident + "officialTitle", F.lit("")), ident + "nctId", F.lit(""))
        .alias("_title"),
        X.text_or_empty(ident + "briefTitle").alias("_brief"),
        F.array_join(clean_list(F.col(s + "designModule.phases")), ", ").alias("_phase"),
        clean_list(F.col(s + "conditionsModule.conditions")).alias("_conditions"),
        F.filter(clean_list(F.col(s + "armsInterventionsModule.interventions.name")),
                 lambda n: F.length(n) > 0).alias("_interventions"),
        F.col(elig + "minimumAge").alias("_min"), F.col(elig + "maximumAge").alias("_max"),
        F.col(elig + "sex").alias("_sex"),
        X.text_or_empty(elig + "eligibilityCriteria").alias("_criteria"),
        X.text_or_empty(s + "descriptionModule.briefSummary").alias("_summary"),
        X.text_or_empty(s + "statusModule.overallStatus").alias("_status"),
        F.col(s + "designModule.enrollmentInfo.count").alias("enrollment"))
    # lists travel through the one Python step as text, so a row crosses it once
    sep = "\u0001"
    texts = {"title": "_title", "brief": "_brief", "phase": "_phase", "criteria": "_criteria",
             "summary": "_summary", "status": "_status"}
    cleaned = raw.select(
        *pos, "trial_id", "enrollment", "_min", "_max", "_sex",
        *[P.html_unescape(c).alias("u_" + n) for n, c in texts.items()],
        P.html_unescape(F.array_join("_conditions", sep)).alias("u_conditions"),
        P.html_unescape(F.array_join("_interventions", sep)).alias("u_interventions"),
        F.size("_conditions").alias("_nc"), F.size("_interventions").alias("_ni"))

    def listed(c, n):
        items = F.transform(F.split(c, sep), P.ascii_text)
        return F.when(F.col(n) == 0, X.no_strings()).otherwise(items)
    base = cleaned.select(
        *pos, "trial_id", "enrollment", "_min", "_max", "_sex",
        *[P.ascii_text("u_" + n).alias("c_" + n) for n in texts],
        listed(F.col("u_conditions"), "_nc").alias("conditions"),
        listed(F.col("u_interventions"), "_ni").alias("interventions"))
    rules = base.select(
        "*", P.section_lines("c_criteria").alias("_lines"),
        P.allowed_stages("c_criteria").alias("allowed_stages"),
        P.max_ecog("c_criteria").alias("max_ecog"),
        P.required_biomarkers(F.concat_ws(" ", "c_criteria", "c_brief", "c_summary"),
                              merge=merge_biomarkers).alias("required_biomarkers"),
        P.prior_treatments("c_criteria").alias("required_prior_treatments"),
        P.exclusion_flags("c_criteria").alias("excluded_flags"))
    return rules.select(
        *pos, "trial_id", F.col("c_title").alias("title"), F.col("c_phase").alias("phase"),
        "conditions", "interventions", P.age_years("_min").alias("min_age"),
        P.age_years("_max").alias("max_age"), P.sex_label("_sex").alias("sex"),
        "allowed_stages", "max_ecog", "required_biomarkers", "required_prior_treatments",
        "excluded_flags", P.required_fields().alias("required_patient_fields"),
        F.col("c_summary").alias("summary"), F.col("c_status").alias("status"), "enrollment",
        F.when(F.col("trial_id") != "", F.concat(F.lit(url_prefix), F.col("trial_id")))
        .otherwise("").alias("source_url"),
        F.col("c_criteria").alias("eligibility_criteria"),
        F.col("_lines.inclusion").alias("inclusion_criteria"),
        F.col("_lines.exclusion").alias("exclusion_criteria"))


def select_studies(pages: DataFrame, conditions: Sequence[str], limit: int,
                   statuses: Sequence[str] = K.RECRUITING) -> DataFrame:
    """Studies accepted from landed pages, by quota per condition and an overall limit.

    ``pages``: condition, page_no, studies; ``conditions`` are distinct.  A condition accepts, in page order, studies that no condition
    before it has accepted, up to ``ceil(limit / conditions)``.

    All conditions choose at once, in rounds: each asks for the first of its studies, as many as its quota;
    a study goes to the first condition that asks, and is struck from the lists of all later ones.
    What a study has been asked by can only get better, so a round settles at least one more
    condition, and the last round, in which nothing is struck, gives what one after the
    other would give.  Only ids and places go round; the studies are fetched at the end.
    """
    number = F.nullif(F.array_position(X.words(conditions), F.col("condition")), F.lit(0)) - 1
    rows = pages.select(number.cast("int").alias("condition_no"), "page_no", F.posexplode("studies").alias("pos", "study"))
    ident = "study.protocolSection."
    rows = rows.withColumn("trial_id", F.nullif(
        F.col(ident + "identificationModule.nctId"), F.lit(""))).withColumn(
        "_status", F.nullif(F.col(ident + "statusModule.overallStatus"), F.lit("")))
    usable = rows.filter(F.col("condition_no").isNotNull() & F.col("trial_id").isNotNull() & (
        F.col("_status").isNull() | F.upper("_status").isin(list(statuses))))
    usable = written(keep_first(usable, ["condition_no", "trial_id"], F.struct("page_no", "pos"))
                     .drop("_status"), "usable-studies")
    lists = usable.select("condition_no", "trial_id", "page_no", "pos")
    quota = max(1, math.ceil(limit / max(1, len(conditions))))
    place = [F.col("page_no"), F.col("pos")]
    while True:
        asked = top_n(lists, ["condition_no"], place, quota, "_asked")
        first = asked.groupBy("trial_id").agg(F.min("condition_no").alias("_first"))
        judged = written(lists.join(first, "trial_id", "left").withColumn(
            "_struck", F.coalesce(F.col("condition_no") > F.col("_first"), F.lit(False))), "asked-studies")
        lists = judged.filter(~F.col("_struck")).drop("_first", "_struck")
        if judged.filter("_struck").isEmpty():
            break
    taken = top_n(lists, ["condition_no"], place, quota, "_asked").drop("_asked")
    # at most a quota a condition is left, so the overall limit orders a bounded table
    taken = taken.orderBy("condition_no", *place).limit(max(limit, 0))
    return taken.join(usable, ["condition_no", "trial_id", "page_no", "pos"]).select(
        "trial_id", "condition_no", "page_no", "pos", "study")
