"""Patients, trials, pairs and other roles derived by expression from the driver tables.

The driver's tables hold no patients, so each role is a projection of a whole table:
customers are patients, parts are trials, and the parts a customer ordered are that
patient's candidate pairs.  All roles grow with their tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import notes as N
from ..session import shuffled, spread

DIAGNOSES = {
    "MACHINERY": "metastatic non-small cell lung cancer",
    "BUILDING": "HER2-positive breast cancer",
    "AUTOMOBILE": "advanced renal cell carcinoma",
    "FURNITURE": "migraine with aura",
    "HOUSEHOLD": "unresectable melanoma",
}
CONDITIONS = {
    "MEDIUM": ["Non-Small Cell Lung Cancer"],
    "STANDARD": ["Breast Cancer", "HER2 Positive Breast Carcinoma"],
    "LARGE": ["Renal Cell Carcinoma"],
    "PROMO": ["Migraine"],
    "SMALL": ["Melanoma", "Solid Tumor"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, shared out for per-row work when it comes in few parts."""
    return spread(table(spark, sf_dir, name))


def _pid(c: str):
    return F.concat(F.lit("P"), X.padded(F.col(c), 12))


def _tid(c: str):
    return F.concat(F.lit("T"), X.padded(F.col(c), 12))


def _smap(*pairs):
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*_patient_columns())


@X.reused
def _patient_columns():
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    none_s = F.create_map().cast("map<string,string>")
    none_b = F.create_map().cast("map<string,boolean>")
    no = X.no_strings()
    stage = F.element_at(F.array(*[F.lit(s) for s in ("I", "II", "III", "IV")],
                                 F.lit(None).cast("string")), (n % 5 + 1).cast("int"))
    state = F.element_at(X.words(["CA", "NY", "TX", "WA", "MA", "IL", "FL"]),
                         (n % 7 + 1).cast("int"))
    return [
        k.alias("patient_pos"), _pid("c_custkey").alias("patient_id"),
        F.when(k % 17 != 0, k % 95).cast("int").alias("age"),
        F.when(k % 3 == 0, "female").when(k % 3 == 1, "Male").when(k % 5 != 0, "female")
        .alias("sex"),
        F.when(k % 19 != 0, X.mapped("c_mktsegment", DIAGNOSES)).alias("diagnosis"),
        stage.alias("stage"),
        F.when(F.col("c_acctbal") >= 0, n % 5).cast("int").alias("ecog"),
        F.when(k % 4 == 0, _smap(("EGFR", "exon19del")))
        .when(k % 4 == 1, _smap(("EGFR", "negative"), ("ALK", "positive")))
        .when(k % 4 == 2, _smap(("her2", "Positive"))).otherwise(none_s).alias("biomarkers"),
        F.when(k % 5 == 0, X.words(["platinum chemotherapy"]))
        .when(k % 5 == 1, X.words(["Platinum-based doublet", "trastuzumab"]))
        .when(k % 5 == 2, X.words(["oxaliplatin"])).otherwise(no).alias("prior_treatments"),
        F.when(k % 6 == 0, _smap(("uncontrolled_cardiac_disease", True),
                                 ("organ_transplant", False)))
        .when(k % 6 == 1, _smap(("uncontrolled_cardiac_disease", False),
                                ("organ_transplant", False),
                                ("active_autoimmune_disease", False)))
        .when(k % 6 == 2, _smap(("active_autoimmune_disease", True)))
        .when(k % 6 == 3, _smap(("active_interstitial_lung_disease", False),
                                ("active_uncontrolled_infection", False)))
        .otherwise(none_b).alias("flags"),
        F.when(n % 7 != 6, F.create_map(F.lit("country"), F.lit("US"), F.lit("state"), state))
        .otherwise(none_s).alias("location"),
        F.lit(None).cast("string").alias("clinical_note"),
        F.lower("c_mktsegment").alias("scenario"),
        F.lit(None).cast("string").alias("target_trial_id"),
    ]


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, need = _trial_columns()
    return table(spark, sf_dir, "part").select(*base).withColumn(
        "required_patient_fields", need)


@X.reused
def _trial_columns():
    k = F.col("p_partkey")
    no, none_s = X.no_strings(), F.create_map().cast("map<string,string>")
    cond = no
    for kind, names in CONDITIONS.items():
        cond = F.when(F.col("p_type") == kind, X.words(names)).otherwise(cond)
    stages = F.when(k % 3 == 0, X.words(["III", "IV"])).when(
        k % 3 == 1, X.words(["II", "III"])).otherwise(no)
    max_ecog = F.when(k % 6 < 3, k % 3).cast("int")
    bio = (F.when(k % 8 == 0, _smap(("EGFR", "L858R_or_exon19del")))
           .when(k % 8 == 1, _smap(("HER2", "positive")))
           .when(k % 8 == 2, _smap(("ALK", "negative"), ("EGFR", "positive")))
           .otherwise(none_s))
    prior = F.when(k % 9 == 0, X.words(["platinum chemotherapy"])).when(
        k % 9 == 1, X.words(["trastuzumab", "oxaliplatin"])).otherwise(no)
    flags = F.when(k % 5 == 0, X.words(["organ_transplant"])).when(
        k % 5 == 1, X.words(["uncontrolled_cardiac_disease", "active_autoimmune_disease"])
    ).when(k % 5 == 2, X.words(["active_interstitial_lung_disease"])).otherwise(no)
    base = [
        k.alias("trial_pos"), _tid("p_partkey").alias("trial_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.concat(F.lit("PHASE"), (k % 3 + 1).cast("string")).alias("phase"),
        cond.alias("conditions"), F.array("p_brand").alias("interventions"),
        F.when(k % 7 != 0, F.col("p_size")).cast("int").alias("min_age"),
        F.when(k % 5 != 0, F.col("p_size") + 30).cast("int").alias("max_age"),
        F.when(k % 4 == 0, "female").when(k % 4 == 1, "male").otherwise("all").alias("sex"),
        stages.alias("allowed_stages"), max_ecog.alias("max_ecog"),
        bio.alias("required_biomarkers"), prior.alias("required_prior_treatments"),
        flags.alias("excluded_flags"),
        F.concat_ws(" ", F.lit("A study of"), "p_name").alias("summary"),
        F.when(k % 10 == 0, "COMPLETED").otherwise("RECRUITING").alias("status"),
        (k % 400).cast("int").alias("enrollment"),
        F.concat(F.lit("https://registry.example/"), _tid("p_partkey")).alias("source_url"),
        F.lit(None).cast("string").alias("eligibility_criteria"),
        no.alias("inclusion_criteria"), no.alias("exclusion_criteria")]
    need = F.array_compact(F.array(
        F.lit("diagnosis"), F.when(F.size("allowed_stages") > 0, F.lit("stage")),
        F.when(F.col("max_ecog").isNotNull(), F.lit("ecog")),
        F.when(F.size("required_biomarkers") > 0, F.lit("biomarkers")),
        F.when(F.size("required_prior_treatments") > 0, F.lit("prior_treatments"))))
    return base, need


def ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and part ordered: ids, the first order and the return flag."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    return (li.join(shuffled(o), li.l_orderkey == o.o_orderkey)
            .groupBy("o_custkey", "l_partkey")
            .agg(F.min("o_orderkey").alias("first_order"),
                 F.sum("l_quantity").cast("bigint").alias("quantity"),
                 F.min("l_returnflag").alias("flag"),
                 F.max("l_returnflag").alias("last_flag")))


def pairs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Candidate pairs: the parts a customer ordered, retrieval score by quantity; and ``more`` of
    the columns of :func:`ordered_parts`."""
    return ordered_parts(spark, sf_dir).select(
        _pid("o_custkey").alias("patient_id"), _tid("l_partkey").alias("trial_id"),
        (F.col("quantity") / F.lit(100.0)).alias("retrieval_score"),
        F.col("l_partkey").alias("retrieval_pos"), *more)


def pair_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("patient_id", "trial_id")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A templated note per patient, shared out for the work on texts that follows."""
    p = spread(patients(spark, sf_dir))
    return p.withColumn("note", N.render_note("patient_pos"))
