"""Follow-up questions for unknown facts, answers, and the second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..functions import notes as N
from ..session import shuffled, written
from .criteria import matcher_field
from .ranking import keep_first, numeric_suffix_key


def _tail(c: Column) -> Column:
    return F.regexp_replace(c, "^[^:]*:", "")


def _kind(c: Column, name: str) -> Column:
    return F.startswith(c, F.lit(name + ":"))


def evidence_question(criterion: Column) -> Column:
    """Question that would settle a missing check."""
    tail = _tail(criterion)
    return (
        F.when(_kind(criterion, "biomarker"), F.concat(
            F.lit("What is the patient's "), tail, F.lit(" biomarker result?")))
        .when(_kind(criterion, "flag"), F.concat(
            F.lit("Does the patient have "), X.spaced(tail), F.lit("?")))
        .when(_kind(criterion, "field"), F.coalesce(
            X.mapped(tail, K.FIELD_QUESTIONS),
            F.concat(F.lit("What is the patient's "), tail, F.lit("?"))))
        .otherwise(F.concat(
            F.lit("What information is available for "), criterion, F.lit("?")))
    )


def report_question(criterion: Column) -> Column:
    """The report's own wording for an unknown criterion."""
    tail = _tail(criterion)
    return (
        F.when(_kind(criterion, "field"), F.concat(
            F.lit("What is the patient's "), X.spaced(tail), F.lit("?")))
        .when(_kind(criterion, "biomarker"), F.concat(
            F.lit("What is the patient's "), tail, F.lit(" biomarker result?")))
        .when(_kind(criterion, "flag"), F.concat(
            F.lit("Does the patient have "), X.spaced(tail), F.lit("?")))
        .otherwise(F.concat(
            F.lit("What patient information is available for "), criterion, F.lit("?")))
    )


def label_question(criterion_id: Column | str, trial_id: Column | str) -> Column:
    rest = F.translate(F.substr(X.col(criterion_id), F.length(X.col(trial_id)) + 2), "-", " ")
    return F.concat(F.lit("What patient information is available for "), rest, F.lit("?"))


def evidence_questions(evidence: Column | str) -> Column:
    """Distinct questions of a pair's missing checks, in order (array in the row)."""
    missing = F.filter(evidence, lambda e: e["status"] == "missing")
    return F.array_distinct(F.transform(missing, lambda e: evidence_question(e["criterion"])))


def report_questions(evidence: Column | str, criterion_results: Column | str) -> Column:
    """The pair's questions plus the report wording of its unknown criteria."""
    unknown = F.filter(criterion_results, lambda r: r["status"] == "unknown")
    more = F.transform(unknown, lambda r: report_question(r["criterion"]))
    return F.array_distinct(F.concat(evidence_questions(evidence), more))


def with_questions(judged: DataFrame) -> DataFrame:
    return judged.withColumn("questions", evidence_questions("evidence"))


@X.reused
def question_field(*, compat: bool = False) -> Column:
    """Field an unknown judgment is grouped under.

    ``compat`` forgets the criterion's type, so every exclusion lands under ``raw``.
    """
    kind = F.lit("") if compat else F.col("criterion_type")
    value = F.regexp_extract("criterion_id", r"-E-(.+)$", 1)
    field = matcher_field("criterion_id", "reason", kind, value, compat=compat)
    return F.regexp_replace(field, "^flag_", "")


def field_question(field: Column | str) -> Column:
    f = X.col(field)
    readable = X.spaced(f)
    starts = lambda p: F.startswith(f, F.lit(p))
    return (
        F.when(f.isin(list(K.UNKNOWN_FIELD_QUESTIONS)), X.mapped(f, K.UNKNOWN_FIELD_QUESTIONS))
        .when(f == "sex", K.FIELD_QUESTIONS["sex"])
        .when(starts("biomarker_"), K.UNKNOWN_FIELD_QUESTIONS["biomarker_required"])
        .when(starts("prior_"), F.concat(
            F.lit("Has the patient received "), readable, F.lit("?")))
        .otherwise(F.concat(F.lit("Does the patient have "), readable, F.lit("?")))
    )


def follow_up_questions(judgments: DataFrame, *, compat: bool = False, stored: bool = False
                        ) -> tuple[DataFrame, DataFrame]:
    """``(questions, links)``: one numbered question per patient and unknown field.

    Only the distinct fields of a patient are numbered; the links stay flat rows, so a
    patient with very many unknowns is never gathered in one place.  ``stored``: the links are wanted, which
    read the unknowns twice, so these are judged once and stored.
    """
    unknown = (judgments.filter(F.col("status") == "unknown")
               .withColumn("field", question_field(compat=compat)))
    if stored:
        unknown = written(unknown.select("patient_id", "field", "trial_id", "criterion_id"), "unknown")
    fields = unknown.select("patient_id", "field").distinct()
    n = F.row_number().over(W.partitionBy("patient_id").orderBy("field"))
    questions = fields.withColumn("question_no", n).select(
        "patient_id",
        F.concat("patient_id", F.lit("-Q"), X.padded(F.col("question_no"), 2))
        .alias("question_id"),
        "field", field_question("field").alias("question"),
        F.concat(F.lit("Required information for "), X.spaced("field"), F.lit(" is unknown."))
        .alias("reason"),
        F.lit("deterministic_question_generator").alias("source"))
    links = (unknown.join(shuffled(questions.select("patient_id", "field", "question_id")),
                          ["patient_id", "field"])
             # by field as well, which has one question: the rows lie by it
             .select("patient_id", "field", "question_id", "trial_id", "criterion_id").distinct().drop("field"))
    return questions, links


def catch_all_questions(judgments: DataFrame, questions: DataFrame
                        ) -> tuple[DataFrame, DataFrame]:
    """One question per patient with unknowns but no question, and its links."""
    open_rows = (judgments.filter(F.col("status") == "unknown")
                 .join(shuffled(questions.select("patient_id").distinct()), "patient_id", "left_anti"))
    added = open_rows.select("patient_id").distinct().select(
        "patient_id", F.concat("patient_id", F.lit("-Q01")).alias("question_id"),
        F.lit(K.CATCH_ALL_QUESTION).alias("question"),
        F.lit("One or more criterion judgments were unknown.").alias("reason"),
        F.lit("structural_question_fallback").alias("source"))
    links = open_rows.select(
        "patient_id", F.concat("patient_id", F.lit("-Q01")).alias("question_id"),
        "trial_id", "criterion_id").distinct()
    return added, links


def clean_answers(answers: DataFrame, questions: DataFrame, *, one_per_question: bool = False,
                  lenient: bool = False) -> DataFrame:
    """Answers to known questions with text; ``kept`` says which rows pass.

    ``lenient`` accepts any id for a patient without questions (they then fail the
    contract); ``one_per_question`` keeps the first usable answer of each question.
    """
    known = questions.select("patient_id", "question_id", F.lit(True).alias("_known")).distinct()
    asked = questions.select("patient_id", F.lit(True).alias("_asked")).distinct()
    rows = (answers.withColumn("answer", X.strip(X.text_or_empty("answer")))
            .withColumn("question_id", X.strip(X.text_or_empty("question_id")))
            .join(known, ["patient_id", "question_id"], "left")
            .join(asked, "patient_id", "left"))
    ok = F.col("_known").isNotNull()
    if lenient:
        ok = ok | F.col("_asked").isNull() | (F.col("question_id") == "")
    rows = rows.withColumn("kept", ok & (F.col("answer") != "")).withColumn(
        "source", F.coalesce(X.blank_to_null("source"), F.lit("external_patient_answer_input"))
    ).drop("_known", "_asked")
    if not one_per_question:
        return rows
    first = (rows.filter("kept").groupBy("patient_id", "question_id")
             .agg(F.min("ans_pos").alias("_first")))
    return (rows.join(first, ["patient_id", "question_id"], "left")
            .withColumn("kept", F.col("kept") & (F.col("ans_pos") == F.col("_first")))
            .drop("_first"))


def answer_facts(answers: DataFrame, pos: Column | None = None) -> DataFrame:
    """What a patient's answers state, later answers overriding earlier ones.

    One aggregation of ``max_by`` per fact: partial results combine before the shuffle.
    """
    pos = F.col("ans_pos") if pos is None else pos
    found, latest = _answer_columns()
    return answers.select("patient_id", pos.alias("_pos"), *found).groupBy("patient_id").agg(
        *latest)


@X.reused
def _answer_columns() -> tuple[list[Column], list[Column]]:
    low = F.lower("answer")
    ecog = F.nullif(F.regexp_extract(
        low, r"\becog(?: performance status)?\s*(?:is|=)?\s*([0-5])\b", 1), F.lit("")
    ).cast("int")
    has = lambda w: F.contains(low, F.lit(w))
    stage = F.when(has("stage iii") | has("stage 3"), "III").when(
        has("stage iv") | has("stage 4"), "IV")
    platinum = F.when(has("prior platinum") | has("platinum chemotherapy"),
                      ~N.negated(low, "platinum"))
    found = {"ecog": ecog, "stage": stage, "platinum": platinum}
    for flag in K.CANONICAL_FLAGS:
        phrase = flag.replace("_", " ")
        found[flag] = F.when(has(phrase), ~N.negated(low, phrase))
    return [c.alias("a_" + n) for n, c in found.items()], [
        F.max_by("a_" + n, F.when(F.col("a_" + n).isNotNull(), F.col("_pos"))).alias("a_" + n)
        for n in found]


def apply_answers(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Facts after the answers; patients without answers keep theirs."""
    stated = answer_facts(answers)
    flags = F.map_filter(F.create_map(*[x for f in K.CANONICAL_FLAGS
                                        for x in (F.lit(f), F.col("a_" + f))]),
                         lambda k, v: v.isNotNull())
    prior = F.map_filter(F.create_map(F.lit("prior_platinum_chemotherapy"), F.col("a_platinum")),
                         lambda k, v: v.isNotNull())
    new = {
        "ecog": F.coalesce("a_ecog", "ecog"), "stage": F.coalesce("a_stage", "stage"),
        "flags": N.right_wins(F.col("flags"), flags),
        "prior_treatments": N.right_wins(F.col("prior_treatments"), prior),
    }
    return facts.join(shuffled(stated), "patient_id", "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in facts.columns])


def related_questions(links: DataFrame) -> DataFrame:
    """Question ids per (patient, trial); at most one per field, so the lists are short."""
    ids = F.array_sort(F.collect_set("question_id"))
    return links.groupBy("patient_id", "trial_id").agg(ids.alias("related_question_ids"))


def attach_related(assessed: DataFrame, links: DataFrame) -> DataFrame:
    rows = assessed.join(related_questions(links), ["patient_id", "trial_id"], "left")
    return rows.withColumn("related_question_ids", X.string_list("related_question_ids"))


# --- questions and answers written by a model --------------------------------------------------

def collect_questions(rows: DataFrame) -> DataFrame:
    """Questions from traces or trial rows; same text keeps the first place, the last value.

    ``rows``: patient_id, pos (from 1), question_id, question, reason, source.
    """
    r = rows.withColumn("question", X.strip(X.text_or_empty("question")))
    r = r.filter(F.col("question") != "").withColumn(
        "_key", F.regexp_replace(F.lower("question"), r"\s+", " "))
    fallback = F.concat("patient_id", F.lit("-Q"), X.padded(F.col("pos"), 2))
    value = F.struct(
        F.coalesce(X.blank_to_null("question_id"), fallback).alias("question_id"), "question",
        X.text_or_empty("reason").alias("reason"),
        F.coalesce(X.blank_to_null("source"), F.lit("agent_trace")).alias("source"))
    return (r.groupBy("patient_id", "_key")
            .agg(F.min("pos").alias("pos"), F.max_by(value, F.col("pos")).alias("q"))
            .select("patient_id", "pos", "q.*"))


def collect_answers(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with text; one without an id takes the id of the question at its position.

    ``rows``: patient_id, pos (from 1), question_id, answer, source.  Repeats of the same id
    and text are dropped.
    """
    nth = questions.withColumn("_n", F.row_number().over(
        W.partitionBy("patient_id").orderBy("pos"))).select(
        "patient_id", F.col("_n").alias("pos"), F.col("question_id").alias("_qid"))
    r = rows.withColumn("answer", X.strip(X.text_or_empty("answer"))).filter(
        F.col("answer") != "").join(nth, ["patient_id", "pos"], "left")
    fallback = F.concat("patient_id", F.lit("-Q"), X.padded(F.col("pos"), 2))
    r = r.select(
        "patient_id", "pos",
        F.coalesce(X.blank_to_null("question_id"), "_qid", fallback).alias("question_id"),
        "answer", F.coalesce(X.blank_to_null("source"), F.lit("agent_trace")).alias("source"),
        F.regexp_replace(F.lower(X.strip("answer")), r"\s+", " ").alias("_key"))
    return keep_first(r, ["patient_id", "question_id", "_key"], "pos").drop("_key")


def placeholder_questions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions plus a placeholder for every answered id that has none, with their order."""
    missing = (answers.select("patient_id", "question_id").distinct()
               .join(questions, ["patient_id", "question_id"], "left_anti")
               .select("patient_id", "question_id",
                       F.lit(K.PLACEHOLDER_QUESTION).alias("question"),
                       F.lit("Added to preserve a simulated answer that referenced this "
                             "question_id.").alias("reason"),
                       F.lit("answer_only_repair").alias("source")))
    have = questions.select("patient_id", "question_id", "question", "reason", "source")
    return have.unionByName(missing).withColumn(
        "order_key", numeric_suffix_key("question_id", "patient_id"))


def hint_words(text: Column) -> Column:
    """Criterion words a question's wording points at."""
    t = X.spaced(F.regexp_replace(F.lower(X.strip(text)), r"\s+", " "))
    picks = [F.when(F.contains(t, F.lit(phrase)), X.words(values)).otherwise(X.no_strings())
             for phrase, values in K.QUESTION_HINTS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*picks))))


def long_tokens(c: Column) -> Column:
    """Lower-case alphanumeric tokens of three letters or more."""
    t = F.split(F.translate(F.lower(c), "_", " "), "[^a-z0-9]+")
    return F.array_distinct(F.filter(t, lambda x: F.length(x) > 2))


def attach_questions(questions: DataFrame, criteria: DataFrame, trials: DataFrame,
                     explicit: DataFrame | None = None) -> DataFrame:
    """Which criteria or trials a model's question is about; the first tier that finds any.

    Tiers: 1 explicit links, 2 hinted words on unknown criteria, 3 hinted words on all
    criteria, 4 alias words or two shared title words, 5 a shared word with an unknown
    criterion.  All tiers compare a question only with its own patient's rows: hints and
    words are exploded and joined on equality.

    ``questions``: patient_id, question_id, question.  ``criteria``: patient_id, trial_id,
    criterion_id, criterion, value_text, status, reason.  ``trials``: patient_id, trial_id,
    title_text.  ``explicit``: patient_id, question_id, trial_id, criterion_id.
    """
    key = ["patient_id", "question_id"]
    out = [*key, "trial_id", "criterion_id", "tier"]

    hints = questions.select(*key, F.explode(hint_words(F.col("question"))).alias("hint"))
    vocab = sorted({v for _, values in K.QUESTION_HINTS for v in values})

    def hinted(text):
        return F.explode(F.array_compact(F.array(*[
            F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in vocab])))

    on_id = F.translate(F.lower("criterion_id"), "_", "-")
    on_all = F.translate(F.regexp_replace(F.lower(X.strip(F.concat_ws(
        " ", "criterion_id", "criterion", "value_text"))), r"\s+", " "), "_", "-")
    unknown = criteria.filter(F.col("status") == "unknown")
    tier2 = hints.join(unknown.select("patient_id", "trial_id", "criterion_id",
                                      hinted(on_id).alias("hint")), ["patient_id", "hint"]
                       ).withColumn("tier", F.lit(2)).select(*out)
    tier3 = hints.join(criteria.select("patient_id", "trial_id", "criterion_id",
                                       hinted(on_all).alias("hint")), ["patient_id", "hint"]
                       ).withColumn("tier", F.lit(3)).select(*out)

    generic = X.words(K.QUESTION_GENERIC_WORDS)
    q_words = F.array_except(long_tokens(F.col("question")), generic)
    t_words = F.array_except(long_tokens(F.col("title_text")), generic)

    def alias_ids(tokens):
        return F.array_compact(F.array(*[
            F.when(F.arrays_overlap(tokens, X.words(group)), F.lit(i))
            for i, group in enumerate(K.QUESTION_ALIASES)]))

    q_alias = questions.select(*key, F.explode(alias_ids(q_words)).alias("alias"))
    t_alias = trials.select("patient_id", "trial_id", F.explode(alias_ids(t_words))
                            .alias("alias"))
    alias_hits = q_alias.join(t_alias, ["patient_id", "alias"])
    # the first alias group that finds a trial decides
    first_alias = alias_hits.groupBy(*key).agg(F.min("alias").alias("alias"))
    by_alias = alias_hits.join(first_alias, [*key, "alias"]).select(*key, "trial_id")
    shared = (questions.select(*key, F.explode(q_words).alias("w"))
              .join(trials.select("patient_id", "trial_id", F.explode(t_words).alias("w")),
                    ["patient_id", "w"])
              .groupBy(*key, "trial_id").count().filter(F.col("count") >= 2)
              .select(*key, "trial_id"))
    # a trial id written in the question (ids are tokens of their own)
    named = (questions.select(*key, F.explode(F.regexp_extract_all(
        "question", F.lit("[A-Za-z0-9_-]+"), F.lit(0))).alias("trial_id"))
        .join(trials.select("patient_id", "trial_id"), ["patient_id", "trial_id"])
        .select(*key, "trial_id"))
    by_title = shared.unionByName(named).join(first_alias, key, "left_anti")
    tier4 = by_alias.unionByName(by_title).withColumn("criterion_id", F.lit("")).withColumn(
        "tier", F.lit(4)).select(*out)

    tier5 = (questions.select(*key, F.explode(long_tokens(F.col("question"))).alias("w"))
             .join(unknown.select("patient_id", "trial_id", "criterion_id", F.explode(
                 long_tokens(F.concat_ws(" ", "criterion_id", "reason"))).alias("w")),
                 ["patient_id", "w"])
             .withColumn("tier", F.lit(5)).select(*out))
    tiers = tier2.unionByName(tier3).unionByName(tier4).unionByName(tier5)
    if explicit is not None:
        tiers = tiers.unionByName(valid_links(explicit, criteria).withColumn(
            "tier", F.lit(1)).select(*out))
    tiers = tiers.distinct()
    best = tiers.groupBy(*key).agg(F.min("tier").alias("tier"))
    return tiers.join(best, [*key, "tier"]).select(*out)


def valid_links(links: DataFrame, criteria: DataFrame) -> DataFrame:
    """Links with the trial corrected from the criterion; links to foreign trials drop."""
    owner = criteria.select("patient_id", "criterion_id", F.col("trial_id").alias("_owner")
                            ).distinct()
    trials = criteria.select("patient_id", "trial_id", F.lit(True).alias("_in")).distinct()
    fixed = (links.join(owner, ["patient_id", "criterion_id"], "left")
             .withColumn("trial_id", F.coalesce("_owner", X.text_or_empty("trial_id")))
             .join(trials, ["patient_id", "trial_id"], "left")
             .filter((F.col("trial_id") == "") | F.col("_in")))
    return fixed.select("patient_id", "question_id", "trial_id", "criterion_id").distinct()
