"""Data-quality jobs: every rule is a small query that yields ``(key, error)`` rows."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..functions.jsontext import strict_json
from ..session import shuffled
from .matching import list_text
from .ranking import keep_last

PAIR = ["patient_id", "trial_id"]


def _err(df: DataFrame, *parts) -> DataFrame:
    text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return df.select("patient_id", text.alias("error"))


def _all(rules: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def bag_mismatch(expected: DataFrame, actual: DataFrame, key: Sequence[str], item: str
                 ) -> DataFrame:
    """Keys whose two bags of items differ.

    Compares counts per (key, item), so a key with very many items is spread over its items.
    """
    e = expected.groupBy(*key, item).agg(F.count(F.lit(1)).alias("_e"))
    a = actual.groupBy(*key, item).agg(F.count(F.lit(1)).alias("_a"))
    both = e.join(a, [*key, item], "full_outer")
    return both.filter(~F.col("_e").eqNullSafe(F.col("_a"))).select(*key).distinct()


def _record_errors(extra: bool) -> Column:
    """Errors of one nested prediction (``o``) against its expected trials (``want``).

    Everything a record must hold is in its own row, so all rules are array expressions of
    that row and a table of predictions is read once.
    """
    o, text = F.col("o"), X.text_or_empty
    final = o["final_assessment_after_answers"]["evaluated_trials"]
    initial = o["initial_assessment"]["evaluated_trials"]
    lit = lambda cond, message: F.array_compact(F.array(
        F.when(cond, F.lit(message))))

    def ids(rows):
        return F.coalesce(F.transform(rows, lambda t: text(t["trial_id"])), X.no_strings())

    def each(rows, *rules):
        """Errors of every row of a nested list; a rule is (condition, message) of the row."""
        made = F.transform(rows, lambda r: F.array_compact(F.array(*[
            F.when(cond(r), message(r)) for cond, message in rules])))
        return F.coalesce(F.flatten(made), X.no_strings())

    def note(suffix, *names):
        return lambda r: F.concat(F.concat_ws("/", *[text(r[n]) for n in names or ("trial_id",)]),
                                  F.lit(suffix))

    def outside(value, allowed):
        return ~F.coalesce(value.isin(allowed), F.lit(False))

    def not_label(label):
        return lambda r: ~r["eligibility"].eqNullSafe(F.lit(label))
    expected = F.array_sort(F.transform("want", lambda w: w["trial_id"]))

    def wrong_criteria(t):
        own = X.pick(F.col("want"), lambda w: w["trial_id"] == t["trial_id"])
        have = F.array_sort(F.array_distinct(F.coalesce(F.transform(
            t["criterion_results"], lambda c: text(c["criterion_id"])), X.no_strings())))
        return have != F.coalesce(own["criteria"], X.no_strings())

    def criterion_errors(t):
        made = F.transform(t["criterion_results"], lambda c: F.array_compact(F.array(
            F.when(outside(c["status"], K.CRITERION_STATUS), F.concat(
                text(t["trial_id"]), F.lit("/"), text(c["criterion_id"]),
                F.lit(": invalid criterion status"))),
            F.when(c["reason"].isNull(), F.concat(
                text(t["trial_id"]), F.lit("/"), text(c["criterion_id"]),
                F.lit(": missing reason"))))))
        return F.coalesce(F.flatten(made), X.no_strings())

    def final_label(r):
        same = F.filter(final, lambda t: t["trial_id"] == r["trial_id"])
        return F.try_element_at(same, F.lit(-1))["eligibility"]
    rec, unc, exc = (o[n] for n in ("recommended_trials", "uncertain_but_actionable_trials",
                                    "excluded_trials"))
    asked = F.coalesce(F.transform(o["follow_up_questions"], lambda q: text(q["question_id"])),
                       X.no_strings())
    parts = [
        F.array_compact(F.array(*[F.when(o[n].isNull(), F.lit(f"missing final_output.{n}"))
                                  for n in K.FINAL_SECTIONS])),
        lit(X.blank_to_null(o["medical_disclaimer"]).isNull(), "missing medical disclaimer"),
        lit(F.array_sort(ids(final)) != expected,
            "final evaluated trials do not match candidate trials"),
        lit(F.array_sort(ids(initial)) != expected,
            "initial evaluated trials do not match candidate trials"),
        each(final,
             (lambda t: outside(t["eligibility"], K.ELIGIBILITY), note(": invalid eligibility")),
             (lambda t: text(t["explanation"]) == "", note(": missing explanation")),
             (wrong_criteria, note(": criterion id set mismatch"))),
        F.coalesce(F.flatten(F.transform(final, criterion_errors)), X.no_strings()),
        each(rec, (not_label("eligible"), note(": recommended row is not marked eligible")),
             (lambda r: ~final_label(r).eqNullSafe(F.lit("eligible")),
              note(": non-eligible final row in recommended_trials"))),
        each(unc, (not_label("uncertain"), note(": uncertain row is not marked uncertain"))),
        each(exc, (not_label("ineligible"), note(": excluded row is not marked ineligible"))),
        lit(F.array_sort(F.concat(ids(rec), ids(unc), ids(exc))) != expected,
            "recommended/uncertain/excluded partition does not cover candidates"),
        each(o["simulated_patient_answers"],
             (lambda a: (text(a["question_id"]) != "")
              & ~F.array_contains(asked, text(a["question_id"])),
              note(": answer references missing question", "question_id"))),
    ]
    if extra:
        parts += [
            each(F.col("candidate_trials"), (
                lambda t: (text(t["trial_title"]) == "")
                | (F.coalesce(F.size(t["criteria_to_assess"]), F.lit(0)) <= 0),
                note(": incomplete candidate trial payload"))),
            each(rec, (lambda r: text(r["recommendation_reason"]) == "",
                       note(": missing recommendation reason"))),
            each(exc, (lambda r: text(r["exclusion_reason"]) == "",
                       note(": missing exclusion reason"))),
        ]
    return F.concat(*parts)


def _audited(predictions: DataFrame, gold: DataFrame, extra: bool) -> DataFrame:
    want = F.transform("candidate_trials", lambda t: F.struct(
        t["trial_id"].alias("trial_id"), F.array_sort(F.array_distinct(F.transform(
            t["criteria_to_assess"], lambda c: c["criterion_id"]))).alias("criteria")))
    g = gold.select("patient_id", want.alias("want"))
    rows = predictions.select("patient_id", "candidate_trials", F.col("final_output").alias("o"))
    return rows.join(shuffled(g), "patient_id").select(
        "patient_id", F.explode(_record_errors(extra)).alias("error"))


def contract_errors(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """All ways a nested prediction breaks its contract, as ``(patient_id, error)``.

    One join on the patient, then everything in the row.
    """
    return _audited(predictions, gold, False)


def finalized_errors(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """The finalized record's contract: the shared rules plus payloads and reasons."""
    return _audited(predictions, expected, True)


def batch_label_errors(labels: DataFrame, expected_trials: DataFrame,
                       expected_criteria: DataFrame, stages: DataFrame | None = None
                       ) -> DataFrame:
    """Batch-label contract: one record per patient, the right trials, the right criteria.

    ``labels``: patient_id, rec_no, trial_id, criterion_results.  ``stages``: patient_id,
    stage present in a record's trace.
    """
    have = labels.select("patient_id").distinct()
    everyone = expected_trials.select("patient_id").distinct()
    rules = [_err(everyone.join(shuffled(have), "patient_id", "left_anti"), "missing output record")]
    records = labels.select("patient_id", "rec_no").distinct()
    rules.append(_err(records.groupBy("patient_id").count().filter("count > 1"),
                      "duplicate output record"))
    first = labels.join(shuffled(labels.groupBy("patient_id").agg(F.min("rec_no").alias("rec_no"))),
                        ["patient_id", "rec_no"])
    known = everyone.join(shuffled(have), "patient_id", "left_semi")
    rules.append(_err(bag_mismatch(expected_trials.join(shuffled(known), "patient_id", "left_semi"),
                                   first, ["patient_id"], "trial_id"),
                      "final recommendations do not match candidate trials"))
    crit = first.select(*PAIR, F.explode("criterion_results").alias("c")).select(
        *PAIR, X.text_or_empty("c.criterion_id").alias("criterion_id")).distinct()
    want = expected_criteria.select(*PAIR, "criterion_id").distinct().join(
        shuffled(first.select(*PAIR).distinct()), PAIR, "left_semi")
    rules.append(_err(bag_mismatch(want, crit, PAIR, "criterion_id"), F.col("trial_id"),
                      ": final criterion ids mismatch"))
    if stages is not None:
        need = known.withColumn("stage", F.explode(X.words(K.STAGE_NAMES)))
        rules.append(_err(need.join(stages, ["patient_id", "stage"], "left_anti"), "missing ",
                          F.col("stage")))
    return _all(rules)


def consistency_warnings(labels: DataFrame) -> DataFrame:
    """Labels that contradict their criterion statuses.

    ``labels``: patient_id, trial_id, eligibility, statuses (the distinct statuses).
    """
    has = lambda s: F.array_contains("statuses", F.lit(s))
    e = F.col("eligibility")
    odd = (
        ((e == "eligible") & (has("violated") | has("unknown")))
        | ((e == "uncertain") & (has("violated") | ~has("unknown")))
        | ((e == "ineligible") & ~has("violated"))
    )
    warning = F.when(odd, F.concat(
        e, F.lit(" with criterion statuses "), list_text(F.array_sort("statuses"))))
    # from a generator: a filter on the statuses would be pushed to where they are made, and make them
    # again each time it names them
    return labels.select(*PAIR, F.explode_outer(F.array(warning)).alias("warning")).filter(
        F.col("warning").isNotNull())


def run_errors(calls: DataFrame, expected_calls: int = 6) -> DataFrame:
    """Run invariants per patient: the number of calls, all ok, all parsed."""
    n = calls.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    rules = [_err(n.filter(F.col("n") != expected_calls), f"expected {expected_calls} calls, found ",
                  F.col("n").cast("string"))]
    rules.append(_err(calls.filter(~F.coalesce("ok", F.lit(False))), F.col("agent"),
                      ": API call failed"))
    rules.append(_err(calls.filter(~F.coalesce("json_ok", F.lit(False))), F.col("agent"),
                      ": JSON parse failed"))
    return _all(rules)


def report_errors(reports: DataFrame) -> DataFrame:
    """Checks of report rows before they are published.

    ``reports``: patient_id, trial_id, eligibility, explanation, questions, clinical_note,
    criterion_results.
    """
    where = F.concat(F.col("trial_id"), F.lit(""))
    rows = reports.select(*PAIR, F.explode("criterion_results").alias("c"))
    missing = lambda c: F.col(c).isNull()
    rules = [
        _err(reports.filter(F.coalesce("clinical_note", F.lit("")) == ""),
             "missing clinical_note"),
        _err(reports.filter(~F.coalesce(F.col("eligibility").isin(K.ELIGIBILITY), F.lit(False))),
             where, ": bad eligibility ", X.sql_text("eligibility")),
        _err(reports.filter(missing("explanation")), where, ": missing explanation"),
        _err(reports.filter(missing("questions")), where, ": missing follow_up_questions"),
        _err(reports.filter(F.coalesce(F.size("criterion_results"), F.lit(0)) <= 0), where,
             ": missing criterion_results"),
        _err(rows.filter(~F.coalesce(F.col("c.status").isin(K.CRITERION_STATUS), F.lit(False))),
             where, ": bad criterion status ", X.sql_text("c.status")),
    ]
    for key in ("criterion_id", "criterion_type", "criterion", "reason"):
        rules.append(_err(rows.filter(F.col("c." + key).isNull()), where,
                          f": criterion missing {key}"))
    return _all(rules)


# --- allow-lists and forbidden material in JSON ---------------------------------------------------

def variant_keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def blinded_errors(records: DataFrame, record: str = "record", key: str = "patient_id"
                   ) -> DataFrame:
    """Records (JSON text) with anything outside the five allow-lists.

    ``(key, error)``; ``record`` holds one JSON object per row.
    """
    v = F.try_parse_json(record)
    rows = records.select(F.col(key).cast("string").alias("patient_id"), v.alias("v"))
    kind = lambda c: F.schema_of_variant(c)
    starts = lambda c, w: F.startswith(F.coalesce(kind(c), F.lit("")), F.lit(w))
    keys = F.array_sort(variant_keys(F.col("v")))
    rules = [_err(rows.filter(F.coalesce(keys != X.words(sorted(K.RECORD_KEYS)), F.lit(True))),
                  "top-level keys mismatch: ", F.coalesce(list_text(keys), F.lit("[]")))]
    for name in ("patient_id", "patient_information_string"):
        x = F.try_variant_get("v", f"$.{name}", "variant")
        text = F.try_variant_get("v", f"$.{name}", "string")
        rules.append(_err(rows.filter(~starts(x, "STRING") | (text == "")),
                          f"{name} must be a non-empty string"))
    trials = rows.withColumn("list", F.try_variant_get("v", "$.candidate_trials",
                                                       "array<variant>"))
    rules.append(_err(trials.filter(F.coalesce(F.size("list"), F.lit(0)) <= 0),
                      "candidate_trials must be a non-empty list"))
    t = trials.select("patient_id", F.posexplode("list").alias("i", "t"))
    path = F.concat(F.lit("candidate_trials["), F.col("i").cast("string"), F.lit("]"))

    def allowed(df, value, allow, where):
        extra = F.array_sort(F.array_except(variant_keys(value), X.words(allow)))
        return _err(df.filter(F.size(extra) > 0), where, " has unexpected keys: ",
                    list_text(extra))
    rules.append(_err(t.filter(~starts(F.col("t"), "OBJECT")), path, " must be an object"))
    rules.append(allowed(t, F.col("t"), K.TRIAL_KEYS, path))
    rules.append(_err(t.filter(starts(F.col("t"), "OBJECT") & (F.coalesce(F.try_variant_get(
        "t", "$.trial_id", "string"), F.lit("")) == "")), path, ".trial_id must be present"))
    for name, allow in (("known_structured_fields", K.STRUCTURED_KEYS),
                        ("raw_criteria_excerpt", K.EXCERPT_KEYS)):
        x = F.try_variant_get("t", f"$.{name}", "variant")
        given = t.filter(x.isNotNull() & ~starts(x, "VOID"))
        rules.append(_err(given.filter(~starts(x, "OBJECT")), path,
                          f".{name} must be an object when present"))
        rules.append(allowed(given, x, allow, F.concat(path, F.lit("." + name))))
    cl = t.withColumn("cl", F.try_variant_get("t", "$.criteria_to_assess", "array<variant>"))
    rules.append(_err(cl.filter(starts(F.col("t"), "OBJECT") & F.col("cl").isNull()), path,
                      ".criteria_to_assess must be a list"))
    c = cl.select("patient_id", path.alias("path"), F.posexplode("cl").alias("j", "c"))
    cpath = F.concat(F.col("path"), F.lit(".criteria_to_assess["), F.col("j").cast("string"),
                     F.lit("]"))
    rules.append(_err(c.filter(~starts(F.col("c"), "OBJECT")), cpath, " must be an object"))
    rules.append(allowed(c, F.col("c"), K.CRITERION_KEYS, cpath))
    rules.append(_err(c.filter(starts(F.col("c"), "OBJECT") & (F.coalesce(F.try_variant_get(
        "c", "$.criterion_id", "string"), F.lit("")) == "")), cpath,
        ".criterion_id must be present"))
    hits = scan_keys(records, record, key=key)
    rules.append(hits.filter("kind = 'key'").select("patient_id", F.concat(
        "path", F.lit(" is forbidden in blinded input")).alias("error")))
    rules.append(hits.filter("kind = 'value'").select("patient_id", F.concat(
        "path", F.lit(" contains evaluator-only field text")).alias("error")))
    return _all(rules)


def _path_scanner(exact: Sequence[str], fragments: Sequence[str], value_pattern: str | None,
                  fold_case: bool):
    names, parts = frozenset(exact), tuple(fragments)
    value = re.compile(value_pattern) if value_pattern else None

    def hits(text):
        out, todo = [], []
        try:
            todo.append(("$", json.loads(text)))
        except (TypeError, ValueError):
            return out
        while todo:
            path, node = todo.pop()
            if isinstance(node, dict):
                below = []
                for key, child in node.items():
                    here = f"{path}.{key}"
                    word = key.lower() if fold_case else key
                    if word in names or any(p in word for p in parts):
                        out.append({"kind": "key", "path": here})
                    below.append((here, child))
                todo.extend(reversed(below))
            elif isinstance(node, list):
                todo.extend((f"{path}[{i}]", x) for i, x in reversed(list(enumerate(node))))
            elif value and isinstance(node, str) and value.search(node):
                out.append({"kind": "value", "path": path})
        return out

    @F.pandas_udf("array<struct<kind:string,path:string>>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(hits)
    return scan


def scan_keys(records: DataFrame, record: str = "record", *, key: str = "patient_id",
              exact: Sequence[str] = K.FORBIDDEN_KEYS, fragments: Sequence[str] = (),
              value_pattern: str | None = K.FORBIDDEN_VALUE_PATTERN, fold_case: bool = False
              ) -> DataFrame:
    """Paths of forbidden keys (and texts) at any depth: ``(patient_id, kind, path)``.

    Rows without any forbidden word are dropped by one regular expression in the JVM, so
    only suspicious records are walked.
    """
    alternatives = "|".join(re.escape(w) for w in [*exact, *fragments])
    # an escaped letter could spell a key another way, so rows with \\u escapes are walked too
    prefilter = f"(?i){alternatives}|\\\\u"
    suspicious = records.filter(F.col(record).rlike(prefilter))
    hits = _path_scanner(exact, fragments, value_pattern, fold_case)(F.col(record))
    return suspicious.select(F.col(key).cast("string").alias("patient_id"),
                             F.explode(hits).alias("h")).select("patient_id", "h.kind", "h.path")


def scan_secrets(df: DataFrame, text: str, key: str,
                 patterns: Sequence[str] = K.SECRET_PATTERNS) -> DataFrame:
    """Rows whose text matches a secret pattern: ``(key, pattern_no, n)`` matches."""
    found = F.array(*[F.struct(F.lit(i).alias("pattern_no"), F.regexp_count(
        F.col(text), F.lit(p)).cast("int").alias("n")) for i, p in enumerate(patterns)])
    return df.select(key, F.explode(found).alias("s")).select(key, "s.pattern_no", "s.n").filter(
        "n > 0")


def json_line_errors(lines: DataFrame, key: str, text: str = "value") -> DataFrame:
    """Lines that do not parse or are not objects: ``(key, error)``; blank lines pass."""
    v = strict_json(text)
    rows = lines.filter(X.strip(text) != "").select(key, v.alias("v"))
    return rows.select(key, F.when(F.col("v").isNull(), "invalid JSON").when(
        ~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "row is not an object")
        .alias("error")).filter(F.col("error").isNotNull())


def path_errors(files: DataFrame, path: str = "path", terms: Sequence[str] = K.FORBIDDEN_PATH_TERMS
                ) -> DataFrame:
    """Listed files whose path holds a forbidden term (``outputs`` folders are skipped)."""
    low = F.lower(F.translate(F.col(path), "\\", "/"))
    hit = F.explode(F.filter(X.words(terms), lambda t: F.contains(low, t)))
    return files.filter(~low.rlike("^outputs/")).select(path, hit.alias("term"))


def workspace_errors(files: DataFrame) -> DataFrame:
    """Path terms, secrets and JSON checks of a ``(path, content)`` file listing.

    File contents are split into lines first, so JSON-lines files of any size are checked
    row by row.
    """
    text = F.decode("content", "UTF-8")
    base = files.select("path", text.alias("text"))
    low = F.lower("path")
    rules = [path_errors(files).select("path", F.concat(
        F.lit("forbidden evaluator-only path term '"), "term", F.lit("'")).alias("error"))]
    rules.append(scan_secrets(base, "text", "path").select(
        "path", F.lit("possible secret or bearer token").alias("error")))
    lines = base.filter(F.endswith(low, F.lit(".jsonl"))).select(
        "path", F.posexplode(F.split("text", "\r?\n")).alias("line", "value"))
    docs = base.filter(F.endswith(low, F.lit(".json"))).select(
        "path", F.lit(0).alias("line"), F.col("text").alias("value"))
    rules.append(json_line_errors(lines, "path").select("path", "error"))
    bad = docs.filter(strict_json("value").isNull())
    rules.append(bad.select("path", F.lit("invalid JSON").alias("error")))
    both = lines.unionByName(docs)
    keys = scan_keys(both, "value", key="path", value_pattern=None)
    rules.append(keys.select(F.col("patient_id").alias("path"), F.concat(
        "path", F.lit(": forbidden evaluator-only key")).alias("error")))
    return _all(rules)


def gate(errors: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """One row with the number of contract errors and of checked rows; the job fails if there are
    errors, so nothing behind it runs on rows that break the contract."""
    found = errors.agg(F.count(F.lit(1)).alias("errors"))
    if checked is not None:
        found = found.withColumn("checked", checked.agg(F.count(F.lit(1)).alias("n")).scalar())
    message = F.concat(F.lit("contract errors: "), F.col("errors").cast("string"))
    return found.filter(F.assert_true(F.col("errors") == 0, message).isNull())


def last_per_patient(rows: DataFrame, pos: str) -> DataFrame:
    """Last record of each patient, ordered by patient."""
    known = rows.filter(X.blank_to_null("patient_id").isNotNull())
    return keep_last(known, ["patient_id"], pos).orderBy("patient_id")
