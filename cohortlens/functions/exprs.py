"""Column helpers shared by all operators.  Built-in expressions only."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\u000b\f"


def reused(build):
    """Keep the columns a builder makes, per Spark application and arguments.

    A column is only a description, so it can stand in any number of plans; the large ones
    take seconds to put together through the gateway and milliseconds to use again.
    """
    made = {}

    @functools.wraps(build)
    def get(*args, **kwargs):
        context = SparkContext._active_spark_context
        key = (context.applicationId, args, tuple(sorted(kwargs.items())))
        if key not in made:
            made[key] = build(*args, **kwargs)
        return made[key]
    return get


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values: Sequence[str]) -> Column:
    """An array literal of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else no_strings()


def no_strings() -> Column:
    return F.array().cast("array<string>")


def padded(n: Column, width: int) -> Column:
    """A number as text with leading zeros; longer numbers stay whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(col(c).cast("string")), F.lit(""))


def first_text(*cols: Column | str) -> Column:
    """First non-empty text (an empty string counts as absent), trimmed."""
    return F.coalesce(*[blank_to_null(F.nullif(col(c).cast("string"), F.lit(""))) for c in cols])


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def as_int(c: Column | str) -> Column:
    """Integer or NULL: blank text and unreadable text give NULL."""
    return blank_to_null(c).try_cast("int")


def as_number(c: Column | str) -> Column:
    """Double; unreadable text and NaN give 0."""
    v = col(c).cast("string").try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


def string_list(c: Column | str) -> Column:
    """NULL gives the empty list."""
    return F.coalesce(col(c), no_strings())


def scalar_to_list(c: Column | str) -> Column:
    """One string gives a one-element list, NULL the empty list."""
    return F.when(col(c).isNull(), no_strings()).otherwise(F.array(col(c).cast("string")))


def string_map(c: Column | str) -> Column:
    return F.coalesce(col(c), F.create_map().cast("map<string,string>"))


def bool_map(c: Column | str) -> Column:
    return F.coalesce(col(c), F.create_map().cast("map<string,boolean>"))


def norm_key(c: Column | str) -> Column:
    """Lower-cased, trimmed, hyphens read as spaces; NULL reads as empty."""
    return F.translate(F.lower(strip(text_or_empty(c))), "-", " ")


def norm_text(c: Column | str) -> Column:
    """``norm_key`` with every run of whitespace squeezed to one space."""
    return F.regexp_replace(norm_key(c), r"\s+", " ")


def norm_stage(c: Column | str) -> Column:
    t = F.lower(strip(c))
    return (
        F.when(t == "4", "iv").when(t == "3", "iii").when(t == "2", "ii").when(t == "1", "i")
        .otherwise(t)
    )


def norm_flag(c: Column | str) -> Column:
    t = F.replace(norm_text(c), F.lit("exclude if patient has "), F.lit(""))
    t = F.replace(t, F.lit("exclude if "), F.lit(""))
    return F.btrim(F.regexp_replace(t, "[^a-z0-9]+", "_"), F.lit("_"))


def slug(c: Column | str, default: str = "criterion") -> Column:
    s = F.btrim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(default)).otherwise(s)


def spaced(c: Column | str) -> Column:
    """Underscores read as spaces."""
    return F.translate(col(c), "_", " ")


def squeeze(c: Column | str) -> Column:
    return strip(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def excerpt(c: Column | str, chars: int) -> Column:
    return F.substring(squeeze(c), 1, chars)


def cut(c: Column | str, chars: int) -> Column:
    """Text up to ``chars`` characters; longer text is cut and marked."""
    return F.when(F.length(col(c)) <= chars, col(c)).otherwise(
        F.concat(F.substring(col(c), 1, chars), F.lit("..."))
    )


def cut_list(c: Column | str, chars: int) -> Column:
    return F.transform(string_list(c), lambda x: cut(x, chars))


def printable(c: Column | str, chars: int | None = None) -> Column:
    """Tabs, line breaks and printable ASCII only."""
    t = F.regexp_replace(text_or_empty(c), r"[^\t\n\r -~]", "")
    return t if chars is None else F.substring(t, 1, chars)


def label_in(c: Column | str, allowed: Sequence[str], default: str | None = "") -> Column:
    """Whitelisted label in lower case, else ``default``."""
    t = F.lower(strip(text_or_empty(c)))
    return F.when(t.isin(list(allowed)), t).otherwise(F.lit(default))


def decision_label(c: Column | str) -> Column:
    """Decision with its spaced and hyphenated spellings, else the empty string."""
    t = F.lower(strip(text_or_empty(c)))
    return (
        F.when(t == "recommend", "recommend")
        .when(t.isin("needs_more_info", "needs more info", "needs-more-info"), "needs_more_info")
        .when(t.isin("not_recommended", "not recommended", "not-recommended"), "not_recommended")
        .otherwise("")
    )


def mapped(c: Column | str, table: dict, default=None) -> Column:
    """Look a label up in a small fixed table."""
    out = None
    for key, value in table.items():
        out = F.when(col(c) == key, F.lit(value)) if out is None else out.when(
            col(c) == key, F.lit(value))
    return out.otherwise(F.lit(default))


def round_exact(c: Column | str, places: int) -> Column:
    """Half-even rounding of the *binary* value, as IEEE-aware rounding does.

    ``bround`` works on the shortest decimal form and so takes 0.4625 (stored a little
    above) for a tie.  Here the rounding error of ``x * 10^places`` is recovered exactly
    (the product is split into two halves that multiply without error) and decides ties.
    """
    if not isinstance(c, str):
        return F.get(F.transform(F.array(c.cast("double")), lambda x: _rounded(x, places)), F.lit(0))
    return _rounded(F.col(c), places)


def _rounded(x: Column, places: int) -> Column:
    scale = F.lit(float(10 ** places))
    big = x * F.lit(134217729.0)
    hi = big - (big - x)
    p = x * scale
    err = (hi * scale - p) + (x - hi) * scale
    low = F.floor(p).cast("double")
    frac = p - low
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (low % 2 == 1))))
    return (low + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale


def half_even_div(n: Column | str, by: int) -> Column:
    """Integer quotient rounded half to even."""
    return F.bround(col(n).cast("double") / F.lit(float(by))).cast("int")


def safe_ratio(num: Column | str, den: Column | str, *, empty: float, places: int) -> Column:
    """Guarded, rounded ratio.  ``empty`` is the value for a zero denominator."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d == 0, F.lit(float(empty))).otherwise(
        round_exact(F.try_divide(n, d), places))


def f1(hit: Column | str, predicted: Column | str, gold: Column | str, places: int = 4) -> Column:
    d = (col(predicted) + col(gold)).cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(
        round_exact(F.try_divide(2.0 * col(hit).cast("double"), d), places))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_object(v: Column) -> Column:
    """Whether a VARIANT is a JSON object (looks at its top level only)."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def pick(arr: Column, pred) -> Column:
    """First element of ``arr`` that satisfies ``pred``, else NULL."""
    return F.get(F.filter(arr, pred), F.lit(0))


def some(cond: Column, value: Column) -> Column:
    """``[value]`` when the condition holds, else the empty list of the same type."""
    return F.filter(F.array(F.when(cond, value)), lambda x: x.isNotNull())


def prefixed(df, prefix: str, keep: Sequence[str] = ()):
    """Rename every column with a prefix, apart from ``keep``."""
    return df.select(
        *[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def sql_text(c: Column | str) -> Column:
    """Text of a value inside a message; NULL reads as ``None``."""
    return F.coalesce(col(c).cast("string"), F.lit("None"))
