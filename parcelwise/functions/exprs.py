"""Column expressions shared by the operators.

All of these are built-in Spark SQL expressions, so they stay inside whole-stage codegen;
nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_uniform(key: str | Column, salt: str) -> Column:
    """Deterministic uniform [0, 1) from md5(key || '-' || salt), first 32 bits.

    The same value is computed by DuckDB as
    ``('0x'||substr(md5(key||'-salt'),1,8))::bigint / 2^32``, so splits, folds and the
    planted fixture agree row by row across engines.
    """
    digest = F.md5(F.concat(col_(key).cast("string"), F.lit("-" + salt)))
    return F.conv(digest.substr(1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def hash_bits32(key: str | Column, salt: str) -> Column:
    """The same 32 bits as :func:`hash_uniform`, as a bigint in [0, 2^32)."""
    digest = F.md5(F.concat(col_(key).cast("string"), F.lit("-" + salt)))
    return F.conv(digest.substr(1, 8), 16, 10).cast("bigint")


# ---------------------------------------------------------------- messy-value parsing

# Currency prefixes seen in order exports, and the text that means "missing".
CURRENCY_PREFIX_PATTERN = r"^\s*(Rs\.?|INR)\s*"
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A"]


def null_tokens_to_null(c: str | Column) -> Column:
    """Map the text tokens a CSV export uses for 'missing' to a real NULL."""
    c = col_(c)
    return F.when(F.trim(c).isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def parse_currency(c: str | Column, parity: bool = False) -> Column:
    """'Rs 1,299' / 'INR 1,299' / 'Rs.1,299' / '1,299' -> 1299.0; anything else -> NULL.

    Default: strip the currency prefix first, then thousands commas, and accept only a
    plain signed decimal. ``parity=True`` keeps only digits and dots, the simpler rule
    (which turns 'Rs.1,299' into 0.1299 and loses signs), for side-by-side comparisons.
    """
    s = col_(c).cast("string")
    if parity:
        kept = F.regexp_replace(s, r"[^0-9.]", "")
        return F.when(kept == "", F.lit(None)).otherwise(kept).try_cast("double")
    stripped = F.translate(F.regexp_replace(s, CURRENCY_PREFIX_PATTERN, ""), ",", "")
    stripped = F.trim(stripped)
    return F.when(stripped.rlike(r"^-?[0-9]+(\.[0-9]+)?$"),
                  stripped.try_cast("double"))


def parse_percent(c: str | Column) -> Column:
    """'20%' / '20' -> 20.0; unparsable -> NULL (try_cast, never an ANSI error)."""
    s = F.trim(F.translate(col_(c).cast("string"), "%", ""))
    return F.when(s == "", F.lit(None)).otherwise(s).try_cast("double")


def tier_label(c: str | Column) -> Column:
    """First digit 1-3 anywhere in the text -> 'Tier-n'; no such digit -> NULL."""
    digit = F.regexp_extract(col_(c).cast("string"), r"([123])", 1)
    return F.when(digit != "", F.concat(F.lit("Tier-"), digit))


def title_case(c: str | Column) -> Column:
    """Title Case with Python ``str.title`` semantics for ASCII text.

    A letter is upper-cased when the previous character is not a letter, else
    lower-cased ('o'neil-smith' -> "O'Neil-Smith"); ``initcap`` would only look at spaces.
    Runs as a JVM higher-order function over the characters of the (short) value; a value
    of ASCII letters and spaces alone takes ``initcap``, which is the same there and quicker.
    """
    s = col_(c)
    chars = F.split(s, "")
    return F.when(s.rlike("^[A-Za-z ]*$"), F.initcap(s)).otherwise(F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when(
                (i == 0) | ~F.substring(s, i, 1).rlike("[A-Za-z]"), F.upper(ch)
            ).otherwise(F.lower(ch)),
        ),
        "",
    ))


def clean_state(c: str | Column) -> Column:
    """trim + Title Case; NULL becomes 'Unknown'."""
    return F.coalesce(title_case(F.trim(col_(c))), F.lit("Unknown"))


# ---------------------------------------------------------------- bands (left-open intervals)

def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str],
        include_lowest: bool = False) -> Column:
    """Interval labelling with (lo, hi] bins; out of range or NULL -> NULL.

    ``include_lowest`` makes the first bin closed on the left, as a quantile cut does.
    """
    x = col_(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
        cond = lower & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def cut_by_columns(c: str | Column, edge_cols: Sequence[Column], labels: Sequence[str],
                   include_lowest: bool = True) -> Column:
    """Like :func:`cut` but with edges given as columns (e.g. broadcast quantiles)."""
    x = col_(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edge_cols[i], edge_cols[i + 1]
        lower = (x >= lo) if (include_lowest and i == 0) else (x > lo)
        cond = lower & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


# Band edges and labels used by the descriptive chapters.
DISCOUNT_EDGES = [-1, 10, 25, 40, 100]
DISCOUNT_LABELS = ["0-10%", "11-25%", "26-40%", "40%+"]
PRIOR_RATE_EDGES = [-0.01, 0.0, 0.25, 0.5, 1.01]
PRIOR_RATE_LABELS = ["Never returned", "Returned 1-25%", "Returned 26-50%", "Returned >50%"]
HISTORY_EDGES = [-1, 0, 2, 5, 10, 9999]
HISTORY_LABELS = ["1st order", "2nd-3rd", "4th-6th", "7th-11th", "12th+"]
VALUE_QUARTILE_LABELS = ["Cheapest 25%", "Lower-mid", "Upper-mid", "Priciest 25%"]


# ---------------------------------------------------------------- score


def score_from_risk(p: str | Column) -> Column:
    """300-900 score: half-even rounding of 900 - 600 * p, as an int."""
    return F.bround(F.lit(900.0) - F.lit(600.0) * col_(p), 0).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 (never an ANSI divide-by-zero)."""
    return F.try_divide(num, den)
