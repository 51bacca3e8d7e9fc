"""Column expressions on text, numbers and dates: built-in functions only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number written as text: no blanks, suffixes or NaN, which casts would let pass.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Business keywords in the order in which they decide, and what each group says.
KEYWORD_CLASSES = (
    ("customer|client|account", "customer"),
    ("transaction|trade|payment", "transaction"),
    ("position|holding|portfolio", "position"),
    ("balance|reconciliation", "balance"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content(c: Column | str) -> Column:
    """The trimmed text; blank counts as null."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def is_number(v: Column) -> Column:
    """Null for null; else whether the text is a number of our grammar."""
    return v.rlike(NUMBER)


def is_integer(v: Column) -> Column:
    """Numbers without a point; an exponent is allowed."""
    return is_number(v) & ~v.contains(".")


def to_number(v: Column, scale: int = 10) -> Column:
    """An exact decimal, or null where the text is no number or too large."""
    return F.when(is_number(v), v.try_cast(f"decimal(38,{scale})"))


def digits(v: Column) -> Column:
    """Length without signs and point."""
    return F.length(F.regexp_replace(v, "[-+.]", ""))


def scale_of(v: Column) -> Column:
    """Characters after the first point; 0 without one."""
    at = F.instr(v, ".")
    return F.when(at > 0, F.length(v) - at).otherwise(F.lit(0))


def has_leading_zero(v: Column) -> Column:
    return is_number(v) & (F.length(v) > 1) & v.startswith("0") & (F.substring(v, 2, 1) != ".")


def is_flag(v: Column) -> Column:
    return F.upper(v).isin("Y", "N", "T", "F", "0", "1")


def hash32(v: Column) -> Column:
    """32 bits of the text's digest, the same in any engine."""
    return F.conv(F.substring(F.md5(v), 1, 8), 16, 10).cast("bigint")


def rounded(x: Column, places: int) -> Column:
    """Half up by plain double arithmetic, as engines' own rounding of doubles differs."""
    by = float(10**places)
    return F.floor(x.cast("double") * by + F.lit(0.5)) / F.lit(by)


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def safe(c: Column | str, default: str = "") -> Column:
    """Null, empty and texts that stand for nothing become the default."""
    c = F.trim(col(c).cast("string"))
    return F.when(c.isNull() | c.isin("nan", "None", ""), F.lit(default)).otherwise(c)


def normal(c: Column | str) -> Column:
    """Lower case without underscores, blanks and hyphens between, and without white space at the ends."""
    lowered = F.regexp_replace(F.lower(safe(c)), "[_ -]", "")
    return F.regexp_replace(lowered, r"^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """Distinct words of a text, separated by white space."""
    return F.array_distinct(F.filter(F.split(F.lower(safe(c)), r"[\s_-]+"), lambda w: w != ""))


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def contains_either(a: Column, b: Column) -> Column:
    """Non-empty on both sides, and one of them within the other."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def pascal(c: Column | str) -> Column:
    """Runs of letters and digits, each with a capital first; ``Entity`` if there is none."""
    runs = F.regexp_extract_all(col(c), F.lit("[A-Za-z0-9]+"), F.lit(0))
    made = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")
    return F.when(F.coalesce(F.length(made), F.lit(0)) > 0, made).otherwise(F.lit("Entity"))


def column_name(name: str) -> str:
    """A heading as a column's name."""
    out = name.strip().lower()
    for a, b in ((" ", "_"), ("/", "_"), ("-", "_"), ("(", ""), (")", ""), ("#", "num")):
        out = out.replace(a, b)
    return out.strip("_")


def looks_numeric(c: Column) -> Column:
    """Digits only, once points, hyphens and blanks are away."""
    return F.regexp_replace(c, "[-. ]", "").rlike("^[0-9]+$")


def comma_list(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(safe(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def page_label(pages: Column) -> Column:
    """``a`` or ``a-b`` of sorted page numbers."""
    first, last = F.element_at(pages, 1), F.element_at(pages, -1)
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def keyword_class(c: Column | str, default: str = "general") -> Column:
    text = F.lower(col(c))
    out = F.lit(default)
    for pattern, label in reversed(KEYWORD_CLASSES):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def row_contains(columns: list[str], needle: str) -> Column:
    """Whether any of the row's values holds the needle, whatever its case."""
    return F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))).contains(needle.lower())


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def banded(x: Column, bands: tuple[tuple[float, int], ...], below: int = 0) -> Column:
    """The value of the first band whose lower end x reaches; bands from high to low."""
    out = F.lit(below)
    for at, value in reversed(bands):
        out = F.when(x >= at, value).otherwise(out)
    return out
