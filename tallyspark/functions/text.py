"""Text functions: titles, prompts, completions, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_CHARS = 80
# Codes and column names that a rendered title must not contain, in the order they are taken out.
CODES = (
    "100-150k", "150k+", "25-50k", "50-100k", "<25k",
    "18-24", "25-34", "35-44", "45-54", "55-64", "65+",
    "age_bucket", "income_bucket", "household_size", "has_kids", "city_size",
    "education", "health_rating", "risk_tolerance", "purchase_frequency", "novelty_rate",
)
PAD = "(no further outcome)"


def scrub_title(title: Column) -> Column:
    """At most TITLE_CHARS characters, each code as a space; runs of space collapse if there are any."""
    out = F.substring(F.coalesce(title, F.lit("")), 1, TITLE_CHARS)
    for code in CODES:
        out = F.replace(out, F.lit(code), F.lit(" "))
    return F.trim(F.when(out.contains("  "), F.regexp_replace(out, r"\s+", " ")).otherwise(out))


def snake_case(name: str) -> str:
    """A column name in lower case, everything but letters and digits as single underscores, none at the ends."""
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in name.lower())
    return "_".join(out.split())


def cache_key(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *fields).cast("binary"), 256)


def model_id(name: Column) -> Column:
    return F.lower(F.replace(F.trim(name), F.lit("/"), F.lit("_")))


def outcomes(completion: Column, k: int) -> Column:
    """The first k lines of a completion that aren't blank, trimmed, filled up to k."""
    lines = F.filter(F.transform(F.split(completion, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.concat(F.slice(lines, 1, k), F.array_repeat(F.lit(PAD), k)), 1, k)


def tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def first_number(text: Column) -> Column:
    """The first number in a text, 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def alternatives_block(alternatives: Column, letters: str = "ABCDEFGHIJ") -> Column:
    """One line for each alternative (title, price), lettered; what is missing is n/a."""
    line = lambda a, i: F.concat(
        F.substring(F.lit(letters), i + 1, F.lit(1)), F.lit(") "), F.coalesce(a["title"], F.lit("n/a")), F.lit(" | $"), F.when(a["price"].isNull(), "n/a").otherwise(F.format_string("%.2f", a["price"]))
    )
    return F.array_join(F.transform(alternatives, line), "\n")


def rotations(items: Column, k: Column) -> Column:
    """The items turned left by k: rows of a Latin square."""
    n = F.size(items)
    shift = k % n
    return F.concat(F.slice(items, shift + 1, n - shift), F.slice(items, 1, shift))


def title_of_alternative(title: Column, category: Column, price: Column, popularity: Column) -> Column:
    return F.concat_ws(". ", F.coalesce(title, F.lit("")), F.concat(F.lit("Category: "), category), F.concat(F.lit("Price: $"), F.format_string("%.1f", price)), F.concat(F.lit("Popularity: "), popularity.cast("string")))
