"""Scalar functions: coercions, names, ratings, probabilities, formats.

Everything is a column expression that Catalyst compiles, but for ``fold_text``:
Spark SQL has no Unicode decomposition, so that one is an Arrow-batched function.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the rating model.
INITIAL, K_TEAM, SCALE = 1500.0, 24.0, 400.0
TEAM_HALF_LIFE, PLAYER_HALF_LIFE = 180.0, 1095.0
K_PERFORMANCE = 0.0
PLAYER_SCALE = 2.7908753241263775
CLIP = 1e-12
Z_EPSILON = 1e-12
# Words that team names carry besides the name.
TEAM_FILLERS = ("team", "esports", "gaming", "club", "cs2")


def loose_number(c: Column) -> Column:
    """Double; what can't be read is null."""
    return c.cast("string").try_cast("double")


def strict_boolean(c: Column) -> Column:
    """true/1 and false/0 in any case and spacing; null is false; anything else fails the query."""
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(c.isNull(), F.lit(False))
        .when(text.isin("true", "1"), F.lit(True))
        .when(text.isin("false", "0"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c.cast("string"))).cast("boolean"))
    )


def lenient_boolean(c: Column) -> Column:
    """What a loose cast makes of a text: null is false, the empty text is false, any other text is true, "false" too."""
    return F.coalesce(c.cast("string") != "", F.lit(False))


def strict_time(c: Column, format: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A timestamp without zone; a null or unreadable text fails the query."""
    read = F.try_to_timestamp(c.cast("string"), F.lit(format)).cast("timestamp_ntz")
    return F.when(read.isNotNull(), read).otherwise(F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("timestamp_ntz"))


def displayed(c: Column, names: dict[str, str]) -> Column:
    """The name to show for each key; a key without one shows itself."""
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


def replaced_section(text: Column, begin: str, end: str, body: Column) -> Column:
    """The text with what stands between the two markers replaced; a text without both in this order is as it was."""
    start = F.locate(begin, text)
    stop = F.position(F.lit(end), text, F.greatest(F.lit(1), start + len(begin)))
    whole = F.concat(F.substr(text, F.lit(1), start + (len(begin) - 1)), F.lit("\n"), body, F.lit("\n"), F.substr(text, stop))
    return F.when((start > 0) & (stop > 0), whole).otherwise(text)


def is_boolean_text(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("true", "1", "false", "0")


def elo_expectation(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (b - a) / SCALE))


def decay(rating: Column, gap_days: Column, half_life: float) -> Column:
    """The rating drawn back to the initial one by half each half-life."""
    return INITIAL + (rating - INITIAL) * F.pow(F.lit(2.0), -gap_days / half_life)


def gap_days(now: Column, before: Column) -> Column:
    """Days with fractions between two timestamps, never negative; 0 for a first appearance."""
    micros = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0)), F.lit(0.0))


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))


def log_loss(y: Column, p: Column) -> Column:
    return -(y * F.log(clipped(p)) + (1 - y) * F.log(1 - clipped(p)))


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def pair_key(a: Column, b: Column, sep: str = "|") -> Column:
    """One key for both orders of a pair."""
    return F.array_join(F.array_sort(F.array(a.cast("string"), b.cast("string"))), sep)


def canonical_key(key: Column, *fallbacks: Column) -> Column:
    """The trimmed, lower-case key unless blank, else the first fallback."""
    return F.coalesce(F.nullif(F.lower(F.trim(key)), F.lit("")), *[F.lower(F.trim(f.cast("string"))) for f in fallbacks])


def player_key(id_: Column, name: Column, unknown: Column) -> Column:
    """``id:<n>``, else ``name:<normal>``, else ``unknown:<...>``."""
    number = loose_number(id_).cast("bigint").cast("string")
    return F.coalesce(F.concat(F.lit("id:"), number), F.concat(F.lit("name:"), F.nullif(name, F.lit(""))), F.concat(F.lit("unknown:"), unknown))


def ascii_key(c: Column) -> Column:
    """Lower-case letters and digits only: ``fold_text`` for ASCII input, without Python."""
    return F.coalesce(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit(""))


_NOT_KEY = re.compile(r"[^a-z0-9]+")


def fold(text: str | None) -> str:
    """Decomposed, ASCII only, case-folded, letters and digits only."""
    if text is None:
        return ""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return _NOT_KEY.sub("", plain.casefold())


@F.pandas_udf(StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action=None)


def team_text(c: Column) -> Column:
    """The name without filler words, ready for ``fold_text`` or ``ascii_key``."""
    return F.regexp_replace(F.lower(c), r"\b(" + "|".join(TEAM_FILLERS) + r")\b", " ")


def player_text(c: Column) -> Column:
    """The name up to the first " (" and the first comma."""
    return F.substring_index(F.substring_index(c, " (", 1), ",", 1)


def valid_slug(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^[a-z0-9_-]+$")


def percent(p: Column, digits: int = 1) -> Column:
    """A share as text, freed of its last bits and rounded before it is formatted."""
    return F.format_string(f"%.{digits}f%%", F.round(F.round(p.cast("double") * 100, 9), digits))


def standard_error(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / n)


def md5_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only; DuckDB computes the same."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(4503599627370496.0)


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between the knots, constant beyond them."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
        out = F.when(x <= x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit(slope)).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


def links(text: Column) -> Column:
    """Targets of markdown links."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
