"""Column functions of the request layer."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far the slider goes, and the rank of a name that has none.
LIMIT = 0.9999
LAST = 2147483647


def clamp_slider(c: Column) -> Column:
    """c within +-0.9999; what isn't finite is 0."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c)))


def session_key(forwarded: Column, host: Column) -> Column:
    """The forwarded host, else the host, in small letters; 'default' if both are blank."""
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(F.lower(full(forwarded)), F.lower(full(host)), F.lit("default"))


def year_label(name: Column, year: Column) -> Column:
    """name (year), without a year that is null or 0."""
    return F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(name, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(name)


#: The characters that get a backslash in Markdown.
MARKDOWN = r"([\\`*_{}\[\]()#+\-.!|>])"


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, MARKDOWN, r"\\$1")


def four_places(x: Column) -> Column:
    """Fixed four decimals of a number below 9e14 or so, halves up."""
    n = F.floor(F.abs(x) * 10000 + 0.5)
    sign = F.when((x < 0) & (n > 0), F.lit("-")).otherwise("")
    return F.concat(sign, F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("long").cast("string"), 4, "0"))
