"""Text, number, date and URL rules shared by all areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of ECMAScript, as a character class body and as plain characters.
OTHER_SPACE = (
    r"\t\n\x0b\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}\x{feff}"
)
SPACE = OTHER_SPACE + " "
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Words dropped when a domain is guessed from a company name.
LISTING_STOP_WORDS = (
    "company", "companies", "corporation", "corp", "inc", "llc", "holdings", "group",
    "international", "systems", "technologies", "technology", "services", "the",
)
REGISTRY_STOP_WORDS = (
    "company", "companies", "corporation", "corp", "inc", "holdings", "group", "international",
    "industries", "systems", "technologies", "technology", "financial", "services", "insurance", "the",
)

# Host of an absolute URL, after trimming and lower-casing; user info and port are skipped.
URL_HOST = (
    r"^(?:(?:https?|ftp|wss?):[/\\]*|[a-z][a-z0-9+.-]*://)"
    r"(?:[^/?#\\]*@)?"
    r"(\[[0-9a-f:.]+\]|[a-z0-9._~!$&()*+,;={}\p{L}\p{N}-]+)(?::[0-9]*)?(?:[/?#\\]|\z)"
)
# Everything before the path, and the path itself.
URL_START = r"^(?:(?:[hH][tT][tT][pP][sS]?|[fF][tT][pP]|[wW][sS][sS]?):[/\\]*|[a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#\\]+"
URL_PATH = URL_START + r"(/[^?#]*)"

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """Strip every ECMAScript space character at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def collapse_space(c: Column) -> Column:
    """Every run of white space becomes one blank.

    The wide character class is only used on non-ASCII text, and single blanks are left alone.
    """
    narrow = F.regexp_replace(c, r"[\t\n\x0b\f\r]\s*| \s+", " ")
    wide = F.regexp_replace(c, f"[{OTHER_SPACE}][{SPACE}]*| [{SPACE}]+", " ")
    return F.when(is_ascii(c), narrow).otherwise(wide)


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor '', else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def clean(c: Column) -> Column:
    """Collapse white space, drop a value that is only 'nan', then trim."""
    text = blank_if_null(c)
    return F.when(F.lower(text) == "nan", "").otherwise(F.trim(collapse_space(text)))


def clean_location(c: Column) -> Column:
    place = F.regexp_replace(clean(c), r"(?i)^Location: *", "")
    return F.regexp_replace(place, r"(?i), *US,? *[0-9]*\z", ", United States")


def split_tags(c: Column, most: int = 10) -> Column:
    parts = F.split(clean(c), r";|, (?=[A-Z0-9])")
    return F.slice(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def city_key(location: Column) -> Column:
    place = F.lower(location)
    # Place patterns and the city they stand for.
    return (
        F.when(place.rlike("los angeles|lynwood|inglewood|lax|santa monica|burbank|pasadena"), "Los Angeles")
        .when(place.rlike("new york|brooklyn|queens|manhattan"), "New York")
        .when(place.rlike("san francisco|oakland|san jose|palo alto|redwood|mountain view"), "Bay Area")
        .when(place.rlike("chicago"), "Chicago")
        .when(place.rlike("austin"), "Austin")
        .otherwise("United States")
    )


def pay_max(pay: Column, commas: bool = False) -> Column:
    """Largest amount named in a pay text, 'k' meaning thousands; 0 without any amount.

    A thousands separator splits a number unless ``commas`` is set.
    """
    text = F.regexp_replace(pay, r"(?<=[0-9]),(?=[0-9]{3})", "") if commas else pay
    amounts = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?i)[0-9]+(?:\.[0-9]+)?k?"), F.lit(0)),
        lambda x: F.regexp_replace(x, "[kK]", "").cast("double")
        * F.when(F.lower(x).endswith("k"), 1000.0).otherwise(1.0),
    )
    return F.coalesce(F.array_max(amounts), F.lit(0.0))


def to_number(c: Column) -> Column:
    """Blank is 0, text that is no decimal number is NaN."""
    text = trim(blank_if_null(c))
    return (
        F.when(text == "", 0.0)
        .when(text.rlike(_NUMBER), text.try_cast("double"))
        .when(text.rlike(r"^[+]?Infinity\z"), float("inf"))
        .when(text == "-Infinity", float("-inf"))
        .otherwise(float("nan"))
    )


# Parts: day and month or month and day, year, hour, minute, second, half of the day, offset.
_WORDED = (
    r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?(?:([0-9]{1,2}) ([a-z]{3,9})|([a-z]{3,9}) ([0-9]{1,2})),? ([0-9]{4})"
    r"(?:,? ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([ap]m))?)?(?: ?(?:gmt|utc|z)?([+-][0-9]{2}:?[0-9]{2})?)?\z"
)
_SLASHED = r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?: ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?\z"


def _clock_millis(hour: Column, minute: Column, second: Column, half: Column | None = None) -> Column:
    """Milliseconds of a time of day given as texts, 0 for missing ones; NULL beyond a day."""
    def number(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.lit(0))

    h = number(hour)
    if half is not None:
        low = F.lower(half)
        h = F.when(low == "pm", h % 12 + 12).when(low == "am", h % 12).otherwise(h)
    in_range = (h < 24) & (number(minute) < 60) & (number(second) < 60)
    return F.when(in_range, (h * 3600 + number(minute) * 60 + number(second)).cast("long") * 1000)


def _worded_millis(text: Column) -> Column:
    def part(n: int) -> Column:
        return F.regexp_extract(text, _WORDED, n)

    month = F.initcap(F.substring(F.concat(part(2), part(3)), 1, 3))
    day = F.try_to_date(F.concat_ws(" ", month, F.concat(part(1), part(4)), part(5)), "MMM d yyyy")
    offset = F.replace(part(10), F.lit(":"))
    minutes = F.coalesce(F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int"), F.lit(0))
    ahead = F.when(offset.startswith("-"), -minutes).otherwise(minutes).cast("long") * 60000
    return F.unix_date(day).cast("long") * 86400000 + _clock_millis(part(6), part(7), part(8), part(9)) - ahead


def _slashed_millis(text: Column) -> Column:
    def part(n: int) -> Column:
        return F.regexp_extract(text, _SLASHED, n)

    day = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-M-d")
    return F.unix_date(day).cast("long") * 86400000 + _clock_millis(part(4), part(5), part(6))


def date_millis(c: Column) -> Column:
    """Epoch milliseconds of a date text, NULL where it cannot be read. Texts without a zone are UTC."""
    text = trim(blank_if_null(c))
    clock = r"[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"

    def at_midnight(day: Column) -> Column:
        return F.unix_date(day).cast("long") * 86400000

    return (
        F.when(text.rlike(r"^[0-9]{4}(-[0-9]{1,2}){0,2}\z"), at_midnight(text.try_cast("date")))
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}" + clock + r"(Z|[+-][0-9]{2}:?[0-9]{2})\z"),
              F.unix_millis(text.try_cast("timestamp")))
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}" + clock + r"\z"),
              F.unix_millis(F.concat(text, F.lit("Z")).try_cast("timestamp")))
        .when(text.rlike(_WORDED), _worded_millis(text))
        .when(text.rlike(_SLASHED), _slashed_millis(text))
        .when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"), at_midnight(F.try_to_date(text, "M/d/yyyy")))
    )


def freshness(posted: Column) -> Column:
    return F.coalesce(date_millis(posted), F.lit(0).cast("long"))


def slug(c: Column) -> Column:
    text = F.replace(F.lower(blank_if_null(c)), F.lit("&"), F.lit(" and "))
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))


def domain_guess(name: Column, stop_words: tuple[str, ...] = LISTING_STOP_WORDS) -> Column:
    text = F.replace(F.lower(blank_if_null(name)), F.lit("&"), F.lit("and"))
    text = F.regexp_replace(text, r"\b(" + "|".join(stop_words) + r")\b", "")
    return F.concat(F.regexp_replace(text, "[^a-z0-9]", ""), F.lit(".com"))


def url_host(url: Column) -> Column:
    """Lower-case host name of an absolute URL, '' where there is none."""
    return F.regexp_extract(F.lower(trim(blank_if_null(url))), URL_HOST, 1)


def url_path(url: Column) -> Column:
    path = F.regexp_extract(trim(blank_if_null(url)), URL_PATH, 1)
    return F.when(path == "", "/").otherwise(path)


def host_of_url(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.coalesce(F.nullif(name, F.lit("")), F.lit("?")), f"[{SPACE}]+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def snippet(c: Column, most: int) -> Column:
    text = clean(c)
    cut = F.concat(F.trim(F.substring(text, 1, most - 1)), F.lit("…"))
    return F.when(F.length(text) > most, cut).otherwise(text)


def first_sentence(c: Column, most: int) -> Column:
    text = clean(c)
    sentence = F.regexp_extract(text, r"^(.{20,}?[.!?](?: |\z))", 1)
    return snippet(F.when(sentence != "", sentence).otherwise(text), most)
