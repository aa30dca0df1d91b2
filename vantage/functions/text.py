"""Text rules as column expressions. Patterns avoid look-around, so any regular-expression engine reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight compass codes and their bearings.
COMPASS = {"N": 0, "NE": 45, "E": 90, "SE": 135, "S": 180, "SW": 225, "W": 270, "NW": 315}
#: Number words that stand for a count.
NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8}


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def sentences(text: Column, shortest: int = 1) -> Column:
    """Parts after full stops and semicolons that a blank follows, trimmed; those shorter than shortest go."""
    parts = F.split(F.regexp_replace(squeeze(text), r"([.;]) ", "$1\n"), "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= shortest)


def direction_code(text: Column) -> Column:
    """A compass code from how a direction is written: letters only, words or codes in either case."""
    bare = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    for word, code in (("NORTH", "N"), ("SOUTH", "S"), ("EAST", "E"), ("WEST", "W")):
        bare = F.replace(bare, F.lit(word), F.lit(code))
    return F.when(bare.isin(*COMPASS), bare)


def direction_degrees(text: Column) -> Column:
    """Bearing of a code or of a number, which wraps at 360."""
    table = F.create_map(*(F.lit(x) for kv in COMPASS.items() for x in (kv[0], float(kv[1]))))
    return F.coalesce(F.element_at(table, direction_code(text)), F.pmod(text.try_cast("double"), F.lit(360.0)))


def first_count(text: Column, noun: str) -> Column:
    """The number stated before a noun, as digits or word, with up to three words between; null if there is none."""
    found = F.regexp_extract(F.lower(text), rf"(?:^|[ \n])([0-9]+|{'|'.join(NUMBER_WORDS)}) (?:[a-z]+ ){{0,3}}?{noun}", 1)
    table = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    return F.when(found != "", F.coalesce(F.element_at(table, found).cast("bigint"), found.try_cast("bigint")))


def is_title(line: Column, most_words: int = 9) -> Column:
    """A short line, half of whose words begin with a capital."""
    words, capital = F.regexp_count(line, F.lit("[^ ]+")), F.regexp_count(line, F.lit("(^| )[A-Z]"))
    return (words > 0) & (words <= most_words) & (2 * capital >= words)


def shorten(values: Column, most: int = 8) -> Column:
    """The first so many of an array, joined by bars."""
    return F.array_join(F.slice(values, 1, most), "|")
