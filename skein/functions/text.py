"""Names and tokens as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters that decompose into a base letter and marks, and those base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def fold_accents(c: Column) -> Column:
    """Drops accents of Latin letters (and free combining marks)."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}+", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """accents dropped, lower case, punctuation to blanks, blanks collapsed; digits and underscores stay."""
    return collapse(F.regexp_replace(F.lower(fold_accents(c)), r"[^\p{L}\p{N}_\s]", " "))


# Generational suffixes that structural normalisation drops, and sports of individuals.
DROP_TOKENS = ("jr", "sr", "ii", "iii", "iv")
INDIVIDUAL_SPORTS = ("tennis", "mma", "boxing", "golf", "snooker", "darts")


def structural_tokens(c: Column) -> Column:
    """tokens of the normalised name without text in parentheses and without generational suffixes."""
    bare = normalize_name(F.regexp_replace(c, r"\([^)]*\)", " "))
    return F.filter(F.split(bare, " "), lambda t: (t != "") & ~t.isin(*DROP_TOKENS))


def structural_name(c: Column, sport: Column) -> Column:
    """struct(path, surname, others, is_personal); null where no token is left."""
    tokens = structural_tokens(c)
    n, last = F.size(tokens), F.try_element_at(tokens, F.lit(-1))
    personal = F.lower(F.coalesce(sport, F.lit(""))).isin(*INDIVIDUAL_SPORTS)
    initial = (n == 2) & (F.length(last) <= 2)
    path = F.when(~personal, F.when(n == 1, "team_simple").otherwise("team_qualified")).when(n == 1, "personal_single").when(initial, "personal_initial").when(n == 2, "personal_two_token").otherwise("personal_multi")
    surname = F.when(~personal, "").when(initial, F.get(tokens, F.lit(0))).otherwise(last)
    others = F.when(~personal, tokens).when(initial, F.slice(tokens, 2, 1)).otherwise(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))))
    return F.when(n > 0, F.struct(path.alias("path"), surname.alias("surname"), others.alias("others"), personal.alias("is_personal")))


def slug(c: Column) -> Column:
    """lower-case letters and digits, other runs as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(c: Column, least: int = 1) -> Column:
    """distinct tokens of at least ``least`` characters of a normalised name."""
    return F.array_distinct(F.filter(F.split(normalize_name(c), " "), lambda t: F.length(t) >= least))


def distinctive(c: Column, generic: list[str]) -> Column:
    """tokens that aren't generic."""
    return F.filter(tokens(c), lambda t: ~t.isin(*generic))


def trigrams(c: Column) -> Column:
    """distinct trigrams of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def jaccard(a: Column, b: Column) -> Column:
    """shared over all elements of two arrays of distinct elements; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def initials_compatible(short: Column, long: Column) -> Column:
    """every token of at most two letters of either side begins some longer token of the other."""
    covered = lambda a, b: F.forall(F.filter(a, lambda t: F.length(t) <= 2), lambda s: F.exists(b, lambda t: (F.length(t) > 2) & t.startswith(s)))
    return covered(short, long) & covered(long, short)


def surname_readings(t: Column) -> Column:
    """last token, last two together, and the middle one of three, distinct."""
    n = F.size(t)
    pair = F.when(n >= 2, F.concat_ws(" ", F.slice(t, -2, 2)))
    middle = F.when(n >= 3, F.try_element_at(t, F.lit(-2)))
    return F.array_distinct(F.array_compact(F.array(F.try_element_at(t, F.lit(-1)), pair, middle)))


def after_last(c: Column, mark: str) -> Column:
    """The trimmed text after the last ``mark``."""
    return F.trim(F.element_at(F.split(c, mark), -1))


def after_first(c: Column, mark: str) -> Column:
    """The trimmed text after the first ``mark``, or null without one."""
    return F.when(F.instr(c, mark) > 0, F.trim(F.substr(c, F.instr(c, mark) + len(mark))))


# Patterns of a full name, and of a surname with an initial and perhaps a country.
FULL_NAME = r"^[A-Za-z\u00C0-\u024F]{2,} [A-Za-z\u00C0-\u024F]{2,}$"
SHORT_NAME = r"^[A-Za-z\u00C0-\u024F]{2,} [A-Za-z]\.(?: \([A-Za-z]{2,4}\))?$"


def name_format(c: Column) -> Column:
    """class_f (First Last), class_s (Last F.), or unclassified."""
    name = F.trim(F.coalesce(c, F.lit("")))
    return F.when(name.rlike(FULL_NAME), "class_f").when(name.rlike(SHORT_NAME), "class_s").otherwise("unclassified")


def format_match(full: Column, short: Column) -> Column:
    """the full name's first letter is the short one's initial, and the surnames are the same."""
    f, s = F.split(F.lower(F.trim(full)), r"\s+"), F.split(F.lower(F.trim(short)), r"\s+")
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    return F.coalesce((F.size(f) >= 2) & (F.size(s) >= 2) & (F.substring(at(f, 1), 1, 1) == F.substring(at(s, 2), 1, 1)) & (at(f, -1) == at(s, 1)), F.lit(False))


# How team names in titles are made alike.
TITLE_STEPS = (
    (r"\s*\(\s*[A-Za-z]{2,4}\s*\)\s*$", ""), (r"(?i)\bAtl\.\s*", "Atletico "), (r"(?i)\bSt\.\s*", "Saint "), (r"(?i)\bU\.\s*", "Universidad "), (r"(?i)\bDep\.\s*", "Deportivo "),
    (r"(?i)^(?:Deportes|Deportivo|Club|CD|FC|AC|SC|CF|AS|SK)\s+", ""),
)


def title_name(c: Column) -> Column:
    """a team's name as titles have it: no country, short forms written out, no generic first word, lower case."""
    return F.lower(F.trim(chain(F.trim(F.coalesce(c, F.lit(""))), *TITLE_STEPS)))


def title_tokens(c: Column) -> Column:
    """distinct tokens of three letters or digits or more of ``title_name``."""
    return F.array_distinct(F.filter(F.split(title_name(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


def cache_key(c: Column) -> Column:
    """lower case without accents, blanks collapsed; punctuation stays."""
    return collapse(F.lower(fold_accents(c)))


def chain(c: Column, *pairs: tuple[str, str]) -> Column:
    """regular replacements in order."""
    return reduce(lambda x, p: F.regexp_replace(x, *p), pairs, c)
