"""Text normalisation as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic characters and what they stand for.
ONE_TO_ONE = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‒": "-", "―": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "•": " ", "·": " ", "●": " "}
ONE_TO_MANY = {"…": "...", "ﬀ": "FF", "ﬁ": "FI", "ﬂ": "FL", "ﬃ": "FFI", "ﬄ": "FFL", "æ": "AE", "Æ": "AE", "œ": "OE", "Œ": "OE", "ß": "SS"}
# Characters a recogniser confuses, and each class's letter.
CONFUSED = {"0": "O", "1": "I", "L": "I", "5": "S", "8": "B", "2": "Z", "6": "G"}

#: Latin letters with one accent, and their plain letters: NFKD without Python for common text.
_ACCENTED = [chr(c) for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFKD", chr(c))) == 2 and unicodedata.combining(d[1])]
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


@F.pandas_udf(T.StringType())
def nfkd_stripped(texts: pd.Series) -> pd.Series:
    """Any script: compatibility decomposition without combining marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def strip_accents(c: Column, any_script: bool = False) -> Column:
    """Accents off. Built in for Latin letters; any_script decomposes everything, in Python batches."""
    return nfkd_stripped(c) if any_script else F.translate(c, "".join(_ACCENTED), _PLAIN)


def substitute(c: Column) -> Column:
    c = F.translate(c, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))
    for old, new in ONE_TO_MANY.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_confused(c: Column) -> Column:
    """Confusable characters to one letter of their class, but not in tokens of digits only."""
    tokens = F.split(c, " ")
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^[\d.,]+$"), t).otherwise(F.translate(t, "".join(CONFUSED), "".join(CONFUSED.values())))), " ")


def fold_character(c: Column) -> Column:
    return F.translate(F.upper(c), "".join(CONFUSED), "".join(CONFUSED.values()))


def canonical(c: Column, fold: bool = True, any_script: bool = False) -> Column:
    """Name-like text for comparison: no case, accents, punctuation or spacing; confusions folded.

    A dot between two digits stays. The result is its own canonical form.
    """
    c = F.upper(strip_accents(substitute(c), any_script))
    c = F.translate(c, "'ʼ’", "")
    c = collapse(F.regexp_replace(c, r"(?U)(?<!\d)[^\w\s]|[^\w\s](?!\d)|(?<=\d)[^\w\s.](?=\d)", " "))
    return fold_confused(c) if fold else c


def canonical_numeric(c: Column, any_script: bool = False) -> Column:
    """Upper case, plain letters and single spaces; digits and punctuation untouched."""
    return collapse(F.upper(strip_accents(substitute(c), any_script)))


def despaced(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def anchor_form(c: Column) -> Column:
    return despaced(canonical(c))


def all_caps(raw: Column) -> Column:
    """At least one letter, none of them other than upper case; judged on the raw text."""
    return raw.rlike(r"\p{L}") & ~raw.rlike(r"[\p{L}&&[^\p{Lu}]]")


def tokens(canonical_text: Column) -> Column:
    return F.filter(F.split(canonical_text, " "), lambda t: t != "")


def sorted_tokens(canonical_text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(canonical_text)), " ")


def expand(canonical_text: Column, table: dict[str, str]) -> Column:
    """Whole-token abbreviations replaced; the table's keys are canonical single tokens."""
    if not table:
        return canonical_text
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(canonical_text, " "), lambda t: F.coalesce(F.try_element_at(entries, t), t)), " ")


def expand_readable(plain: Column, folded: Column, table: dict[str, str], readable: dict[str, str]) -> Column:
    """Abbreviations replaced in unfolded text, recognised by its folded tokens; as it is where the counts differ."""
    entries = F.create_map(*[F.lit(x) for k, v in readable.items() for x in (k, v)]) if readable else F.create_map()
    a, b = F.split(plain, " "), F.split(folded, " ")
    return F.when(F.size(a) != F.size(b), plain).otherwise(F.array_join(F.zip_with(a, b, lambda p, f: F.coalesce(F.try_element_at(entries, f), p)), " "))


def unit_wording(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z]+", " "))


def printed_number(c: Column) -> Column:
    """1,000 is a thousand; any other comma is a decimal point. Null if it is no number."""
    thousands = c.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$")
    return F.when(thousands, F.replace(c, F.lit(","), F.lit(""))).otherwise(F.replace(c, F.lit(","), F.lit("."))).try_cast("double")


# Digits of the statute's enumerators and the letters they are read as.
ENUMERATORS = {"0": "O", "1": "I", "2": "Z", "5": "S", "6": "G", "8": "B"}


def enumerator_fold(c: Column) -> Column:
    return F.translate(c, "".join(ENUMERATORS), "".join(ENUMERATORS.values()))


def quote_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" ,.;:"))


def fragments(c: Column) -> Column:
    """Parts between brackets of a text without spaces; none for other texts."""
    parts = F.filter(F.split(c, r"[()\[\]{}]"), lambda x: x != "")
    return F.when(F.instr(c, " ") > 0, F.array().cast("array<string>")).otherwise(parts)


