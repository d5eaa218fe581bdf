"""Alcohol and volume statements in text: full matches of spans, searches in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.functions.similarity import METRIC, ML_PER_FL_OZ, ratio
from veritrail.functions.text import printed_number, unit_wording

# The shapes of statements.
ALC, VOL = r"ALC(?:OHOL|OH)?\.?", r"VOL(?:UME)?\.?"
ALC_VOL = rf"{ALC}\s*(?:/|BY|-)?\s*{VOL}"
ABV_NUMBER = r"(\d{1,2}(?:[.,]\d{1,2})?)"
PROOF_NUMBER = r"(\d{1,3}(?:[.,]\d)?)"
#: (tier, pattern); tiers: 0 labelled, 1 proof or fluid ounces, 2 bare percentage.
ABV = (
    (0, rf"{ABV_NUMBER}\s*%\s*(?:{ALC_VOL}|{ALC}|ABV)"),
    (0, rf"(?:{ALC_VOL}|ABV)\s*:?\s*{ABV_NUMBER}\s*%"),
    (0, rf"{ALC}\s*{ABV_NUMBER}\s*%\s*(?:BY\s*)?{VOL}"),
    (1, rf"{PROOF_NUMBER}\s*°?\s*PROOF"),
    (2, rf"{ABV_NUMBER}\s*%"),
)
WORDING = r"([A-Z][A-Z./\s-]{2,24})"
ABV_WORDINGS = ("ALC VOL", "ALC BY VOL", "ALCOHOL BY VOLUME", "ALCOHOL VOLUME", "ALC VOLUME")
PROOF_WORDINGS = ("PROOF",)
#: (tier, wordings, pattern, group of the number, group of the wording)
FUZZY = (
    (0, ABV_WORDINGS, rf"{ABV_NUMBER}\s*%\s*{WORDING}", 1, 2),
    (0, ABV_WORDINGS, rf"{WORDING}\s*:?\s*{ABV_NUMBER}\s*%", 2, 1),
    (1, PROOF_WORDINGS, rf"{PROOF_NUMBER}\s*°?\s*{WORDING}", 1, 2),
)
VOLUME_NUMBER = r"(\d{1,4}(?:,\d{3})*(?:[.,]\d+)?)"
UNITS = "|".join(sorted(METRIC, key=len, reverse=True))
FL_OZ = r"(?:U\.?\s*S\.?\s*)?(?:FL(?:UID)?\.?\s*(?:OZ|OUNCES?)\.?)"
VOLUME = ((0, rf"{VOLUME_NUMBER}\s*({UNITS})\.?"), (1, rf"{VOLUME_NUMBER}\s*({FL_OZ})"))
LEAD, TRAIL = r"[\s(\[{]*", r"[\s)\]}.,;:*]*"

HIT = "struct<tier: int, value: double, printed: string, unit: string, exact: boolean>"


def whole(pattern: str) -> str:
    return rf"(?U)^{LEAD}(?:{pattern}){TRAIL}$"


def search(pattern: str) -> str:
    return rf"(?U)(?<![\w.,])(?:{pattern})(?![A-Z])"


def _hit(ok: Column, tier: int, value: Column, printed: Column, unit: Column, exact: Column | None = None) -> Column:
    one = F.struct(F.lit(tier).alias("tier"), value.alias("value"), printed.alias("printed"), unit.alias("unit"), (exact if exact is not None else F.lit(True)).alias("exact"))
    return F.when(ok & value.isNotNull(), one)


def _abv_value(tier: int, number: Column) -> Column:
    v = printed_number(number)
    return F.when(v.between(0, 200), v / 2) if tier == 1 else F.when(v.between(0, 100), v)


def alcohol(text: Column, form=whole) -> Column:
    """The first pattern that matches a canonical_numeric text, as a hit struct; else null."""
    out = []
    for tier, pattern in ABV:
        number = F.regexp_extract(text, form(pattern), 1)
        out.append(_hit(text.rlike(form(pattern)), tier, _abv_value(tier, number), number, F.lit("proof" if tier == 1 else "%")))
    return F.coalesce(*out)


def alcohol_expected(text: Column) -> Column:
    """The application's value: the first pattern found anywhere, else a bare number."""
    bare = F.regexp_extract(text, r"^\s*" + ABV_NUMBER + r"\s*$", 1)
    return F.coalesce(alcohol(text, search), _hit(bare != "", 2, _abv_value(2, bare), bare, F.lit("%")))


def alcohol_fuzzy_parts(text: Column) -> list[tuple[int, tuple[str, ...], Column, Column, Column]]:
    """Per fuzzy pattern: tier, wordings, whether it matches, the number, the normalised wording."""
    return [(tier, words, text.rlike(whole(p)), F.regexp_extract(text, whole(p), n), unit_wording(F.regexp_extract(text, whole(p), w))) for tier, words, p, n, w in FUZZY]


def alcohol_fuzzy(text: Column, least: float) -> Column:
    """A number read strictly beside wording that is nearly a known phrase of five letters or more."""
    out = []
    for tier, words, matches, number, wording in alcohol_fuzzy_parts(text):
        near = F.lit(False)
        for phrase in words:
            near = near | (ratio(wording, F.lit(phrase)) >= least)
        ok = matches & (F.char_length(wording) >= 5) & near
        out.append(_hit(ok, tier, _abv_value(tier, number), number, F.lit("proof" if tier == 1 else "%"), F.lit(False)))
    return F.coalesce(*out)


def may_be_fuzzy(text: Column) -> Column:
    """Cheap test before alcohol_fuzzy(): a number with a sign or a wording beside it."""
    out = F.lit(False)
    for _, _, matches, _, wording in alcohol_fuzzy_parts(text):
        out = out | (matches & (F.char_length(wording) >= 5))
    return out


def volume(text: Column, form=whole) -> Column:
    """Millilitres stated by a canonical_numeric text, as a hit struct; a unit is required."""
    units = F.create_map(*[F.lit(x) for kv in METRIC.items() for x in kv])
    out = []
    for tier, pattern in VOLUME:
        number, unit = F.regexp_extract(text, form(pattern), 1), F.regexp_extract(text, form(pattern), 2)
        factor = F.lit(ML_PER_FL_OZ) if tier else F.try_element_at(units, unit)
        v = printed_number(number)
        out.append(_hit(text.rlike(form(pattern)), tier, F.when(v > 0, v * factor), number, F.lit("fl oz") if tier else unit))
    return F.coalesce(*out)


def volume_expected(text: Column) -> Column:
    return volume(text, search)


def cut_header(text: Column) -> Column:
    """What stands before the first colon, semicolon or opening bracket."""
    return F.regexp_extract(text, r"^([^:;(]*)", 1)


def case_runs(raw: Column) -> Column:
    """Runs of letters that share a case style: capitals, a capital with small letters, or small letters."""
    return F.regexp_extract_all(raw, F.lit(r"([A-Z][a-z]+|[A-Z]+|[a-z]+)"), F.lit(1))


def miscapitalised(raw: Column, least: int = 3) -> Column:
    """Every run of two letters or more has small letters, and one such run is `least` long."""
    runs = F.filter(case_runs(raw), lambda r: F.char_length(r) >= 2)
    small = lambda r: r.rlike("[a-z]")
    return (F.size(runs) > 0) & F.forall(runs, small) & F.exists(runs, lambda r: small(r) & (F.char_length(r) >= least))


def safe_cell(c: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[ \t\r\n]*[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
