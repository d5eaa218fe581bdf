"""Versioned rule data: policy is data, and every result names the version it was made under."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from dataclasses import fields as fields_of

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.text import CONFUSED

# The statutory warning (27 CFR 16.21) and the phrases it is found by.
STATUTE = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during "
    "pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to "
    "drive a car or operate machinery, and may cause health problems."
)
HEADER = "GOVERNMENT WARNING"
TAILS = ("SURGEON GENERAL", "BIRTH DEFECTS", "OPERATE MACHINERY", "DURING PREGNANCY")

# Standards of fill in millilitres, known designations and their families.
STANDARDS_OF_FILL = (50, 100, 187, 200, 331, 355, 375, 500, 570, 700, 720, 750, 900, 1000, 1500, 1750, 1800, 3000, 3750, 4500, 5000)
VOCABULARY = (
    "Straight Bourbon Whiskey", "Kentucky Straight Bourbon Whiskey", "Tennessee Whiskey", "Straight Rye Whiskey", "Bourbon Whiskey",
    "Rye Whiskey", "Corn Whiskey", "Blended Whiskey", "Single Malt Scotch Whisky", "Blended Scotch Whisky", "Irish Whiskey",
    "Canadian Whisky", "Light Whiskey", "Vodka", "Gin", "London Dry Gin", "Distilled Gin", "White Rum", "Gold Rum", "Dark Rum", "Rum",
    "Tequila", "Blanco Tequila", "Reposado Tequila", "Anejo Tequila", "Mezcal", "Brandy", "Grape Brandy", "Cognac", "Armagnac",
    "Applejack", "Liqueur", "Cordial", "Neutral Spirits", "Grain Spirits",
)
FAMILIES = {
    "whisky": ("Whiskey", "Whisky", "Bourbon", "Scotch"),
    "gin": ("Gin", "Genever"),
    "neutral_spirits": ("Vodka", "Neutral Spirits", "Grain Spirits"),
    "rum": ("Rum",),
    "agave": ("Tequila", "Mezcal"),
    "brandy": ("Brandy", "Cognac", "Armagnac", "Applejack", "Calvados", "Pisco"),
    "liqueur": ("Liqueur", "Cordial"),
}
ABBREVIATIONS = {"KY": "KENTUCKY", "TENN": "TENNESSEE", "STR": "STRAIGHT", "WHISKY": "WHISKEY", "BRBN": "BOURBON"}


@dataclass(frozen=True)
class Field:
    id: str
    order: int
    display_order: int
    strategy: str
    citation: str
    match: float = 0.92
    mismatch: float = 0.60
    length_penalty: float = 0.0
    confidence_weight: float = 0.0

    def __post_init__(self):
        if not 0 <= self.mismatch < self.match <= 1:
            raise ValueError(f"{self.id}: the mismatch threshold must lie below the match threshold")


@dataclass(frozen=True)
class Rules:
    version: str = "spirits-1"
    beverage_class: str = "distilled_spirits"
    fields: tuple[Field, ...] = (
        Field("government_warning", 1, 5, "warning", "27 CFR 16.21", 0.95, 0.70),
        Field("alcohol_content", 2, 2, "alcohol_content", "27 CFR 5.65"),
        Field("net_contents", 3, 3, "net_contents", "27 CFR 5.68"),
        Field("brand_name", 4, 1, "anchored", "27 CFR 5.63", length_penalty=0.15, confidence_weight=0.30),
        Field("class_type", 5, 4, "class_type", "27 CFR 5.63", 0.90, 0.55, length_penalty=0.10, confidence_weight=0.30),
    )
    min_confidence: float = 0.45
    good_quality: float = 0.70
    max_residual_edits: int = 0
    numeric_assert_confidence: float = 0.85
    wording_similarity: float = 0.80
    positional_floor: float = 0.60
    vocabulary_assert_similarity: float = 0.95
    class_assert_confidence: float = 0.80
    reach_heights: float = 2.0
    clean_read: float = 0.80
    sporadic_lowercase: int = 2
    case_run: int = 3
    noise_length: int = 5
    ragged_right: float = 0.25
    line_gap_slack: float = 0.8
    word_gap: float = 3.0
    indent: float = 2.0
    header_score: float = 0.75
    tail_score: float = 0.80
    tolerance_abv: float = 0.3
    tolerance_proof: float = 0.6
    tolerance_ml: float = 2.0
    standards_of_fill: tuple[float, ...] = STANDARDS_OF_FILL
    vocabulary: tuple[str, ...] = VOCABULARY
    families: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(FAMILIES))
    abbreviations: dict[str, str] = field(default_factory=lambda: dict(ABBREVIATIONS))
    statute: str = STATUTE
    header: str = HEADER
    tails: tuple[str, ...] = TAILS

    def __post_init__(self):
        for of in ("id", "order", "display_order"):
            values = [getattr(f, of) for f in self.fields]
            if len(set(values)) != len(values):
                raise ValueError(f"fields repeat a value of {of}")
        members = [m.upper() for ms in self.families.values() for m in ms]
        if len(set(members)) != len(members):
            raise ValueError("a term belongs to two families")

    def of(self, field_id: str) -> Field:
        return next(f for f in self.fields if f.id == field_id)

    def least_match(self, field_id: str) -> float:
        return self.of(field_id).match


_versions = {"spirits-1": Rules()}


def load(version: str = "spirits-1", beverage_class: str = "distilled_spirits", **changes) -> Rules:
    """The rules of a version; a class they don't cover is refused. changes: for what-if runs."""
    rules = _versions[version]
    if beverage_class != rules.beverage_class:
        raise ValueError(f"no rules for beverage class {beverage_class}")
    return replace(rules, **changes) if changes else rules


# Rule sets as data: a JSON document for each version and class, read by Spark.

MOST_SETS = 1000
_FIELD = "struct<id: string, order: int, display_order: int, strategy: string, citation: string, match: double, mismatch: double, length_penalty: double, confidence_weight: double>"
_WHOLE = {"max_residual_edits", "sporadic_lowercase", "case_run", "noise_length"}
_LISTS = {"version": "string", "beverage_class": "string", "statute": "string", "header": "string", "tails": "array<string>", "fields": f"array<{_FIELD}>", "standards_of_fill": "array<double>", "vocabulary": "array<string>", "families": "map<string, array<string>>", "abbreviations": "map<string, string>"}
TUNING = tuple(f.name for f in fields_of(Rules) if f.name not in _LISTS)
RULES = ", ".join(f"`{n}` {k}" for n, k in (_LISTS | {n: "int" if n in _WHOLE else "double" for n in TUNING}).items())


def read_rules(spark: SparkSession, path: str) -> list[Rules]:
    """The rule sets in the JSON documents of a folder. One that is no document, lacks its version, class or fields, or contradicts itself is refused, and so is the folder.

    What a document doesn't state has the default of Rules. A folder holds policy, not data: more
    than MOST_SETS documents are refused as well.
    """
    documents = spark.read.schema(f"{RULES}, broken string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken").select("*", F.col("_metadata.file_name").alias("file"))
    rows = documents.limit(MOST_SETS + 1).collect()
    if len(rows) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} rule sets in {path}")
    faults, sets = [], []
    # Spark reads the first document of a file and leaves the others out
    for row in spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file")).collect():
        if _followed(row["value"]):
            faults.append(f"{row['file']}: more than one document")
    for row in rows:
        try:
            sets.append(_rules_of(row.asDict(recursive=True)))
        except (TypeError, ValueError) as why:
            faults.append(f"{row['file']}: {why}")
    keys = [(r.version, r.beverage_class) for r in sets]
    faults += [f"{v} for {c} is stated twice" for v, c in sorted({k for k in keys if keys.count(k) > 1})]
    if faults or not sets:
        raise ValueError("; ".join(sorted(faults)) or f"no rule set in {path}")
    return sorted(sets, key=lambda r: (r.version, r.beverage_class))


def _followed(text: str) -> bool:
    """Whether more than blanks follows a text's first JSON document; false for what is none."""
    try:
        _, end = json.JSONDecoder().raw_decode(text.lstrip())
    except ValueError:
        return False
    return bool(text.lstrip()[end:].strip())


def _rules_of(given: dict) -> Rules:
    if given.pop("broken") is not None:
        raise ValueError("no JSON document of a rule set")
    given.pop("file")
    stated = {k: v for k, v in given.items() if v is not None}
    missing = sorted({"version", "beverage_class", "fields"} - set(stated))
    if missing:
        raise ValueError(f"lacks {', '.join(missing)}")
    stated["fields"] = tuple(Field(**{k: v for k, v in f.items() if v is not None}) for f in stated["fields"])
    for name in ("tails", "standards_of_fill", "vocabulary"):
        if name in stated:
            stated[name] = tuple(stated[name])
    if "families" in stated:
        stated["families"] = {k: tuple(v) for k, v in stated["families"].items()}
    return Rules(**stated)


def document(rules: Rules) -> dict:
    """A rule set as the JSON document that read_rules() reads."""
    return asdict(rules)


def rules_table(spark: SparkSession, sets: list[Rules] | Rules) -> DataFrame:
    """A row per field of each rule set."""
    rows = [(r.version, r.beverage_class, f.id, f.order, f.display_order, f.strategy, f.citation, f.match, f.mismatch) for r in (sets if isinstance(sets, list) else [sets]) for f in r.fields]
    return spark.createDataFrame(rows, "version string, beverage_class string, field string, resolve_order int, display_order int, strategy string, citation string, match double, mismatch double")


def _folded(text: str) -> str:
    """Canonical form of a plain rule text."""
    return " ".join("".join(CONFUSED.get(c, c) for c in w) for w in re.findall(r"\w+", text.upper()))


def abbreviation_table(rules: Rules) -> dict[str, str]:
    return {_folded(k): _folded(v) for k, v in rules.abbreviations.items() if _folded(k) != _folded(v)}


def expanded_terms(rules: Rules) -> list[str]:
    """The vocabulary in canonical form with abbreviations expanded, without repeats."""
    table = abbreviation_table(rules)
    return list(dict.fromkeys(" ".join(table.get(w, w) for w in _folded(v).split()) for v in rules.vocabulary))


def expanded_families(rules: Rules) -> dict[str, list[str]]:
    table = abbreviation_table(rules)
    return {name: [" ".join(table.get(w, w) for w in _folded(m).split()) for m in members] for name, members in rules.families.items()}


def rule_rows(spark: SparkSession, sets: list[Rules]) -> DataFrame:
    """rules_version, beverage_class, rule: all that verdicts depend on, to be joined to records."""
    of = ", ".join(f"`{f.id}`: struct<display_order: int, citation: string, match: double, mismatch: double, length_penalty: double, confidence_weight: double>" for f in sets[0].fields)
    scalars = ", ".join(f"`{n}`: {'int' if n in _WHOLE else 'double'}" for n in TUNING)
    kind = f"struct<version: string, {scalars}, standards_of_fill: array<double>, terms: array<string>, families: array<struct<name: string, members: array<string>>>, abbreviations: map<string, string>, fields: struct<{of}>>"
    rows = []
    for r in sets:
        fields = tuple((f.display_order, f.citation, f.match, f.mismatch, f.length_penalty, f.confidence_weight) for f in (r.of(x.id) for x in sets[0].fields))
        tuning = tuple(int(getattr(r, n)) if n in _WHOLE else float(getattr(r, n)) for n in TUNING)
        rows.append((r.version, r.beverage_class, (r.version, *tuning, [float(x) for x in r.standards_of_fill], expanded_terms(r), list(expanded_families(r).items()), abbreviation_table(r), fields)))
    return spark.createDataFrame(rows, f"rules_version string, beverage_class string, rule {kind}")


class FieldColumns:
    """A field's policy as columns of the row's rule."""

    def __init__(self, own: Field):
        self.id, self.order, self.strategy = own.id, own.order, own.strategy

    def __getattr__(self, name: str) -> Column:
        return F.col(f"rule.fields.{self.id}.{name}")


class RuleColumns:
    """Rules whose values are columns of the row's rule: one plan for rows of several versions.

    What shapes the plan must be the same in all of them: fields with their order and strategy, and
    the statute.
    """

    def __init__(self, sets: list[Rules]):
        self.sets = sets
        first = sets[0]
        if any(shape(r) != shape(first) for r in sets):
            raise ValueError("rule sets of one plan must share fields, strategies and statute")
        self.fields = tuple(FieldColumns(f) for f in first.fields)
        self.statute, self.header, self.tails = first.statute, first.header, first.tails

    def of(self, field_id: str) -> FieldColumns:
        return next(f for f in self.fields if f.id == field_id)

    def least_match(self, field_id: str) -> float:
        return min(r.of(field_id).match for r in self.sets)

    def __getattr__(self, name: str) -> Column:
        return F.col(f"rule.{name}")


def shape(r: Rules) -> tuple:
    return tuple(sorted((f.order, f.id, f.strategy) for f in r.fields)), r.statute, r.header, r.tails
