"""Explicit schemas; nothing is inferred. Null means not measured and is never filled in."""

from __future__ import annotations

BOX = "struct<left: double, top: double, right: double, bottom: double>"
QUALITY = "struct<usable: boolean, score: double, issues: array<string>, guidance: array<string>, metrics: map<string, double>>"

#: A recognised page as stored: widths and heights instead of right and bottom edges.
SIDECAR = f"width int, height int, quality {QUALITY}, lines array<struct<words: array<struct<text: string, left: double, top: double, width: double, height: double, confidence: double>>>>"

#: One row per word of a label.
WORDS = f"label_id string, line_no int, word_no int, text string, confidence double, box {BOX}"
LABELS = f"label_id string, width int, height int, quality {QUALITY}"
RECORDS = "label_id string, brand_name string, class_type string, alcohol_content string, net_contents string, beverage_class string, label_width_mm double"

MANIFEST = "row_number int, filename string, brand_name string, class_type string, alcohol_content string, net_contents string, beverage_class string, label_width_mm string"

CHECK = "struct<id: string, outcome: string, citation: string, summary: string>"
FIELD_RESULTS = (
    "label_id string, field string, display_order int, verdict string, expected string, found string, "
    f"box {BOX}, score double, ocr_confidence double, reason string, elevated boolean, automated boolean, checks array<{CHECK}>"
)

VERDICTS = ("MATCH", "REVIEW", "MISMATCH")
TIERS = {"ASSERTED": 0, "MISSING_MANDATORY": 1, "UNREADABLE": 2, "REVIEW": 3, "UNCHECKED": 4, "CLEAR": 5}
