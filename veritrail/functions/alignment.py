"""Alignment of token lists as Column functions: longest common subsequences by bits, matching blocks by runs.

Everything is an expression of one row's arrays: no Python, no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.functions.bound import bound

MOST_BITS = 61  # a sum of two rows of bits stays a positive long

REGION = "array<struct<alo: int, ahi: int, blo: int, bhi: int>>"
BLOCK = "array<struct<i: int, j: int, size: int>>"
OPCODE = "array<struct<tag: string, i1: int, i2: int, j1: int, j2: int>>"


def bits_of(target: list[str], backward: bool = False) -> dict[str, int]:
    """Token to the bits of the places where it stands in target (counted from the end if backward)."""
    if len(target) > MOST_BITS:
        raise ValueError(f"a fixed text of {len(target)} tokens; {MOST_BITS} at most can be compared by bits")
    out: dict[str, int] = {}
    for i, t in enumerate(reversed(target) if backward else target):
        out[t] = out.get(t, 0) | 1 << i
    return out


def literal_map(entries: dict[str, int], kind: str = "long") -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.lit(v).cast(kind))])


def masks(tokens: Column, bits: dict[str, int]) -> Column:
    table = literal_map(bits)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(0).cast("long")))


def lcs_step(row: Column, mask: Column, n: int) -> Column:
    """The row of bits after one more token; its zeros count the longest common subsequence."""
    hit = row.bitwiseAND(mask)
    return (row + hit).bitwiseOR(row.bitwiseAND(F.bitwise_not(mask))).bitwiseAND(F.lit((1 << n) - 1))


def full_row(n: int) -> Column:
    return F.lit((1 << n) - 1).cast("long")


def lcs_of(row: Column, n: int) -> Column:
    return n - F.bit_count(row)


def fixed_ratio(text: Column, target: str) -> Column:
    """2 LCS / (sum of lengths) of the letters of a text and a fixed one."""
    n = len(target)
    row = F.aggregate(masks(F.filter(F.split(text, ""), lambda c: c != ""), bits_of(list(target))), full_row(n), lambda v, m: lcs_step(v, m, n))
    return 2.0 * lcs_of(row, n) / (F.char_length(text) + n)


def matching_blocks(a: Column, b: Column) -> Column:
    """Blocks (i, j, size) of two token arrays: the longest common run, the first in a and then in b of equal ones, and so on to its left and right.

    Equal tokens make pairs, sorted by diagonal; runs along a diagonal are islands of consecutive
    places. A region whose longest run is taken leaves two regions; there are fewer than twice as
    many as tokens, so a fold of that many steps ends with none.
    """
    index = lambda x: F.transform(x, lambda t, i: F.struct(i.alias("at"), t.alias("t")))
    pairs = bound(index(a), lambda xs: F.array_sort(F.flatten(F.transform(index(b), lambda y: F.transform(F.filter(xs, lambda x: x["t"] == y["t"]), lambda x: F.struct((x["at"] - y["at"]).alias("d"), x["at"].alias("i"), y["at"].alias("j")))))))
    none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    def longest(region: Column, pairs: Column) -> Column:
        inside = F.filter(pairs, lambda p: (p["i"] >= region["alo"]) & (p["i"] < region["ahi"]) & (p["j"] >= region["blo"]) & (p["j"] < region["bhi"]))
        start = F.struct(none.alias("best"), F.lit(0).alias("d"), F.lit(-2).alias("last"), F.lit(0).alias("run"))

        def along(s: Column, p: Column) -> Column:
            run = F.when((p["d"] == s["d"]) & (p["i"] == s["last"] + 1), s["run"] + 1).otherwise(F.lit(1))
            here = F.struct(run.alias("size"), (run - 1 - p["i"]).alias("i"), (run - 1 - p["j"]).alias("j"))
            return F.struct(F.when(here > s["best"], here).otherwise(s["best"]).alias("best"), p["d"].alias("d"), p["i"].alias("last"), run.alias("run"))

        return F.aggregate(inside, start, along, lambda s: s["best"])

    def region(alo, ahi, blo, bhi) -> Column:
        return F.struct(alo.alias("alo"), ahi.alias("ahi"), blo.alias("blo"), bhi.alias("bhi"))

    def step(s: Column, found: Column) -> Column:
        r, i, j, k = F.get(s["todo"], F.lit(0)), -found["i"], -found["j"], found["size"]
        left = F.when((r["alo"] < i) & (r["blo"] < j), region(r["alo"], i, r["blo"], j))
        right = F.when((i + k < r["ahi"]) & (j + k < r["bhi"]), region(i + k, r["ahi"], j + k, r["bhi"]))
        rest = F.slice(s["todo"], 2, F.size(s["todo"]))
        more = F.when(k > 0, F.concat(F.array_compact(F.array(left, right)), rest)).otherwise(rest)
        blocks = F.when(k > 0, F.concat(s["blocks"], F.array(F.struct(i.alias("i"), j.alias("j"), k.alias("size"))))).otherwise(s["blocks"])
        return F.struct(more.cast(REGION).alias("todo"), blocks.cast(BLOCK).alias("blocks"))

    def once(s: Column, pairs: Column) -> Column:
        # the longest run is bound by a fold over itself alone, so that it is found once a step
        best = F.transform(F.slice(s["todo"], 1, 1), lambda r: longest(r, pairs))
        return F.when(F.size(s["todo"]) == 0, s).otherwise(F.get(F.transform(best, lambda f: step(s, f)), F.lit(0)))

    whole = F.array(region(F.lit(0), F.size(a), F.lit(0), F.size(b))).cast(REGION)
    first = F.struct(whole.alias("todo"), F.array().cast(BLOCK).alias("blocks"))
    steps = F.sequence(F.lit(0), 2 * F.least(F.size(a), F.size(b)))
    # the pairs are bound as well: they serve all steps
    return bound(pairs, lambda ps: F.aggregate(steps, first, lambda s, _: once(s, ps), lambda s: F.array_sort(s["blocks"])))


def opcodes(a: Column, b: Column) -> Column:
    """How a becomes b: (tag, i1, i2, j1, j2) with tags equal, replace, delete and insert, in order."""
    op = lambda tag, i1, i2, j1, j2: F.struct(tag.alias("tag"), i1.alias("i1"), i2.alias("i2"), j1.alias("j1"), j2.alias("j2"))
    end = F.array(F.struct(F.size(a).alias("i"), F.size(b).alias("j"), F.lit(0).alias("size"))).cast(BLOCK)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast(OPCODE).alias("out"))

    def step(s: Column, k: Column) -> Column:
        tag = F.when((s["i"] < k["i"]) & (s["j"] < k["j"]), "replace").when(s["i"] < k["i"], "delete").when(s["j"] < k["j"], "insert")
        gap = F.when(tag.isNotNull(), F.array(op(tag, s["i"], k["i"], s["j"], k["j"]))).otherwise(F.array().cast(OPCODE))
        joins = tag.isNull() & (F.size(s["out"]) > 0) & (k["size"] > 0)  # goes on from the block before
        last = F.element_at(s["out"], F.lit(-1))
        same = F.when(k["size"] == 0, F.array().cast(OPCODE)).otherwise(F.array(op(F.lit("equal"), F.when(joins, last["i1"]).otherwise(k["i"]), k["i"] + k["size"], F.when(joins, last["j1"]).otherwise(k["j"]), k["j"] + k["size"])).cast(OPCODE))
        before = F.when(joins, F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1)).otherwise(s["out"])
        return F.struct((k["i"] + k["size"]).alias("i"), (k["j"] + k["size"]).alias("j"), F.concat(before, gap.cast(OPCODE), same).cast(OPCODE).alias("out"))

    return F.aggregate(F.concat(matching_blocks(a, b), end), start, step, lambda s: s["out"])


def deletions(text: Column) -> Column:
    """A text and all it becomes by leaving out one letter: texts one edit apart share one of these."""
    n = F.char_length(text)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))))
