"""Small scalar rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_band(n: Column) -> Column:
    """The greatest power of two that is not above n; 0 for n under 1. By bits, so exact."""
    return F.when(n < 1, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n)) - 1)).cast("long")


def piecewise_cost(x: Column, base: float, steps: Sequence[tuple[float, float]]) -> Column:
    """base * x, and each increment times what x is above its break point; 0 for x of 0 or less."""
    cost = x * F.lit(base)
    for at, more in steps:
        cost = cost + F.lit(more) * F.greatest(F.lit(0.0), x - F.lit(at))
    return F.when(x <= 0, F.lit(0.0)).otherwise(cost)


def repeat_coverage(start: Column, end: Column, left: Column) -> Column:
    """Share of a repeat's consensus that an instance covers, 1 at the most."""
    return F.least(F.lit(1.0), (end - F.greatest(start, F.lit(1)) + 1) / (end + F.abs(left)))


def position_code(target: Column, reverse: Column, pos: Column) -> Column:
    """One long for a place: target << 33 | strand << 32 | position."""
    return F.shiftleft(target.cast("long"), 33).bitwiseOR(F.shiftleft(reverse.cast("long"), 32)).bitwiseOR(pos.cast("long"))


#: Header field rl -> localization.
LOCALIZATIONS = {"Chromosome": "Chromosome", "Mitochondrion": "Chromosome", "unlocalized": "Unlocalized", "alt-scaffold": "AltScaffold", "unplaced": "Unplaced"}


def localization(name: Column, description: Column) -> Column:
    """What kind of contig a header stands for: its ``rl:`` field if known, else its name."""
    field = F.regexp_extract(description, r"(?:^|\s)rl:(\S+)", 1)
    told = F.create_map(*(F.lit(x) for pair in LOCALIZATIONS.items() for x in pair))[field]
    by_name = (
        F.when(name.startswith("chrUn"), "Unplaced").when(name.contains("_alt"), "AltScaffold").when(name.contains("_random"), "Unlocalized").when(name.contains("_decoy"), "Decoy")
        .when(name.startswith("HLA-"), "Other").when(name.startswith("chr") & ~name.contains("_"), "Chromosome").otherwise("Other")
    )
    return F.coalesce(told, by_name)


def reference_group(description: Column) -> Column:
    """The ``rg:`` field of a header up to its next colon, or null."""
    return F.nullif(F.regexp_extract(description, r"(?:^|\s)rg:([^:\s]+)", 1), F.lit(""))


def variant_place(outer_start: Column, start: Column, inner_start: Column, inner_end: Column, end: Column, outer_end: Column) -> Column:
    """``pos, end, cipos_low, cipos_high, ciend_low, ciend_high`` of a variant that says some of its bounds.

    The place itself counts first, then the inner, then the outer bound; an interval is null where neither
    of its bounds is said, and 0 at a bound that is not.
    """
    pos, last = F.coalesce(start, inner_start, outer_start), F.coalesce(end, inner_end, outer_end)

    def side(bound: Column, other: Column, at: Column) -> Column:
        return F.when(F.coalesce(bound, other).isNotNull(), F.coalesce(bound - at, F.lit(0).cast("long")))

    return F.struct(
        pos.alias("pos"), last.alias("end"), side(outer_start, inner_start, pos).alias("cipos_low"), side(inner_start, outer_start, pos).alias("cipos_high"), side(inner_end, outer_end, last).alias("ciend_low"), side(outer_end, inner_end, last).alias("ciend_high")
    )


def seed_weight(length: Column, multiplicity: Column) -> Column:
    """Weight of a seed by itself: longer is more, frequent less, and the less so the longer."""
    size = F.log10(length)
    return length * (1 + 0.25 * size) / (1 + 0.5 * F.log10(multiplicity) / (1 + 0.25 * size))


def collinear_weight(length: Column, collinearity: Column, multiplicity: Column) -> Column:
    return length * collinearity / F.sqrt(F.greatest(multiplicity, F.lit(1.0)))


def atom_weight(multiplicity: Column) -> Column:
    return 1 / F.sqrt(multiplicity)


def position_flip(code: Column) -> Column:
    """The code of the same place on the other strand; codes below 0 (no place) stay."""
    return F.when(code >= 0, code.bitwiseXOR(F.lit(1 << 32))).otherwise(code)


def position_decode(code: Column) -> Column:
    """``struct<target, reverse, pos>`` of a position code; null for codes below 0."""
    return F.when(code >= 0, F.struct(F.shiftright(code, 33).alias("target"), (F.shiftright(code, 32).bitwiseAND(F.lit(1)) == 1).alias("reverse"), code.bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")))
