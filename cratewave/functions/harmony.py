"""Camelot keys and tempo: parsing, compatibility rules and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the compatibility rules.
SAME, NEXT, RELATIVE = "Same Key", "Camelot +/-1", "Relative Maj/Min"
RAISE, BOOST = "Raising energy (+7)", "Energy Boost ++ (+2)"
TO_MAJOR, TO_MINOR, NONE = "Mood Shifter (min->Maj +3)", "Mood Shifter (Maj->min -3)", "-"


def key_number(key: Column) -> Column:
    """1 to 12 of a key such as "8A" (numbers outside wrap around), null if it can't be read."""
    n = F.regexp_extract(F.upper(F.trim(key)), r"^([+-]?\d+)\s*([AB])$", 1)
    return F.when(n != "", F.pmod(n.try_cast("int") - 1, F.lit(12)) + 1)


def key_letter(key: Column) -> Column:
    """A or B of a key, null if it can't be read."""
    letter = F.regexp_extract(F.upper(F.trim(key)), r"^([+-]?\d+)\s*([AB])$", 2)
    return F.when(letter != "", letter)


def relation(seed: Column, candidate: Column) -> Column:
    """Name of the first rule that allows going from the seed's key to the candidate's; "-" if none does or a key is
    missing or unreadable."""
    s, c, sl, cl = key_number(seed), key_number(candidate), key_letter(seed), key_letter(candidate)
    step = F.pmod(c - s, F.lit(12))
    same_letter = sl == cl
    return F.coalesce(
        F.when(s.isNull() | c.isNull(), F.lit(NONE))
        .when(same_letter & (step == 0), F.lit(SAME))
        .when(same_letter & step.isin(1, 11), F.lit(NEXT))
        .when(~same_letter & (step == 0), F.lit(RELATIVE))
        .when(same_letter & (step == 7), F.lit(RAISE))
        .when(same_letter & (step == 2), F.lit(BOOST))
        .when((sl == "A") & (cl == "B") & (step == 3), F.lit(TO_MAJOR))
        .when((sl == "B") & (cl == "A") & (step == 9), F.lit(TO_MINOR)),
        F.lit(NONE),
    )


def compatible(seed: Column, candidate: Column) -> Column:
    """Whether a rule allows the candidate's key; missing and unreadable keys are allowed."""
    return key_number(seed).isNull() | key_number(candidate).isNull() | (relation(seed, candidate) != NONE)


def relation_score(seed: Column, candidate: Column) -> Column:
    """1 for equal key texts, 0.8 for the same number, 0.7 for a neighbouring number whatever the letter, else 0."""
    s, c = F.upper(F.trim(seed)), F.upper(F.trim(candidate))
    number = lambda k: F.regexp_extract(k, r"^(\d+)[AB]$", 1).try_cast("int")
    step = F.pmod(number(c) - number(s), F.lit(12))
    return F.coalesce(F.when((s == "") | (c == ""), F.lit(0.0)).when(s == c, F.lit(1.0)).when(step == 0, F.lit(0.8)).when(step.isin(1, 11), F.lit(0.7)), F.lit(0.0))


def tempo_matches(seed: Column, candidate: Column, pct: float = 6.0, doubletime: bool = True) -> Column:
    """Whether the candidate is within `pct` percent of the seed's tempo, or of twice or half of it. A missing or zero
    tempo matches all."""
    unknown = (F.coalesce(seed, F.lit(0.0)) == 0) | (F.coalesce(candidate, F.lit(0.0)) == 0)
    targets = [seed, seed * 2, seed / 2] if doubletime else [seed]
    near = F.lit(False)
    for t in targets:
        near = near | (F.abs(t - candidate) <= t * (pct / 100.0))
    return F.coalesce(unknown | near, F.lit(False))


def tempo_note(seed: Column, candidate: Column) -> Column:
    """"2x" or "1/2x" where the candidate runs at about twice or half the seed's tempo, "~" elsewhere, "" if unknown."""
    unknown = (F.coalesce(seed, F.lit(0.0)) == 0) | (F.coalesce(candidate, F.lit(0.0)) == 0)
    ratio = F.try_divide(candidate, seed)
    return F.when(unknown, "").when(ratio.between(1.94, 2.06), "2x").when(ratio.between(0.47, 0.53), "1/2x").otherwise("~")


def tempo_score(seed: Column, candidate: Column, most: float) -> Column:
    """1 at the same tempo, falling to 0 at a difference of `most`; 0 if a tempo is missing or not positive."""
    d = F.abs(seed - candidate)
    good = (seed > 0) & (candidate > 0) & (d <= most)
    return F.when(F.coalesce(good, F.lit(False)) & F.lit(most > 0), F.greatest(F.lit(0.0), 1 - d / (most or 1.0))).otherwise(0.0)
