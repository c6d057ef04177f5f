"""Column expressions over one customer message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import text as tx


def strip(message: Column) -> Column:
    return F.regexp_replace(F.coalesce(message, F.lit("")), f"^{tx.SPACE}+|{tx.SPACE}+$", "")


def recognised(message: Column) -> Column:
    """True when the whole trimmed message has one of the known shapes."""
    body = strip(message)
    out = F.lit(False)
    for shape in fixed.KNOWN_SHAPES:
        out = out | body.rlike(shape)
    return out


def no_preference(message: Column) -> Column:
    return F.coalesce(message.rlike(fixed.P_NO_PREFERENCE), F.lit(False))


def override(message: Column) -> Column:
    """The customer changed their mind: template or cue."""
    return F.coalesce(message.rlike(fixed.P_OVERRIDE) | message.rlike(fixed.P_OVERRIDE_CUE), F.lit(False))


def looking_for(message: Column) -> Column:
    """Category clause, null when absent or shorter than two tokens."""
    clause = F.regexp_extract(message, fixed.P_LOOKING, 1)
    return F.when(F.size(tx.tokens(clause)) >= 2, F.btrim(clause))


def category_parts(clause: Column) -> Column:
    """Tokens of the category clause that are longer than two characters."""
    return F.filter(tx.tokens(clause), lambda t: F.length(t) > 2)


def constraints(message: Column) -> Column:
    """Constraint texts of the three templates, in template order, split at semicolons."""
    lists = [F.split(F.regexp_extract(message, p, 1), ";")
             for p in (fixed.P_REQUIREMENT, fixed.P_MATTERS, fixed.P_OVERRIDE)]
    return F.filter(F.transform(F.flatten(F.array(*lists)), lambda v: F.btrim(v)), lambda v: v != "")


def override_tail(message: Column) -> Column:
    """Old value stated in an override opening; null when the shape does not apply."""
    tail = F.btrim(F.regexp_extract(strip(message), fixed.P_OVERRIDE_OPENING, 1))
    return F.when(F.size(tx.tokens(tail)) > 0, tail)


def value_phrase(text: Column, cap: int) -> Column:
    """Phrase to attest for a stated value: colour label dropped, cut at `cap` tokens."""
    bare = F.when(text.rlike(fixed.P_COLOUR_LABEL),
                  F.btrim(F.regexp_extract(text, fixed.P_COLOUR_LABEL, 1))).otherwise(text)
    return tx.phrase_of(F.slice(tx.tokens(bare), 1, cap))
