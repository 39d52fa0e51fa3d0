"""Column expressions for names, identifiers, formulas and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GREEK = (("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("ω", "omega"))
UNITS = ((1 / 3600, "s sec secs second seconds"), (1 / 60, "m min mins minute minutes"), (1.0, "h hr hrs hour hours"), (24.0, "d day days"))


def name_key(name: Column) -> Column:
    """Lower case, Greek letters spelled out, letters and digits only."""
    out = F.lower(name)
    for a, b in GREEK:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "[^a-z0-9]", "")


def name_variants(name: Column) -> Column:
    """Keys of the name, of the name without its parentheses, and with -ic acid and -ate exchanged; distinct, sorted."""
    bare = F.trim(F.regexp_replace(name, r"\([^()]*\)", " "))
    forms = [name, bare, F.regexp_replace(F.lower(bare), "ic acid$", "ate"), F.regexp_replace(F.lower(bare), "ate$", "ic acid")]
    return F.array_sort(F.array_distinct(F.filter(F.array(*[name_key(f) for f in forms]), lambda x: x != "")))


def padded_id(text: Column, prefix: str, width: int) -> Column:
    """prefix + digits padded to ``width``; NULL without digits after the prefix (any case)."""
    digits = F.regexp_extract(F.upper(F.trim(text)), f"^{prefix}:?0*([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit(prefix), F.lpad(digits, width, "0")))


def gene_symbol(label: Column) -> Column:
    """A capital letter, then capitals, digits and hyphens, at most 15 characters."""
    return F.coalesce(label.rlike("^[A-Z][A-Z0-9-]{1,14}$"), F.lit(False))


def formula_elements(formula: Column) -> Column:
    """Array of (element, count), sorted by element; repeated elements are summed."""
    parts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), 0)
    split = F.transform(
        parts,
        lambda x: F.struct(
            F.regexp_extract(x, "^([A-Z][a-z]?)", 1).alias("element"),
            F.when(F.regexp_extract(x, "([0-9]+)$", 1) == "", F.lit(1)).otherwise(F.try_to_number(F.regexp_extract(x, "([0-9]+)$", 1), F.lit("9999999999")).cast("int")).alias("count"),
        ),
    )
    names = F.array_sort(F.array_distinct(F.transform(split, lambda x: x["element"])))
    return F.transform(
        names,
        lambda e: F.struct(e.alias("element"), F.aggregate(split, F.lit(0), lambda s, x: s + F.when(x["element"] == e, x["count"]).otherwise(0)).alias("count")),
    )


def isotopologue(label: Column) -> Column:
    """Number of labels in ``M+3``, ``m3``, ``M_3``, ``ISO3``, ``13C3`` style labels, a bare number, or a name that ends in ``M+3``; NULL otherwise."""
    text = F.upper(F.regexp_replace(label, r"\s+", ""))
    whole = F.regexp_extract(text, r"^(?:M\+?|M_|ISO|13C-?|C13-?)?([0-9]{1,3})(?:\.0)?$", 1)
    tail = F.regexp_extract(text, r"M\+?([0-9]{1,3})$", 1)
    digits = F.when(whole != "", whole).otherwise(tail)
    return F.when(digits != "", digits.cast("int"))


def hours(text: Column, unit: str = "h") -> Column:
    """Hours of ``30 min``, ``1.5h``, ``2 days`` or a bare number in ``unit``; NULL otherwise."""
    t = F.lower(F.trim(text))
    number, word = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 1), F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 2)
    factor = F.create_map(*[F.lit(x) for size, words in UNITS for w in words.split() for x in (w, size)])
    return F.when(number != "", number.cast("double") * F.try_element_at(factor, F.when(word == "", unit).otherwise(word)))


def acyl_classes(name: Column) -> Column:
    """Chain classes of lipid shorthand such as ``PC 16:0_22:6``: SFA, MUFA, PUFA, C22+."""
    chains = F.regexp_extract_all(name, F.lit("([0-9]{1,2}:[0-9]{1,2})"), 1)
    n = lambda x: F.substring_index(x, ":", 1).cast("int")
    d = lambda x: F.substring_index(x, ":", -1).cast("int")
    cls = [(lambda x: d(x) == 0, "SFA"), (lambda x: d(x) == 1, "MUFA"), (lambda x: d(x) >= 2, "PUFA"), (lambda x: n(x) >= 22, "C22+")]
    return F.array_compact(F.array(*[F.when(F.exists(chains, f), F.lit(c)) for f, c in cls]))
