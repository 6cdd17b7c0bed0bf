"""Path and sequence names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample(name: Column) -> Column:
    """Text before the first ``#``."""
    return F.substring_index(name, "#", 1)


def haplotype(name: Column) -> Column:
    """The first two fields where there are three or more, else the sample."""
    return F.when(F.size(F.split(name, "#")) >= 3, F.substring_index(name, "#", 2)).otherwise(sample(name))


def assembly(name: Column) -> Column:
    """The first two fields joined by a dot where there are three or more, else the first."""
    fields = F.split(name, "#")
    return F.when(F.size(fields) >= 3, F.concat_ws(".", fields[0], F.get(fields, 1))).otherwise(fields[0])


def reference_name(name: Column) -> Column:
    """The name less ``a#b#``, where both fields hold something."""
    return F.regexp_replace(name, "^[^#]+#[^#]+#", "")


def donor(name: Column) -> Column:
    """The sample of a name with exactly three fields, else the name."""
    return F.when(F.size(F.split(name, "#")) == 3, sample(name)).otherwise(name)


_NUMBER = "([0-9]{1,19})"
_WIDE = "decimal(20,0)"


def _cut(state: Column, pattern: str, applies) -> Column:
    """What is left of a name whose end a pattern takes, with the numbers it holds; as it was where it doesn't apply."""
    end = lambda k: F.regexp_extract(state["rest"], pattern, k).try_cast(_WIDE)
    both = F.struct(end(1).alias("first"), end(2).alias("second")) if pattern.count(_NUMBER) > 1 else F.struct(end(1).alias("first"), F.lit(None).cast(_WIDE).alias("second"))
    fits = state["rest"].rlike(pattern)
    held = F.when(fits, both)
    good = fits & F.coalesce(applies(state, held), F.lit(False))
    return F.struct(
        F.when(good, F.regexp_replace(state["rest"], pattern, "")).otherwise(state["rest"]).alias("rest"),
        (state["start"] + F.when(good, held["first"]).otherwise(F.lit(0).cast(_WIDE))).cast(_WIDE).alias("start"),
        (state["spanned"] | good).alias("spanned"),
        F.when(good, held["second"] - held["first"]).alias("width"),
    )


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def path_name(name: Column, bp: Column) -> Column:
    """``struct(path, start, error)`` of a P line's name, once the bp of its steps are known.

    Endings are taken off from the right, each at most once, and their starts
    add up: ``:start-end`` if the steps span it, ``[start]`` or ``[start-end]``,
    the digits of a fourth ``#`` field.
    """
    bp = bp.cast(_WIDE)
    whole = F.struct(name.alias("rest"), F.lit(0).cast(_WIDE).alias("start"), F.lit(False).alias("spanned"), F.lit(None).cast(_WIDE).alias("width"))
    spans = lambda _, held: (bp > 0) & (held["second"] - held["first"] == bp)
    colon = lambda s: _cut(s, f":{_NUMBER}-{_NUMBER}\\z", spans)
    bracket = lambda s: _cut(s, f"\\[{_NUMBER}(?:-{_NUMBER})?\\]\\z", lambda *_: F.lit(True))
    fourth = lambda s: _cut(s, f"#{_NUMBER}\\z", lambda s, _: F.size(F.split(s["rest"], "#")) == 4)

    def judged(after_colon: Column) -> Column:
        return _bound(bracket(after_colon), lambda b: _bound(fourth(b), lambda f: F.struct(
            f["rest"].alias("path"), f["start"].try_cast("bigint").alias("start"),
            F.when(name == "", F.lit("nothing names it"))
            .when(~after_colon["spanned"] & (b["width"] != bp), F.lit("the steps don't fill the stretch in its brackets"))
            .when(f["rest"] == "", F.lit("nothing is left of its name but a start"))
            .when(f["start"] >= F.lit("18446744073709551616").cast(_WIDE), F.lit("its starts add up to 2^64 or more")).alias("error"),
        )))

    return _bound(colon(whole), judged)


def commify(n: Column) -> Column:
    return F.format_number(n, 0)


def length_cigar(alt: Column, ref: Column) -> Column:
    """An allele against the reference it replaces, by lengths alone."""
    n = lambda c: c.cast("string")
    return (
        F.when((alt > ref) & (ref > 0), F.concat(n(ref), F.lit("M"), n(alt - ref), F.lit("I")))
        .when(alt > ref, F.concat(n(alt), F.lit("I")))
        .when((alt < ref) & (alt > 0), F.concat(n(alt), F.lit("M"), n(ref - alt), F.lit("D")))
        .when(alt < ref, F.concat(n(ref), F.lit("D")))
        .otherwise(F.concat(n(ref), F.lit("M")))
    )


def strict_number(text: Column) -> Column:
    """A number of 1 to 19 digits, else null."""
    return F.when(text.rlike("^[0-9]{1,19}$"), text.try_cast("bigint"))
