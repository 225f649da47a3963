"""Column functions over script text: canonical forms and script measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions import fixed as X
from folia.functions.unicode import composed


def fold_letters(c: Column) -> Column:
    return F.translate(c, X.FOLD_FROM, X.FOLD_TO)


def fold_digits(c: Column) -> Column:
    return F.translate(c, X.ARABIC_INDIC_DIGITS + X.PERSIAN_DIGITS, X.ASCII_DIGITS * 2)


def strip_tashkeel(c: Column) -> Column:
    return F.translate(c, X.TASHKEEL, "")


def strip_quranic_marks(c: Column) -> Column:
    return F.translate(c, X.QURANIC_MARKS, "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical(c: Column, mode: str = "loose", keep_newlines: bool = True, compose: bool = True) -> Column:
    """One form for texts that differ only in encoding; ``loose`` also drops vocalisation.

    Every character step is one ``translate``.  ``compose=False`` leaves out
    normalisation for text known to be composed.
    """
    if mode not in ("strict", "loose"):
        raise ValueError(f"unknown mode {mode!r}")
    drop = X.TATWEEL + X.QURANIC_MARKS + (X.TASHKEEL if mode == "loose" else "") + X.ZWJ
    swap_from = X.FOLD_FROM + X.ARABIC_INDIC_DIGITS + X.PERSIAN_DIGITS
    out = F.translate(composed(c) if compose else c, swap_from + drop, X.FOLD_TO + X.ASCII_DIGITS * 2)
    out = F.regexp_replace(out, f"{X.SPACE_CLASS}+", " ")
    out = F.regexp_replace(out, r"(?U)\s*\n\s*", "\n") if keep_newlines else F.regexp_replace(out, r"(?U)\s+", " ")
    return F.when(c.isNotNull(), trimmed(composed(out))) if compose else trimmed(out)


def _bare_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s", ""))


def _count_of(c: Column, letters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, letters, ""))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def script_purity(c: Column) -> Column:
    """Share of the non-blank characters that are letters or marks of the script, or ASCII digits."""
    return _ratio(F.length(F.regexp_replace(c, f"[^{X.SCRIPT_CLASS}]", "")), _bare_length(c))


def urdu_affinity(c: Column) -> Column:
    """-1 (Arabic spelling only) to 1 (Urdu only), 0 without evidence; the text is composed."""
    urdu, arabic = _count_of(c, X.URDU_ONLY), _count_of(c, X.ARABIC_ONLY)
    return _ratio(urdu - arabic, urdu + arabic)


def tashkeel_density(c: Column) -> Column:
    """Vocalisation marks for each other non-blank character."""
    return _ratio(_count_of(c, X.TASHKEEL), _bare_length(strip_tashkeel(c)))


def ornament_density(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?U)\s", "")
    return _ratio(_count_of(bare, X.BRACKETS + X.QURANIC_MARKS), F.length(bare))


#: Classes of letters as private code points; one that a text holds itself counts as nothing.
_URDU, _ARABIC, _VOCAL, _ORNATE, _OTHER = (chr(0xE000 + i) for i in range(5))
_CLASSED = [(X.URDU_ONLY, _URDU), (X.ARABIC_ONLY, _ARABIC), (X.TASHKEEL, _VOCAL), (X.BRACKETS + X.QURANIC_MARKS, _ORNATE), (_URDU + _ARABIC + _VOCAL + _ORNATE, _OTHER)]
_CLASS_FROM, _CLASS_TO = "".join(a for a, _ in _CLASSED), "".join(b * len(a) for a, b in _CLASSED)


def script_profile(c: Column) -> Column:
    """Struct of purity, affinity, density and ornament of a composed text, from one pass that turns letters into their classes."""
    bare = F.regexp_replace(c, r"(?U)\s", "")
    marked = F.translate(bare, _CLASS_FROM, _CLASS_TO)
    size = F.length(marked)
    n = lambda k: size - F.length(F.replace(marked, F.lit(k), F.lit("")))
    urdu, arabic, vocal, ornate = (n(k) for k in (_URDU, _ARABIC, _VOCAL, _ORNATE))
    return F.struct(
        _ratio(F.length(F.regexp_replace(bare, f"[^{X.SCRIPT_CLASS}]", "")), size).alias("purity"), _ratio(urdu - arabic, urdu + arabic).alias("affinity"),
        _ratio(vocal, size - vocal).alias("density"), _ratio(ornate, size).alias("ornament"), (size == 0).alias("blank"),
    )


def profile_score(p: Column, w_urdu=1.0, w_tashkeel=1.0, w_ornament=1.0, tashkeel_arabic=0.25) -> Column:
    """``route_score`` of a ``script_profile``."""
    ornate = F.when(p["ornament"] > 0, w_ornament).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w_urdu * p["affinity"] - w_tashkeel * F.least(F.lit(1.0), p["density"] / tashkeel_arabic) - ornate))


def profile_language(p: Column) -> Column:
    """``guess_language`` of a ``script_profile``."""
    a = p["affinity"]
    return F.when((p["density"] > 0.25) & (a <= 0), "arabic").when(a > 0.2, "urdu").when(a < -0.2, "arabic").otherwise("mixed")


def shown(c: Column, plain_vowels: Column | None = None) -> Column:
    """Latin text in letters of the script; where ``plain_vowels`` is true, vowels are letters instead of marks."""
    out = F.translate(F.lower(c), X.LATIN, X.SHOWN)
    return out if plain_vowels is None else F.when(plain_vowels, F.translate(out, X.PLAIN_VOWELS_FROM, X.PLAIN_VOWELS_TO)).otherwise(out)


def route_score(c: Column, w_urdu=1.0, w_tashkeel=1.0, w_ornament=1.0, tashkeel_arabic=0.25) -> Column:
    vocal = F.least(F.lit(1.0), tashkeel_density(c) / tashkeel_arabic)
    ornate = F.when(ornament_density(c) > 0, w_ornament).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w_urdu * urdu_affinity(c) - w_tashkeel * vocal - ornate))


def route_language(score: Column, blank: Column, urdu_cut=0.2, arabic_cut=-0.2) -> Column:
    return F.when(blank, "unknown").when(score >= urdu_cut, "urdu").when(score <= arabic_cut, "arabic").otherwise("mixed")


def guess_language(c: Column) -> Column:
    """The provisional tag that a line gets when it is read."""
    a = urdu_affinity(c)
    return F.when((tashkeel_density(c) > 0.25) & (a <= 0), "arabic").when(a > 0.2, "urdu").when(a < -0.2, "arabic").otherwise("mixed")


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def error_rate(hypothesis: Column, reference: Column) -> Column:
    """Struct of rate, edits, units; an empty reference has rate 0 or 1 and no units."""
    edits, units = F.levenshtein(hypothesis, reference), F.length(reference)
    rate = F.when(units > 0, edits / units).when(F.length(hypothesis) > 0, 1.0).otherwise(0.0)
    return F.struct(rate.alias("rate"), F.when(units > 0, edits).otherwise(F.length(hypothesis)).alias("edits"), units.alias("units"))
