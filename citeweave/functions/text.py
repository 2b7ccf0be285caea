"""Scalar text functions: record clean-up, rule numbers, normalisation, word forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_MAX_CHARS = 60


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_query(uri: Column) -> Column:
    """A URL without its query string; empty or null stays null."""
    return F.substring_index(empty_to_null(uri), "?", 1)


def front_value(top: Column, faces: Column, field: str) -> Column:
    """A record-level field, else the same field of its first face."""
    return F.coalesce(top, F.get(faces, F.lit(0)).getField(field))


def faces_text(top: Column, faces: Column) -> Column:
    """Record text, else the texts of all faces joined by a ``//`` line."""
    joined = F.array_join(F.transform(faces, lambda f: F.coalesce(f.getField("oracle_text"), F.lit(""))), "\n//\n")
    return F.when((F.coalesce(top, F.lit("")) == "") & faces.isNotNull(), joined).otherwise(F.coalesce(top, F.lit("")))


def parent_id(rule_id: Column) -> Column:
    """``100`` -> null, ``100.1`` -> ``100``, ``100.1a`` -> ``100.1``."""
    return (
        F.when(rule_id.rlike(r"\.\d*[a-z]$"), F.regexp_replace(rule_id, r"[a-z]$", ""))
        .when(rule_id.contains("."), F.substring_index(rule_id, ".", 1))
    )


def is_title(text: Column) -> Column:
    """Heading-like text: short and not ending like prose."""
    return (F.length(text) <= TITLE_MAX_CHARS) & ~text.rlike(r"(?U)[.:)]\s*$")


def normalize_rule_id(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\.+$", ""))


def entry_id(rule_id: Column) -> Column:
    """The entry a subrule belongs to; entries and headings are their own entry."""
    return F.regexp_replace(rule_id, r"^(\d{3}\.\d+)[a-z]+$", "$1")


def is_top_level(rule_id: Column) -> Column:
    return rule_id.rlike(r"^\d{3}$")


def section_of(rule_id: Column) -> Column:
    return empty_to_null(F.regexp_extract(rule_id, r"^(\d)\d{2}(?:\.|$)", 1)).cast("int")


def normalize_query(c: Column) -> Column:
    """Lowercase, whitespace collapsed, trailing ``?!.`` and blanks dropped."""
    collapsed = F.regexp_replace(F.lower(c), r"(?U)\s+", " ")
    return F.regexp_replace(F.trim(collapsed), r"[?!. ]+$", "")


def is_external_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def snapshot_date(path: Column) -> Column:
    """The first ISO date in a file name, else null."""
    return empty_to_null(F.regexp_extract(path, r"\d{4}-\d{2}-\d{2}", 0))


def image_variant(uri: Column, size: str) -> Column:
    """The same image at another size: the first ``/normal/`` of the path replaced."""
    at = F.instr(uri, "/normal/")
    return F.when(at > 0, F.concat(F.substring(uri, F.lit(1), at - 1), F.lit(f"/{size}/"),
                                   F.substring(uri, at + F.lit(len("/normal/")), F.length(uri)))).otherwise(uri)


def visible_draft(draft: Column) -> Column:
    """A draft without a citation marker that has not closed yet."""
    return F.regexp_replace(draft, r"\[[\d,\s]*$", "")


def base_forms(name: Column) -> Column:
    """The names a heading stands for: ``x (y)`` gives x and y, ``x and y`` also its parts."""
    clean = F.trim(F.regexp_replace(F.lower(name), "!+$", ""))
    paren = r"^(.*?)\s*\((.+)\)$"
    whole = F.when(clean.rlike(paren), F.array(F.regexp_extract(clean, paren, 1), F.regexp_extract(clean, paren, 2))).otherwise(F.array(clean))
    parts = F.when(clean.contains(" and "), F.split(clean, " and ")).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(F.concat(whole, parts), lambda f: F.trim(f)), lambda f: f != "")


def inflections(form: Column) -> Column:
    """Regular inflections of a form that ends in a letter; none otherwise."""
    stem = F.substring(form, F.lit(1), F.length(form) - 1)
    plain = F.array(*[F.concat(form, F.lit(s)) for s in ("s", "es", "ed", "ing")])
    silent_e = F.array(F.concat(form, F.lit("d")), F.concat(stem, F.lit("ing")))
    return (
        F.when(~form.rlike(r"\p{L}$"), F.array().cast("array<string>"))
        .when(form.endswith("e"), F.concat(plain, silent_e))
        .otherwise(plain)
    )
