"""Paths, lines and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column, folder: str) -> Column:
    """``path`` below ``folder`` (compared without case, at a separator), slashes forward."""
    root = folder.replace("\\", "/").rstrip("/") + "/"
    slashed = F.translate(path, "\\", "/")
    return F.when(F.lower(slashed).startswith(root.lower()), F.substring(slashed, len(root) + 1, 1 << 20)).otherwise(slashed)


def source_line(text: Column, line: Column) -> Column:
    return F.trim(F.translate(F.element_at(F.split(text, "\n"), line), "\r\t", "  "))


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0))


def member_signature() -> Column:
    """Accessibility, static, abstract, virtual, [sealed] override, then the signature."""
    flag = lambda c, word: F.when(F.col(c), F.lit(word))
    override = F.when(F.col("is_override"), F.when(F.col("is_sealed"), "sealed override").otherwise("override"))
    return F.concat_ws(" ", "accessibility", flag("is_static", "static"), flag("is_abstract", "abstract"), flag("is_virtual", "virtual"), override, F.coalesce("signature", "name"))


def via(table: Column, through: Column) -> Column:
    return F.when(through.isNull(), table).otherwise(F.concat(table, F.lit(" (via "), through, F.lit(")")))


def dependency_name(receiver: Column, method: Column) -> Column:
    return F.concat(F.lit("_"), F.regexp_replace(F.regexp_replace(receiver, r"^this\.", ""), "^_+", ""), F.lit("."), method)


def comma_set(text: str) -> list[str]:
    return list(dict.fromkeys(p for p in (x.strip() for x in text.split(",")) if p))


def parameter_query(name: str | None, type_name: str | None) -> str:
    return " ".join(x for x in (f"--name {name}" if name else "", f"--type {type_name}" if type_name else "") if x)
