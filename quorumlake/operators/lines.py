"""Rules for single lines of text."""

from __future__ import annotations

from pyspark.sql import Column


def first_ok(line: Column) -> Column:
    """A first line begins with a capital of the plain alphabet."""
    return line.rlike("^[A-Z]")


def last_ok(line: Column) -> Column:
    """A last line ends neither in a shortened word nor with a colon or hyphen."""
    return ~(line.rlike(r"(?i)(Mr|St|Mrs|No|Hon)\.$") | line.endswith(":") | line.endswith("-"))


def line_ok(line: Column) -> Column:
    """No line has digits, brackets or dashes."""
    return ~(line.rlike(r"\d") | line.contains("[") | line.contains("—") | line.contains("--"))
