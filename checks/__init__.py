"""Checked queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["packets", "sequences", "scoring", "messages", "serving", "pieces", "service", "streams"]


def all_entries():
    for group in GROUPS:
        import_module(f"checks.{group}")
    from checks.catalog import ENTRIES

    return ENTRIES
