"""All queries over the reference operators and their SQL, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "scoring", "decisions", "flow", "lists", "review", "evidence", "ledger", "reports", "scout", "stored", "checks")


def _gathered(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"lanternfish.plans.{module}"), name)
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE_SQL")
