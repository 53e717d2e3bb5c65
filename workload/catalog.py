"""All queries and their SQL, collected from the subject modules."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ("gold", "features", "monitoring", "documents", "questions", "evaluation", "training")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for subject in SUBJECTS:
        merged.update(getattr(import_module(f"workload.{subject}"), attribute))
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
