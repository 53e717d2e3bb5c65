"""The registered queries of the operators, and the SQL each must agree with where SQL can say it."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

SUBJECTS = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11",
            "op12", "op13")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for subject in SUBJECTS:
        merged.update(getattr(import_module(f"{__package__}.queries.{subject}"), attribute, {}))
    return merged


def queries() -> dict:
    return _merged("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
