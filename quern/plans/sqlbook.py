"""Queries written as SQL over named tables: `{documents}` stands for a table in Spark and in the checking engine."""

from __future__ import annotations

import re

from quern.plans import registry
from quern.session import table

_NAME = re.compile(r"\{(\w+)\}")


def sql(name: str, text: str, duck: str | None = None, oracle: bool = True) -> None:
    """Register SQL text for Spark; `duck` where the checking engine needs other spelling (default: the same text)."""
    names = sorted(set(_NAME.findall(text)))

    def run(spark, sf_dir):
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    check = duck if duck is not None else text
    registry.register(name, _NAME.sub(r"\1", check) if oracle else None)(run)


def checked(name: str, check: str, run) -> None:
    """Register an operator's query beside the SQL that checks it, in which `{documents}` stands for a table."""
    registry.register(name, _NAME.sub(r"\1", check))(run)
