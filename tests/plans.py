"""Reading executed plans."""

from __future__ import annotations


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> list[str]:
    """The file scans of a plan; the session must not shorten their text."""
    return [line for line in physical(df).splitlines() if "FileScan" in line]
