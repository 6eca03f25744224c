"""All registered queries of the library proper, with their DuckDB oracles."""

from __future__ import annotations

from . import admission, corpus, fleet, governance, inventory, knowledge, matching, process, records, retrieval, validation  # noqa: F401  the others add to governance and knowledge


def queries() -> dict:
    return knowledge.QUERIES | governance.QUERIES


def oracles() -> dict[str, str]:
    return knowledge.ORACLES | governance.ORACLES
