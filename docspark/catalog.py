"""All queries by name: importing this module registers every operator."""

from __future__ import annotations

from .operators import aggregates, documents, extras, joins, keyed, lifecycle, maintenance, predicates, scalars, search, sets, sorting, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from .sources import containers, files  # noqa: F401
from .streaming import monitors, stretches  # noqa: F401
