"""Every query of the engine's own operators by name, with the SQL that states it."""

from __future__ import annotations

from contestlab.plans import MODULES

QUERIES: dict = {}
ORACLES: dict = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
