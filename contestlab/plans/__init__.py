"""Registered queries: operators applied to the views, each with the SQL that states it."""

from . import appearances, audits, contests, forecasts, models, payloads, refits, reports, rules, seals, squads, views

MODULES = (contests, appearances, forecasts, models, audits, payloads, refits, reports, rules, seals, squads, views)
