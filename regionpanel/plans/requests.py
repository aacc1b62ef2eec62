"""The requests the registered queries and the bench run (FIXTURES.md §3).

Scopes cover every state unless the request is about a county list; the
county list mixes padded, unpadded, duplicate and unknown codes on purpose.
"""

from __future__ import annotations

from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope

ALL_STATES = Scope.states(None)
COUNTY_CODES = "00017, 57, 00057, 99999"
DUP_COUNTY_CODES = "1, 01, 001, 2, 0002"
STATE_ABBREVS = "n03, N07 ,"
UNKNOWN_STATES = "ZZ"

BASIC_VARIABLES = (1, 11, 12, 43)
ALL_VARIABLES = (1, 11, 12, 13, 14, 15, 43)
DENSITY_VARIABLES = (1, 43)
SUM_CATEGORIES = ("PROMO", "SMALL", "Registration")       # the last is never seen
DETAIL_CATEGORY = "ECONOMY"
DETAIL_QUESTIONS = (1, 3, 5)
MATRIX_QUESTIONS = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
STATE_COLUMNS = ("Supplier count(0-n)", "Top balance($)")
SEARCH_TEXT = "red"
SEARCH_TEXTS = ("red", "e", "#1", "WIDGET", " rod #1", "large widget #3", "ll")


def full_categories() -> tuple[CategoryChoice, ...]:
    return (CategoryChoice(DETAIL_CATEGORY, False, DETAIL_QUESTIONS),
            *[CategoryChoice(c) for c in SUM_CATEGORIES])


def state_full(scope: Scope = ALL_STATES, band: str = "All") -> ExportSpec:
    return ExportSpec(scope, ALL_VARIABLES, STATE_COLUMNS, full_categories(), band)


def county_full() -> ExportSpec:
    return ExportSpec(Scope.counties(COUNTY_CODES), ALL_VARIABLES, STATE_COLUMNS, full_categories())


def state_only() -> ExportSpec:
    return ExportSpec(ALL_STATES, (), STATE_COLUMNS, (), "All", mandatory_variables=False)
