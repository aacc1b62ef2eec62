"""Export request (X4): scope, variables, per-category score mode, band.

A plain dataclass the driver holds; it never touches data. ``to_json`` /
``from_json`` give the provenance record written next to an export.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from regionpanel.functions.keys import county_request_text, digits_text, split_text

BANDS = ("All", "Rural", "Suburban", "Urban")


@dataclass(frozen=True)
class Scope:
    """Which counties an export covers.

    kind "state": ``codes`` are state abbreviations (``None`` = every state);
    kind "county": ``codes`` are county codes as typed (padded or not).
    """

    kind: str = "state"
    codes: tuple[str, ...] | None = None

    @classmethod
    def states(cls, abbrevs=None) -> "Scope":
        if abbrevs is None or abbrevs == "*":
            return cls("state", None)
        return cls("state", tuple(split_text(abbrevs)))

    @classmethod
    def counties(cls, codes) -> "Scope":
        return cls("county", tuple(split_text(codes)))

    @property
    def all_states(self) -> bool:
        return self.kind == "state" and self.codes is None

    def abbrev_keys(self) -> list[str]:
        """Upper-cased, trimmed, de-duplicated abbreviations (K5)."""
        return sorted({c.strip().upper() for c in self.codes or ()})

    def county_keys(self) -> list[str]:
        """Canonical county keys of the request, de-duplicated (J4 deviation:
        a code typed twice, even in two forms, counts once; a code without
        any digit names no county)."""
        return sorted({county_request_text(c) for c in self.codes or () if digits_text(c)})


@dataclass(frozen=True)
class CategoryChoice:
    """One survey category: its sum (default) or chosen questions plus total."""

    category: str
    sum_scores: bool = True
    selected_questions: tuple = ()


@dataclass(frozen=True)
class ExportSpec:
    scope: Scope = field(default_factory=Scope)
    census_variables: tuple = ()          # names (str) or ids (int)
    state_variables: tuple = ()           # column names of the wide state table
    categories: tuple[CategoryChoice, ...] = ()
    band: str = "All"
    mandatory_variables: bool = True      # L7: population and land area always in
    sum_suffix: str = "_Sum"

    def __post_init__(self):
        if self.band not in BANDS:
            # deviation: the reference silently keeps every row for an unknown band
            raise ValueError(f"band must be one of {BANDS}, not {self.band!r}")

    @classmethod
    def build(cls, scope: Scope, census=(), state=(), categories=None, band="All",
              mandatory=True) -> "ExportSpec":
        cats = []
        for item in (categories or ()):
            if isinstance(item, CategoryChoice):
                cats.append(item)
            elif isinstance(item, str):
                cats.append(CategoryChoice(item))
            else:
                name, opts = item
                cats.append(CategoryChoice(name, bool(opts.get("sum_scores", True)),
                                           tuple(opts.get("selected_questions", ()))))
        census_list = census if isinstance(census, (list, tuple)) else split_text(census)
        return cls(scope, tuple(census_list), tuple(split_text(state)), tuple(cats), band,
                   mandatory)

    def sum_categories(self) -> list[str]:
        seen, out = set(), []
        for c in self.categories:
            if c.sum_scores and c.category not in seen:
                seen.add(c.category)
                out.append(c.category)
        return out

    def detail_categories(self) -> list[CategoryChoice]:
        return [c for c in self.categories if not c.sum_scores]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "ExportSpec":
        d = json.loads(text)
        scope = Scope(d["scope"]["kind"], None if d["scope"]["codes"] is None
                      else tuple(d["scope"]["codes"]))
        cats = tuple(CategoryChoice(c["category"], c["sum_scores"], tuple(c["selected_questions"]))
                     for c in d.get("categories", ()))
        return cls(scope, tuple(d.get("census_variables", ())), tuple(d.get("state_variables", ())),
                   cats, d.get("band", "All"), d.get("mandatory_variables", True),
                   d.get("sum_suffix", "_Sum"))
