"""Scopes: a set of plain-word filters, normalised, checked and turned into conditions.

One scope applies to three kinds of tables: innings tables (apply), matches (matches) and flagged
balls (balls), where team and opposition mean the sides as the role sees them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flags import entry_phase


class ScopeError(ValueError):
    """A filter that is unknown, cannot be read, or does not go with the others."""


FILTERS = ("competition", "format", "gender", "team", "opposition", "venue", "season", "from_year", "to_year", "phase", "innings", "position", "entry_phase", "entry_wickets", "result", "players")
# Other spellings of the filters' names.
SPELLINGS = {
    "competition": ("tournament", "event", "event_name", "league", "series"),
    "format": ("match_type",),
    "gender": ("sex",),
    "season": ("year",),
    "venue": ("ground", "stadium"),
    "opposition": ("opponent", "against", "vs"),
    "from_year": ("since", "start_year", "year_from"),
    "to_year": ("until", "end_year", "year_to"),
    "innings": ("inning", "innings_number"),
    "position": ("batting_position", "batting_order", "order"),
    "entry_wickets": ("entry_wkts", "wickets_down", "entry_wickets_down"),
    "entry_phase": ("came_in",),
    "result": ("match_result", "outcome"),
    "players": ("player",),
}
# Words for nothing, and for no restriction (which a gender keeps, as it switches off a default).
NOTHING = ("", "null", "none")
EVERYTHING = ("all", "both", "any", "overall", "n/a")
# Words for results.
RESULTS = {
    "won": ("won", "win", "wins", "winning", "victory", "victories"),
    "lost": ("lost", "loss", "losses", "losing", "lose", "defeat", "defeats"),
    "drawn": ("drawn", "draw", "draws"),
    "tied": ("tied", "tie", "ties"),
    "no result": ("no result", "no-result", "nr", "abandoned"),
}
# Words for positions, and the bounds of numbers.
POSITION_WORDS = {"opener": (1, 2), "openers": (1, 2), "opening": (1, 2), "top order": (1, 3), "top": (1, 3), "middle order": (4, 7), "middle": (4, 7), "lower order": (8, 11), "lower": (8, 11), "tail": (8, 11), "number 3": (3, 3), "no 3": (3, 3), "one down": (3, 3)}
POSITIONS, ENTRY_WICKETS, INNINGS = (1, 11), (0, 10), (1, 4)
# Words for the last season there is.
LATEST = ("latest", "current", "this season", "most recent")

_CANONICAL = {spelling: name for name, spellings in SPELLINGS.items() for spelling in (name, *spellings)}
_RESULT = {word: result for result, words in RESULTS.items() for word in words}


def plain(value) -> str:
    return " ".join(str(value).lower().split())


def normalise(filters: Mapping) -> dict:
    """Canonical names, the first of several spellings of one; what says nothing drops out."""
    known = {name: _CANONICAL.get("_".join(re.findall("[a-z]+", name.lower())), name) for name in filters}
    if strange := [name for name, canonical in known.items() if canonical not in FILTERS]:
        raise ScopeError(f"unknown filter {strange[0]!r}; there are: {', '.join(FILTERS)}")
    out: dict = {}
    for name, value in filters.items():
        word = plain(value) if isinstance(value, str) else None
        if value is None or word in NOTHING or (word in EVERYTHING and known[name] != "gender"):
            continue
        out.setdefault(known[name], "all" if word in EVERYTHING else value)
    return out


def bounds(value, within: tuple[int, int], words: Mapping | None = None) -> tuple[int, int]:
    """First and last of '3', '4-7', '4 to 7', '5+' (up to the largest), a pair, or one of the words."""
    least, most = within
    text = plain(value).replace("no.", "no").replace("#", "")
    if words and text in words:
        return words[text]
    if isinstance(value, Sequence) and not isinstance(value, str):
        ends = list(value)
    elif text.endswith("+"):
        ends = [text[:-1], most]
    else:
        ends = text.replace("to", "-").split("-")
    try:
        low, high = int(ends[0]), int(ends[-1])
    except (ValueError, IndexError):
        raise ScopeError(f"cannot read {value!r} as a number, a range or 'n+'") from None
    if len(ends) > 2 or not least <= low <= high <= most:
        raise ScopeError(f"{value!r} is not within {least} to {most}")
    return low, high


def _between(column: str, value, within: tuple[int, int], words: Mapping | None = None) -> Column:
    return F.col(column).between(*bounds(value, within, words))


def _in(column: str, value) -> Column:
    values = [value] if isinstance(value, str | int) else list(value)
    return F.col(column).isin(*values)


def _year(value) -> int:
    first = str(value).strip()[:4]
    if len(first) < 4 or not first.isdecimal():
        raise ScopeError(f"{value!r} does not begin with a year")
    return int(first)


def _season(value) -> Column:
    """'2024' also takes the split seasons 2023/24 and 2024/25 as far as they were played in 2024."""
    own = F.col("season") == str(value)
    if not str(value).isdecimal():
        return own
    year = _year(value)
    split = F.col("season").startswith(f"{year}/") | F.col("season").startswith(f"{year - 1}/")
    return own | (split & (F.col("yr") == year))


def result_of(value) -> str:
    if plain(value) not in _RESULT:
        raise ScopeError(f"unknown result {value!r}; there are: {', '.join(RESULTS)}")
    return _RESULT[plain(value)]


#: The condition of each filter on an innings table.
_INNINGS = {
    "competition": lambda v: _in("event", v),
    "format": lambda v: _in("format", v),
    "gender": lambda v: _in("gender", v),
    "team": lambda v: _in("team", v),
    "opposition": lambda v: _in("opposition", v),
    "venue": lambda v: _in("venue", v),
    "season": _season,
    "from_year": lambda v: F.col("yr") >= _year(v),
    "to_year": lambda v: F.col("yr") <= _year(v),
    "phase": lambda v: _in("phase", v),
    "innings": lambda v: _between("innings", v, INNINGS),
    "position": lambda v: _between("position", v, POSITIONS, POSITION_WORDS),
    "entry_phase": lambda v: entry_phase() == v,
    "entry_wickets": lambda v: _between("entry_wkts", v, ENTRY_WICKETS),
    "result": lambda v: F.col("result") == result_of(v),
    "players": lambda v: _in("player", v),
}
#: What a match as a whole can be asked for, and what only a role's innings can.
_OF_MATCHES = ("competition", "format", "gender", "venue", "season", "from_year", "to_year")
_OF_ROLES = ("position", "entry_phase", "entry_wickets", "result", "players")


@dataclass
class Scope:
    filters: dict
    notes: list[str] = field(default_factory=list)

    @property
    def phase(self):
        return self.filters.get("phase")

    def columns(self, skip: str | None = None) -> list[Column]:
        """One condition for each filter over an innings table; a null column fits no filter."""
        return [_INNINGS[name](v) for name, v in self.filters.items() if name != skip]

    def apply(self, df: DataFrame, skip: str | None = None) -> DataFrame:
        for c in self.columns(skip):
            df = df.filter(c)
        return df

    def matches(self, df: DataFrame) -> DataFrame:
        """The matches (event, format, gender, venue, season, yr, team1, team2) in scope: a team, and an
        opposition, is either side."""
        for name in _OF_MATCHES:
            if name in self.filters:
                df = df.filter(_INNINGS[name](self.filters[name]))
        for name in ("team", "opposition"):
            if name in self.filters:
                df = df.filter(_in("team1", self.filters[name]) | _in("team2", self.filters[name]))
        return df

    def balls(self, df: DataFrame, role: str = "batting") -> DataFrame:
        """The flagged balls in scope. For batting team is the side that bats, for bowling the one that
        bowls. Filters on what an innings table knows alone are refused."""
        if unfit := [name for name in _OF_ROLES if name in self.filters and name != "players"]:
            raise ScopeError(f"{unfit[0]} is only there for innings tables")
        sides = {"team": "team", "opposition": "opposition"} if role == "batting" else {"team": "opposition", "opposition": "team"}
        for name in (*_OF_MATCHES, "phase", "innings"):
            if name in self.filters:
                df = df.filter(_INNINGS[name](self.filters[name]))
        for name, column in sides.items():
            if name in self.filters:
                df = df.filter(_in(column, self.filters[name]))
        return df


def competition_of(name: str, competitions: Mapping[str, Sequence[str]], genders: Mapping[str, str], gender: str | None):
    """The events that a competition's name stands for, in all its naming eras, the season that the
    name ends with, if it does, and the competition's gender. A men's name asked for with gender
    female is tried as the women's one."""
    words = plain(name).split()
    season = words.pop() if len(words) > 1 and re.fullmatch(r"\d{4}(/\d{2})?", words[-1]) else None
    key = " ".join(words)
    if gender == "female" and genders.get(key) == "male" and f"women's {key}" in competitions:
        key = f"women's {key}"
    events = competitions.get(key)
    return list(events) if events else [name if season is None else name[: -len(season)].strip()], season, genders.get(key)


def build(role: str = "batting", innings_table: DataFrame | None = None, *, competitions: Mapping[str, Sequence[str]] | None = None, genders: Mapping[str, str] | None = None, default_gender: str | None = None, **filters) -> Scope:
    """Reads, checks and completes the filters.

    competitions: lower-case name -> the events of its naming eras; genders: lower-case name ->
    gender. A gender is the one given, else the competition's, else default_gender (with a note);
    'all' is none. season='latest' is looked up in the table under the other filters: the season of
    its last match.
    """
    found = normalise(filters)
    entry = [k for k in ("position", "entry_phase", "entry_wickets") if k in found]
    if entry and role == "bowling":
        raise ScopeError(f"{entry[0]} is only there for batting")
    if "phase" in found and any(k.startswith("entry") for k in entry):
        raise ScopeError("arrival filters do not go with a phase")
    scope = Scope(found)
    of_competition = None
    if competitions is not None and isinstance(found.get("competition"), str):
        found["competition"], season, of_competition = competition_of(found["competition"], competitions, genders or {}, found.get("gender"))
        if season:
            found.setdefault("season", season)
    if found.get("gender") == "all":
        del found["gender"]
    elif "gender" not in found and (of_competition or default_gender):
        found["gender"] = of_competition or default_gender
        if not of_competition:
            scope.notes.append(f"No gender was given: {default_gender}; 'all' or another one changes that.")
    if plain(found.get("season", "")) in LATEST:
        if innings_table is None:
            raise ScopeError("season 'latest' needs a table")
        last = scope.apply(innings_table, skip="season").select("date", "season").orderBy(F.desc_nulls_last("date"), F.desc("season")).limit(1).collect()
        found["season"] = last[0]["season"] if last else "none"
        scope.notes.append(f"Latest season: {found['season']}.")
    scope.columns()
    return scope
