"""Declared schemas of the official files, by stem without the population's letter."""

from __future__ import annotations

_SIDE = ["FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "DR", "TO", "Ast", "Stl", "Blk", "PF"]
_COMPACT = "Season INT, DayNum INT, WTeamID INT, WScore INT, LTeamID INT, LScore INT, WLoc STRING, NumOT INT"
SCHEMAS = {
    "RegularSeasonCompactResults": _COMPACT,
    "NCAATourneyCompactResults": _COMPACT,
    "RegularSeasonDetailedResults": _COMPACT + ", " + ", ".join(f"{s}{c} INT" for s in "WL" for c in _SIDE),
    "NCAATourneySeeds": "Season INT, Seed STRING, TeamID INT",
    "MasseyOrdinals": "Season INT, RankingDayNum INT, SystemName STRING, TeamID INT, OrdinalRank INT",
    "TeamCoaches": "Season INT, TeamID INT, FirstDayNum INT, LastDayNum INT, CoachName STRING",
    "TeamConferences": "Season INT, TeamID INT, ConfAbbrev STRING",
    "SampleSubmissionStage2": "ID STRING, Pred DOUBLE",
}
