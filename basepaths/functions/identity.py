"""Person and team keys as columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths import schema as S


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Every code point whose compatibility decomposition keeps exactly one ASCII letter or digit."""
    source, target = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalnum():
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


# fixed values: Latin ligatures and the letters they stand for
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}


def person_key(name: Column) -> Column:
    """Accents folded, ligatures spelled out, lower case, letters and digits only. Stays in the JVM."""
    source, target = _accents()
    given = F.coalesce(name, F.lit(""))
    spelled = given
    for sign, letters in LIGATURES.items():
        spelled = F.replace(spelled, F.lit(sign), F.lit(letters))
    folded = F.translate(F.when(given.rlike("[\ufb00-\ufb06]"), spelled).otherwise(given), source, target)
    plain = F.when(given.rlike(r"[^\x00-\x7f]"), folded).otherwise(given)
    return F.regexp_replace(F.lower(plain), "[^a-z0-9]", "")


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def canonical_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Person key with known misspellings mapped to one key."""
    aliases = S.PERSON_ALIASES if aliases is None else aliases
    key = person_key(name)
    return F.coalesce(F.try_element_at(literal_map(aliases), key), key) if aliases else key


def apply_aliases(df: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Re-key by an alias table (alias, target); Spark picks the join by the table's size."""
    return (
        df.join(aliases.select(F.col("alias").alias(key), F.col("target").alias("_target")), key, "left")
        .withColumn(key, F.coalesce("_target", key))
        .drop("_target")
    )


def team_key(name: Column, nicknames=S.TEAM_NICKNAMES, league_prefix: str = "") -> Column:
    """Nickname a team name ends with, else the plain name without the league prefix."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
    rest = F.regexp_replace(plain, f"^{league_prefix.lower()}", "") if league_prefix else plain
    return F.coalesce(*[F.when(plain.endswith(nick), F.lit(nick)) for nick in nicknames], rest)


def display_team(name: Column, season: Column, cities: dict[str, str] | None = None,
                 league_prefix: str = "", short_season: int = 2025) -> Column:
    """Short name in the first season, city name afterwards."""
    cities = S.TEAM_CITIES if cities is None else cities
    short = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), f"^{league_prefix} " if league_prefix else "^$", ""))
    return F.when(season == short_season, short).otherwise(F.coalesce(F.try_element_at(literal_map(cities), short), short))


def team_family(team: Column, families: dict[str, str] | None = None) -> Column:
    """The franchise of a team, by default under the names it has had."""
    families = S.TEAM_FAMILIES if families is None else families
    return F.coalesce(F.try_element_at(literal_map(families), team), team) if families else team


def main_team(teams: Column) -> Column:
    """The last team of a player's list."""
    return F.try_element_at(teams, F.lit(-1))


def strip_class_year(name: Column) -> Column:
    """Name without a trailing bracketed class year such as "(Jr)" or "(RS-So)"."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), S.CLASS_YEAR, ""))


def plain_name(name: Column, nicknames: dict[str, str] | None = None) -> Column:
    """Lower case, single spaces, nickname of the first word replaced by the full first name."""
    nicknames = S.NICKNAMES if nicknames is None else nicknames
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+"), lambda w: w != "")
    first = F.get(words, F.lit(0))
    full = F.coalesce(F.try_element_at(literal_map(nicknames), first), first)
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat_ws(" ", full, F.array_join(F.when(F.size(words) > 1, rest).otherwise(F.array().cast("array<string>")), " "))


def initial_surname_key(name: Column) -> Column:
    """First initial plus last word of the plain name; NULL for an empty name."""
    words = F.split(F.trim(plain_name(name)), " ")
    key = F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.try_element_at(words, F.lit(-1)))
    return F.nullif(key, F.lit(""))
