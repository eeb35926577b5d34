"""Joined views of facts, observations, encounters and subjects.

Every join is a left join on a key, so no fact, observation or encounter is lost; lookups with a
repeated key repeat the row, as in any join. Columns of a lookup that the left side also has are
left out. Only ``fact_view(ordered=True)`` sorts globally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import require_columns
from .ranking import qs


def look_up(df: DataFrame, table: DataFrame | None, on: Sequence[str]) -> DataFrame:
    """Left join on equal key columns; ``None`` changes nothing."""
    if table is None:
        return df
    on = list(on)
    require_columns(df, on, "left side")
    require_columns(table, on, "lookup")
    fresh = [c for c in table.columns if c not in on and c not in df.columns]
    return df.join(table.selectExpr(*qs(on + fresh)), on, "left").selectExpr(*qs(df.columns + fresh))


def fact_view(
    facts: DataFrame,
    titles: DataFrame | None = None,
    encounters: DataFrame | None = None,
    title_keys: Sequence[str] = ("icd_code", "icd_version"),
    encounter: str = "hadm_id",
    position: str = "seq_num",
    ordered: bool = False,
) -> DataFrame:
    """Facts with their titles and encounters, rows of an encounter in order.

    By default rows are sorted inside each encounter's partition; ``ordered`` sorts the whole table.
    """
    out = look_up(look_up(facts, titles, title_keys), encounters, [encounter])
    if ordered:
        return out.orderBy(encounter, position)
    return out.repartition(encounter).sortWithinPartitions(encounter, position)


def observation_view(
    observations: DataFrame,
    items: DataFrame | None = None,
    subject_value=None,
    item: str = "itemid",
    subject: str = "subject_id",
    time: str = "charttime",
) -> DataFrame:
    """Observations with item labels; with ``subject_value`` those of one subject in time order."""
    if subject_value is None:
        return look_up(observations, items, [item])
    one = observations.where(observations[subject] == subject_value)
    return look_up(one, items, [item]).orderBy(time)


def encounter_view(
    encounters: DataFrame,
    people: DataFrame | None = None,
    facts: DataFrame | None = None,
    titles: DataFrame | None = None,
    encounter: str = "hadm_id",
    subject: str = "subject_id",
    position: str = "seq_num",
    title_keys: Sequence[str] = ("icd_code", "icd_version"),
) -> DataFrame:
    """Encounters with their subject and the primary fact (position 1) and its title."""
    out = look_up(encounters, people, [subject])
    if facts is None:
        return out
    primary = facts.where(facts[position] == 1).drop(position, *[c for c in (subject,) if c in facts.columns])
    return look_up(look_up(out, primary, [encounter]), titles, title_keys)


def star_view(
    observations: DataFrame,
    items: DataFrame | None,
    encounters: DataFrame,
    people: DataFrame | None = None,
    facts: DataFrame | None = None,
    titles: DataFrame | None = None,
    encounter: str = "hadm_id",
    **keys,
) -> DataFrame:
    """Every observation with its item, encounter, subject and primary fact."""
    stays = encounter_view(encounters, people, facts, titles, encounter, **keys)
    return look_up(observation_view(observations, items), stays, [encounter])
