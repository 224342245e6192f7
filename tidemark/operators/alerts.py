"""Alerts of checks over time: a problem is told once it has lasted, again while it lasts, and its end after it was told.

A check's levels are read in order of time with a small state: the level, since when,
and what was last told when. The same step serves a batch of all levels and a stream,
in which the state is kept by check.
"""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How long a problem of a level lasts before it is told, and when it is told again.
GRACE = {"fail": timedelta(minutes=9), "warn": timedelta(minutes=55)}
REMIND = timedelta(hours=6)
RANK = {"ok": 0, "warn": 1, "fail": 2}
EVENTS = "check string, kind string, level string, since timestamp, at timestamp"


def step(state: tuple | None, level: str, at):
    """(new state, event or None) of a check's level at a time; state: level, since, level told, time told."""
    old, since, told, told_at = state or ("ok", None, "ok", None)
    if level == "ok":
        return ("ok", at, "ok", None), ("recover", "ok", since, at) if told != "ok" else None
    began = since if old == level and since is not None else at
    kind = None
    if at - began >= GRACE[level] and RANK[level] > RANK[told]:
        kind = "alert"
    elif told != "ok" and told_at is not None and at - told_at >= REMIND:
        kind = "remind"
    if kind is None:
        return (level, began, told, told_at), None
    return (level, began, level, at), (kind, level, began, at)


def events(levels: DataFrame) -> DataFrame:
    """(check, kind, level, since, at) of levels (check, at, level); only changes of a check's level and its times are moved."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for check, at, level in rows.sort_values("at")[["check", "at", "level"]].itertuples(index=False):
            state, event = step(state, level, at)
            if event:
                out.append((check, *event))
        return pd.DataFrame(out, columns=["check", "kind", "level", "since", "at"])

    return levels.select("check", "at", "level").groupBy("check").applyInPandas(one, EVENTS)


def follow(levels: DataFrame) -> DataFrame:
    """The same for a stream of levels, the state kept by check from batch to batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def one(key, batches, state):
        own = tuple(state.get) if state.exists else None
        own = own and (own[0], own[1], own[2], own[3])
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, level in rows[["at", "level"]].itertuples(index=False):
            own, event = step(own, level, at)
            if event:
                out.append((key[0], *event))
        state.update(own)
        yield pd.DataFrame(out, columns=["check", "kind", "level", "since", "at"])

    return levels.select("check", "at", "level").groupBy("check").applyInPandasWithState(one, EVENTS, "level string, since timestamp, told string, told_at timestamp", "append", GroupStateTimeout.NoTimeout)
