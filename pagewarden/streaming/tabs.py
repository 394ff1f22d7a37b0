"""The state of browser tabs as a keyed state machine over events, in a stream or over a table.

Events: tab_id, ts (milliseconds), type, and what the type needs (see EVENT). A tab's events are applied
in order of time, then of a column seq if there is one. A timer is armed by a finished navigation and ends the wait for the page's own score;
a new navigation or that score disarms it. What the machine does is in advance(); the stream keeps its
state in the state store, and replay() runs the same over a table, one group for each tab.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Waits in milliseconds, and how often a page is scored again.
STAGE2_TIMEOUT_MS, RESCORE_DEBOUNCE_MS, MAX_RESCORES = 1500, 250, 3
# The messages that pages and the popup may send.
MESSAGES = "SCORE_REQUEST SCORE_RESULT GET_TAB_STATE GET_SETTINGS SET_ENABLED SET_ALLOWLIST PROCEED DISMISS MANUAL_CHECK DEEP_SCAN CLOSE_TAB".split()
_RANK = {"UNKNOWN": -1, "LOW": 0, "MEDIUM": 1, "HIGH": 2}
EVENT = "tab_id bigint, ts bigint, type string, frame_id int, url string, level string, score double, requested_tab bigint"
STATE = "tab_id bigint, ts bigint, event string, url string, stage1 string, stage2 string, final string, score double, dismissed boolean, proceeded boolean, badge string"


def merged(first: dict | None, second: dict | None) -> dict | None:
    """As verdicts.merge(), on {level, score}."""
    if first is None or second is None:
        return second if first is None else first
    if first["level"] == "HIGH":
        return first
    if second["score"] < 0.15 and first["level"] == "MEDIUM":
        return second
    return second if _RANK[second["level"]] >= _RANK[first["level"]] else first


def is_message(kind: str) -> bool:
    return kind in MESSAGES


def valid_messages(messages: DataFrame, type_col: str = "type") -> tuple[DataFrame, DataFrame]:
    """(messages of a known type, the rest with the error that they are answered with)"""
    known = F.coalesce(F.col(type_col).isin(MESSAGES), F.lit(False))
    return messages.filter(known), messages.filter(~known).withColumn("error", F.lit("UNKNOWN_MESSAGE"))


def _in_order(event: dict) -> tuple:
    """By time, then by seq where events have one, then by all they say: events of one time never depend on how they arrive."""
    return event["ts"], event.get("seq") or 0, str(sorted((k, str(v)) for k, v in event.items()))


def _row(tab_id: int, ts: int, event: str, tab: dict | None, badge: str | None) -> dict:
    tab = tab or {}
    level = lambda k: (tab.get(k) or {}).get("level")
    final = tab.get("final") or {}
    return {"tab_id": tab_id, "ts": ts, "event": event, "url": tab.get("url"), "stage1": level("stage1"), "stage2": level("stage2"), "final": final.get("level"), "score": final.get("score"), "dismissed": tab.get("dismissed"), "proceeded": tab.get("proceeded"), "badge": badge}


def advance(tab_id: int, state: dict, events: list[dict], until: int | None = None, main_frame_only: bool = False) -> list[dict]:
    """Apply events in order to state ({tab, timer, enabled}, changed in place); the rows that come out.

    Timers that are due fire between the events, and up to `until` behind them. A stage-2 score is merged
    with the tab's first stage whatever URL and frame it came from; main_frame_only turns the latter off.
    """
    out: list[dict] = []
    tab = state.get("tab")

    def fire(upto):
        nonlocal tab
        if state.get("timer") is not None and state["timer"] <= upto:
            at, state["timer"] = state["timer"], None
            if tab is not None and tab["stage2"] is None:
                tab["final"] = tab["stage1"] or {"level": "UNKNOWN", "score": 0.0}
                out.append(_row(tab_id, at, "timeout", tab, tab["final"]["level"]))

    for e in sorted(events, key=_in_order):
        fire(e["ts"])
        kind, ts = e["type"], e["ts"]
        web = bool(e.get("url")) and e["url"].startswith(("http://", "https://"))
        scored = {"level": e.get("level"), "score": e.get("score") or 0.0} if e.get("level") else None
        if kind == "navigate" and (e.get("frame_id") or 0) == 0 and web:
            state["timer"] = None
            if not state.get("enabled", True):
                out.append(_row(tab_id, ts, kind, tab, "UNKNOWN"))
            elif scored:  # the URL's own score; without one the URL can't be scored
                keep = tab if tab is not None and tab["url"] == e["url"] else {}
                tab = {"url": e["url"], "stage1": scored, "stage2": None, "final": scored, "dismissed": keep.get("dismissed", False), "proceeded": keep.get("proceeded", False)}
                out.append(_row(tab_id, ts, kind, tab, scored["level"]))
        elif kind == "completed" and (e.get("frame_id") or 0) == 0 and web:
            state["timer"] = ts + STAGE2_TIMEOUT_MS
        elif kind == "SCORE_REQUEST" and not (main_frame_only and (e.get("frame_id") or 0) != 0):
            if state.get("enabled", True) and scored:
                state["timer"] = None
                tab = tab or {"url": e.get("url"), "stage1": None, "stage2": None, "final": None, "dismissed": False, "proceeded": False}
                tab |= {"url": e.get("url"), "final": merged(tab["stage1"], scored), "stage2": scored}
                out.append(_row(tab_id, ts, kind, tab, tab["final"]["level"]))
        elif kind == "PROCEED" and tab is not None and e.get("requested_tab") in (None, tab_id):
            tab["proceeded"] = True
            out.append(_row(tab_id, ts, kind, tab, None))
        elif kind == "DISMISS" and tab is not None:
            tab["dismissed"] = True
            out.append(_row(tab_id, ts, kind, tab, None))
        elif kind == "SET_ALLOWLIST" and e.get("level") == "LOW":
            out.append(_row(tab_id, ts, kind, tab, "LOW"))
        elif kind == "SET_ENABLED":
            state["enabled"] = e.get("level") != "UNKNOWN"
            if not state["enabled"]:
                out.append(_row(tab_id, ts, kind, tab, "UNKNOWN"))
        elif kind == "removed":
            tab, state["timer"] = None, None
            out.append(_row(tab_id, ts, kind, None, ""))
    if until is not None:
        fire(until)
    state["tab"] = tab
    return out


_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def _events(pdf: pd.DataFrame) -> list[dict]:
    return [{k: None if v is None or v != v else v for k, v in r.items()} for r in pdf.astype(object).to_dict("records")]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype(object)


def replay(events: DataFrame, until_end: bool = True, main_frame_only: bool = False) -> DataFrame:
    """All rows that come out of a table of events; with until_end, timers fire after the last event, too."""

    def run(key, pdf):
        return _frame(advance(int(key[0]), {}, _events(pdf), 1 << 62 if until_end else None, main_frame_only))

    return events.groupBy("tab_id").applyInPandas(run, STATE)


def track(events: DataFrame, time_col: str = "event_time", delay: str = "10 seconds", main_frame_only: bool = False) -> DataFrame:
    """The same over a stream of events that has an event-time column; timers follow the watermark.

    The state stays until the tab is removed, so a late score is still taken.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        seen = [e for pdf in frames for e in _events(pdf.drop(columns=[time_col]))]
        rows = advance(int(key[0]), kept, seen, state.getCurrentWatermarkMs() if state.hasTimedOut else None, main_frame_only)
        if kept.get("tab") is None and kept.get("timer") is None and kept.get("enabled", True):
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(kept, default=float),))
            if kept.get("timer") is not None:
                state.setTimeoutTimestamp(max(int(kept["timer"]), state.getCurrentWatermarkMs() + 1))
        yield _frame(rows)

    return events.withWatermark(time_col, delay).groupBy("tab_id").applyInPandasWithState(run, STATE, "json string", "append", GroupStateTimeout.EventTimeTimeout)


def rescore_times(mutations: DataFrame, wait_ms: int = RESCORE_DEBOUNCE_MS, most: int = MAX_RESCORES) -> DataFrame:
    """When a page is scored again (page_id, ts) after changes (page_id, ts, has_form).

    The first change arms a timer and those before it ends are ignored; a page without a form isn't
    scored then; at most `most` times in all. Changes of one page come together in one group.
    """

    def run(key, pdf):
        out, armed, form = [], None, False

        def fire():
            if armed is not None and form and len(out) < most:
                out.append(armed)

        for ts, has_form in pdf.sort_values("ts")[["ts", "has_form"]].itertuples(index=False):
            if armed is not None and ts >= armed:
                fire()
                armed = None
            form = bool(has_form)
            if armed is None and len(out) < most:
                armed = int(ts) + wait_ms
        fire()
        return pd.DataFrame({"page_id": [key[0]] * len(out), "ts": out})

    return mutations.groupBy("page_id").applyInPandas(run, "page_id bigint, ts bigint")


def latest_settings(events: DataFrame) -> DataFrame:
    """The last state of each tab, from the rows that came out: one row for each tab."""
    cols = [c for c in _COLUMNS if c != "tab_id"]
    return events.groupBy("tab_id").agg(F.max_by(F.struct(*cols), F.col("ts")).alias("s")).select("tab_id", "s.*")
