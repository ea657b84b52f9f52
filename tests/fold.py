"""Burst detection event by event, to check the partitioned plans against."""

SECOND = 1_000_000


def openings(times, limit):
    found = []
    for us in sorted(times):
        if not found or us - found[-1] > limit:
            found.append(us)
    return found


def detect(events, limit, rank=10, overall_rank=100, cooldown=5 * SECOND, cap=10):
    """``events``: (us, event_id, level). Returns alerts and per-event counts."""
    state, alerts, severe_counts, overall_counts = {}, [], {}, {}
    for us, event_id, level in sorted(events):
        if level in ("ERROR", "CRITICAL"):
            window = state.setdefault(level, {"start": us, "count": 0, "sent": 0, "last": None})
            window["count"] += 1
            if us - window["start"] > limit:
                window.update(start=us, count=1, sent=0, last=None)
            severe_counts[event_id] = (window["start"], window["count"])
            if window["count"] > rank:
                fresh = window["last"] is None or us - window["last"] >= cooldown
                if window["sent"] < cap and fresh:
                    alerts.append((level, window["start"], us, window["count"]))
                    window.update(sent=window["sent"] + 1, last=us)
                continue
        window = state.setdefault("AGGREGATE_TRAFFIC", {"start": us, "count": 0, "sent": 0, "last": None})
        window["count"] += 1
        if us - window["start"] > limit:
            window.update(start=us, count=0, sent=1, last=None)
            overall_counts[event_id] = (us, 0)
            continue
        overall_counts[event_id] = (window["start"], window["count"])
        fresh = window["last"] is None or us - window["last"] >= cooldown
        if window["count"] >= overall_rank and window["sent"] < cap and fresh:
            alerts.append(("AGGREGATE_TRAFFIC", window["start"], us, window["count"]))
            window.update(sent=window["sent"] + 1, last=us)
    return sorted(alerts), severe_counts, overall_counts
