"""Where to continue, and in which steps, over minutely, hourly and daily change files."""

from __future__ import annotations

from datetime import UTC, datetime

PERIODS = (60, 3600, 86400)


def plan(start: int, latest: dict[int, int], end: int | None = None) -> list[tuple[int, int, int]]:
    """Steps (period, start, end) in seconds from ``start`` up to what is there (``latest`` end by period).

    Off an hour, minutes; off a day, hours; else days; a coarser file that isn't there yet makes way for finer ones."""
    out, at = [], start
    while end is None or at < end:
        wish = 0 if at % 3600 else 1 if at % 86400 else 2
        step = next((PERIODS[k] for k in range(wish, -1, -1) if PERIODS[k] in latest and at + PERIODS[k] <= latest[PERIODS[k]]), None)
        if step is None:
            break
        out.append((step, at, at + step))
        at += step
    return out


def parse_state(text: str) -> tuple[int, datetime]:
    """Sequence number and end time of a state file: lines key=value, blank and # lines skipped, \\: unescaped, UTC."""
    values = dict(x.split("=", 1) for x in text.splitlines() if x.strip() and not x.startswith("#") and "=" in x)
    stamp = values["timestamp"].replace("\\", "").strip()
    return int(values["sequenceNumber"]), datetime.fromisoformat(stamp.replace("Z", "+00:00")).astimezone(UTC)


def path_of(seq: int) -> str:
    s = f"{seq:09d}"
    return f"{s[:3]}/{s[3:6]}/{s[6:]}"
