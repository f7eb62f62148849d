"""An append-only log of requests, one JSON line each, kept on the driver."""

from __future__ import annotations

import datetime as dt
import json
import os
import re

# Caps of the log.
MAX_BYTES, MAX_TEXT, MAX_KEY = 10 * 1024 * 1024, 500, 64
OFF = "LOOMGRAPH_NO_LOG"

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
FIELDS = "ts string, tool string, input map<string,string>, results int, durationMs int, error string"


def clean_input(arguments: object) -> dict:
    """Plain values with control characters as spaces and texts clipped; nested values are only marked; long keys go."""
    out = {}
    for key, value in arguments.items() if isinstance(arguments, dict) else ():
        if not isinstance(key, str) or len(key) > MAX_KEY:
            continue
        if isinstance(value, str):
            out[key] = _CONTROL.sub(" ", value)[:MAX_TEXT]
        else:
            out[key] = value if value is None or isinstance(value, bool | int | float) else "[unloggable]"
    return out


def append(path: str, tool: str, arguments: object, results: int, millis: float, error: str | None = None) -> None:
    """Add a line, readable by its owner only; a full log first moves aside, in place of the one moved before."""
    if os.environ.get(OFF) == "1":
        return
    entry = {"ts": dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds"), "tool": tool, "input": clean_input(arguments), "results": results, "durationMs": round(millis)}
    if error:
        entry["error"] = _CONTROL.sub(" ", error)[:MAX_TEXT]
    os.makedirs(os.path.dirname(path), mode=0o700, exist_ok=True)
    if os.path.exists(path) and os.path.getsize(path) > MAX_BYTES:
        os.replace(path, path + ".1")
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600), "a") as f:
        f.write(json.dumps(entry) + "\n")
