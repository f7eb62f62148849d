"""Checks of request arguments: unknown keys, types and ranges are refused with a message that names the field."""

from __future__ import annotations

from typing import Any

# Limits of the requests.
MAX_PATH, MAX_QUERY, MAX_SYMBOL, MAX_REF = 1024, 200, 500, 200
MAX_RECALL_REQUEST, MAX_CALLERS_REQUEST, MAX_DEPTH_REQUEST = 50, 100, 5
DIRECTIONS = ["callers", "callees"]


class BadRequest(ValueError):
    """The arguments of a request are refused."""


def _text(name: str, most: int, required: bool = False):
    def check(value: Any) -> str:
        if not isinstance(value, str):
            raise BadRequest(f"{name} must be a string")
        if not value.strip():
            raise BadRequest(f"{name} must not be blank")
        if len(value) > most:
            raise BadRequest(f"{name} is longer than {most} characters")
        return value

    return name, required, check


def _whole(name: str, least: int, most: int):
    def check(value: Any) -> int:
        if isinstance(value, bool) or not isinstance(value, int | float) or value != int(value):
            raise BadRequest(f"{name} must be a whole number")
        if not least <= value <= most:
            raise BadRequest(f"{name} must be from {least} to {most}")
        return int(value)

    return name, False, check


def _flag(name: str):
    def check(value: Any) -> bool:
        if not isinstance(value, bool):
            raise BadRequest(f"{name} must be true or false")
        return value

    return name, False, check


def _choice(name: str, allowed: list[str]):
    def check(value: Any) -> str:
        if value not in allowed:
            raise BadRequest(f"{name} must be one of {', '.join(allowed)}")
        return value

    return name, False, check


RULES = {
    "index": [_text("path", MAX_PATH)],
    "recall": [_text("query", MAX_QUERY, True), _whole("limit", 1, MAX_RECALL_REQUEST), _flag("substring"), _text("path", MAX_PATH)],
    "callers": [_text("symbol", MAX_SYMBOL, True), _choice("direction", DIRECTIONS), _whole("limit", 1, MAX_CALLERS_REQUEST), _flag("include_unresolved"), _text("path", MAX_PATH)],
    "impact": [_text("symbol", MAX_SYMBOL, True), _whole("depth", 1, MAX_DEPTH_REQUEST), _text("since", MAX_REF), _text("path", MAX_PATH)],
}


def validate(tool: str, arguments: Any) -> dict[str, Any]:
    """The arguments of one request, checked; absent and null optional ones are left out."""
    if tool not in RULES:
        raise BadRequest(f"unknown request {tool}")
    given = {} if arguments is None else arguments
    if not isinstance(given, dict):
        raise BadRequest("arguments must be an object")
    unknown = sorted(set(given) - {name for name, _, _ in RULES[tool]})
    if unknown:
        raise BadRequest(f"unknown keys: {', '.join(map(str, unknown))}")
    out = {}
    for name, required, check in RULES[tool]:
        if given.get(name) is not None:
            out[name] = check(given[name])
        elif required:
            raise BadRequest(f"{name} is required")
    return out
