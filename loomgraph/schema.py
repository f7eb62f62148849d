"""Relations of the code graph, the caps applied on load, and the closed sets of values."""

from __future__ import annotations

# Symbol kinds and text caps.
KINDS = ["function", "class", "method", "getter", "setter", "interface", "type", "variable", "enum", "module"]
CAPS = {"id": 500, "name": 500, "file": 1024, "signature": 400, "generic": 2000, "repo_id": 64, "sha": 64, "branch": 256, "kind": 32}
MAX_RECALL, MAX_NEIGHBOURS, MAX_DEPTH = 100, 500, 5
DEFAULT_DEPTH, DEFAULT_LEVEL_LIMIT, FAN_IN = 3, 100, 500
MODULE = "<module>"

SYMBOLS = "repo_id string, id string, name string, kind string, file string, line int, column int, end_line int, signature string, exported boolean, parent string, is_static boolean, extends array<string>, implements array<string>, seq long"
RAW_CALLS = "repo_id string, from_id string, to_name string, file string, line int, column int, seq long"
