"""Redaction of secrets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary; Java's own also counts other letters.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: The same before a letter or digit, with which every rule that begins at a boundary goes on.
START = r"(?<![A-Za-z0-9_])"

# Label, pattern (with ASCII word boundaries), replacement, in order of application.
PATTERNS = [
    ("pem-private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN ***REDACTED*** PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "***JWT-REDACTED***"),
    ("sk-token", r"\bsk-[A-Za-z0-9_-]{20,}\b", "sk-***REDACTED***"),
    ("github-pat", r"\bghp_[A-Za-z0-9]{30,}\b", "ghp_***REDACTED***"),
    ("github-server", r"\bghs_[A-Za-z0-9]{30,}\b", "ghs_***REDACTED***"),
    ("github-oauth", r"\bgho_[A-Za-z0-9]{30,}\b", "gho_***REDACTED***"),
    ("github-refresh", r"\bghr_[A-Za-z0-9]{30,}\b", "ghr_***REDACTED***"),
    ("aws-akia", r"\bAKIA[0-9A-Z]{16}\b", "AKIA***REDACTED***"),
    ("aws-asia", r"\bASIA[0-9A-Z]{16}\b", "ASIA***REDACTED***"),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", "xox*-***REDACTED***"),
    ("stripe-live", r"\bsk_live_[A-Za-z0-9]{20,}\b", "sk_live_***REDACTED***"),
    ("long-token-in-string", r"""(["'])([A-Za-z0-9_+/=-]{40,})\1""", "$1***REDACTED-LONG-TOKEN***$1"),
]


def _java(pattern: str) -> str:
    if pattern.startswith(r"\b"):
        pattern = START + pattern[2:]
    return pattern.replace(r"\b", EDGE)


def redact_secrets(text: Column) -> Column:
    """Every rule rewrites what the rules before it left."""
    for _, pattern, replacement in PATTERNS:
        text = F.regexp_replace(text, _java(pattern), replacement)
    return text


def detect_secrets(text: Column) -> Column:
    """Labels whose patterns match the original text, comma-joined in rule order."""
    return F.array_join(F.array_compact(F.array(*(F.when(text.rlike(_java(p)), label) for label, p, _ in PATTERNS))), ",")


def sanitize(text: Column, most: int) -> Column:
    """Control characters become spaces one for one, then the text is clipped."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), 1, most)


def one_line_signature(text: Column) -> Column:
    """The first line, trimmed; above 200 characters its first 197 and an ellipsis; then redacted."""
    line = F.trim(F.substring_index(text, "\n", 1))
    return redact_secrets(F.when(F.length(line) > 200, F.concat(F.substring(line, 1, 197), F.lit("..."))).otherwise(line))


def repo_id(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 16)
