"""The shape of a report as plain values, one for all ways to make one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

WATERMARK = ("statistical text watermark", "not evaluated: no detector or scheme is known here")
TEXT_COVERAGE = "code points and mixed scripts"
_FLAGS = ("structurally_parsed", "bytes_retained")
_DIAGNOSTIC = frozenset(("parse_status", "coverage", "warning", "warnings", "refusal", "refusal_reason"))


def by_frequency(values: Iterable[str]) -> dict[str, int]:
    """Most frequent first, then by name."""
    return dict(sorted(Counter(values).items(), key=lambda item: (-item[1], item[0])))


def substantive(metadata: dict[str, str]) -> dict[str, str]:
    """Metadata without what a reader says about its own work."""
    told = lambda key: key.split(".")[-1] in _DIAGNOSTIC or ".warning." in key or ".refusal." in key
    return {key: value for key, value in metadata.items() if not told(key)}


def verifiable(findings: list, metadata: dict[str, str], status: dict) -> dict:
    """What an inspection saw: findings with their counts, metadata and status."""
    return {
        "total": len(findings),
        "findings": [f._asdict() for f in findings],
        "counts_by_category": by_frequency(f.category for f in findings),
        "counts_by_severity": dict(Counter(f.severity for f in findings)),
        "metadata": {key: value == "true" if key.endswith(_FLAGS) else value for key, value in metadata.items()},
        "status": status,
    }


def status(parse_status: str, coverage: str = TEXT_COVERAGE, warnings: list[str] = (), refusals: list[str] = ()) -> dict:
    return {"parse_status": parse_status, "coverage": coverage, "warnings": list(warnings), "refusal_reasons": list(refusals)}


def body(source: str, kind: str, seen: dict, unknown: list[tuple[str, str]], changed: bool = False, edits: tuple[int, int, int] = (0, 0, 0)) -> dict:
    """A whole report; edits are the numbers removed, folded and normalized."""
    claims = [dict(zip(("claim", "reason"), pair)) for pair in unknown]
    counted = dict(zip(("removed", "folded", "normalized"), edits)) | {"transformed": sum(edits)}
    return {"source": source, "kind": kind, "verifiable": seen, "not_determinable": claims, "changed": changed} | counted
