"""Policies: presets, composition of overlays, and what they mean for guards. Plain Python, done when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

GUARDS = ("pii", "secret", "injection", "leakage")
LEVELS = ("critical", "high", "medium", "low", "none")


@dataclass(frozen=True)
class GuardPolicy:
    """None means not stated; an empty list of types means all."""

    enabled: bool | None = None
    threshold: float | None = None
    mode: str | None = None
    entity_types: tuple[str, ...] | None = None
    secret_types: tuple[str, ...] | None = None


@dataclass(frozen=True)
class RiskThresholds:
    critical: float
    high: float
    medium: float
    low: float


@dataclass(frozen=True)
class Policy:
    name: str
    description: str
    guards: dict[str, GuardPolicy] = field(default_factory=dict)
    risk_thresholds: RiskThresholds = RiskThresholds(0.9, 0.8, 0.65, 0.5)
    test_data_detection: str | None = None  # flag, strip or ignore


# The built-in policies.
STRICT = Policy(
    "strict", "Maximum sensitivity — flags all detectable PII, secrets, injection, and test data at low confidence thresholds",
    {"pii": GuardPolicy(True, 0.3, "block"), "secret": GuardPolicy(True, 0.5, "block"), "injection": GuardPolicy(True, 0.5, "block"), "leakage": GuardPolicy(True, 0.5, "block")},
    RiskThresholds(0.9, 0.7, 0.5, 0.3), "flag",
)
MODERATE = Policy(
    "moderate", "Balanced sensitivity — flags high-confidence PII and secrets, redacts rather than blocks",
    {"pii": GuardPolicy(True, 0.5, "redact"), "secret": GuardPolicy(True, 0.7, "redact"), "injection": GuardPolicy(True, 0.6, "block"), "leakage": GuardPolicy(True, 0.6, "block")},
    RiskThresholds(0.9, 0.8, 0.65, 0.5), "flag",
)
BUILTIN = {p.name: p for p in (STRICT, MODERATE)}


def get_policy(ref: str | Policy) -> Policy:
    if isinstance(ref, Policy):
        return ref
    if ref not in BUILTIN:
        raise ValueError(f'Unknown policy "{ref}". Available: {", ".join(BUILTIN)}')
    return BUILTIN[ref]


def _least(a: float | None, b: float | None) -> float | None:
    return min((x for x in (a, b) if x is not None), default=None)


def _types(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    if a and b:
        return tuple(t for t in a if t in b)
    return b if b else a


def _guard(base: GuardPolicy | None, over: GuardPolicy | None) -> GuardPolicy | None:
    if base is None or over is None:
        return over or base
    mode = "block" if "block" in (base.mode, over.mode) else over.mode or base.mode
    enabled = base.enabled if over.enabled is None else over.enabled
    return GuardPolicy(enabled, _least(base.threshold, over.threshold), mode, _types(base.entity_types, over.entity_types), _types(base.secret_types, over.secret_types))


def overlay(base: Policy, over: Policy) -> Policy:
    """The stricter threshold and mode, types in both lists, the overlay's say on what is enabled and on test data."""
    merged = {g: m for g in GUARDS if (m := _guard(base.guards.get(g), over.guards.get(g))) is not None}
    a, b = base.risk_thresholds, over.risk_thresholds
    risk = RiskThresholds(min(a.critical, b.critical), min(a.high, b.high), min(a.medium, b.medium), min(a.low, b.low))
    return Policy(f"{base.name}+{over.name}", f"{base.description} | {over.description}", merged, risk, over.test_data_detection or base.test_data_detection)


def resolve_policy(base: str | Policy, overlays: list[str | Policy] = ()) -> Policy:
    return reduce(lambda p, o: overlay(p, get_policy(o)), overlays, get_policy(base))


def guard_settings(policy: Policy) -> dict[str, dict]:
    """Threshold and mode of each stated guard, absent ones as None; whether it is enabled is decided elsewhere."""
    return {g: {"threshold": p.threshold, "mode": p.mode} for g, p in policy.guards.items()}


def from_row(row) -> Policy:
    """A row of the policies table: nulls are not stated, a null threshold of a risk level never reached."""
    guards = {g: GuardPolicy(c["enabled"], c["threshold"], c["mode"], None if c["entity_types"] is None else tuple(c["entity_types"]), None if c["secret_types"] is None else tuple(c["secret_types"])) for g, c in (row["guards"] or {}).items() if g in GUARDS}
    t = row["risk_thresholds"]
    risk = RiskThresholds(*(float("inf") if t is None or t[k] is None else t[k] for k in ("critical", "high", "medium", "low")))
    return replace(Policy(row["name"], row["description"] or "", guards, risk), test_data_detection=row["test_data_detection"])
