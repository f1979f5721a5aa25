"""Orders of steps: what must stand before what, checked before any plan is built."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from .errors import ConfigurationError


class StepType(Enum):
    IMPUTATION = "imputation"
    OUTLIER_DETECTION = "outlier"
    TRANSFORMATION = "transformation"
    STANDARDIZATION = "standardization"
    NEUTRALIZATION = "neutralization"

    @classmethod
    def parse(cls, text: str) -> StepType:
        known = [t.value for t in cls]
        if text not in known:
            raise ConfigurationError(f"invalid step type {text!r}, valid are {known}")
        return cls(text)


I, O, T, S, N = StepType

# The orders that strict mode knows, and what each step needs before it.
STANDARD_ORDERS = ((I, O, T, S, N), (I, O, S, N), (I, O, N), (I, S, N))
NEEDS = {O: (I,), T: (I, O), S: (I, O), N: (I,)}
#: v2 pipelines neutralize before they standardize; they are checked against their own order.
V2_ORDER = (I, O, T, N, S)

WHY = {
    (O, I): "thresholds from incomplete data are biased",
    (T, I): "transformation parameters need complete data",
    (T, O): "extreme values distort transformation parameters",
    (S, I): "means and deviations need complete data",
    (S, O): "extreme values move means and deviations",
    (N, I): "regressions on incomplete data are biased",
}
ANY_REASON = "this order keeps the statistics sound"


def is_subsequence(part: Sequence, whole: Sequence) -> bool:
    at = 0
    for x in whole:
        at += at < len(part) and part[at] == x
    return at == len(part)


def reason(step: StepType, needed: StepType) -> str:
    return WHY.get((step, needed), ANY_REASON)


def check_order(steps: Sequence[StepType], strict: bool = True, exclusions: Sequence[tuple[StepType, StepType]] = (), orders=STANDARD_ORDERS) -> list[str]:
    """What is wrong with an order; nothing, if it is valid.

    Imputation, where present, comes first; the first occurrence of each need
    stands before the step; excluded neighbours don't follow each other; strict mode
    also wants an ordered part of a standard order, if nothing else is wrong.
    """
    steps = list(steps)
    if not steps:
        return ["there are no steps"]
    first = {t: steps.index(t) for t in set(steps)}
    wrong = []
    if first.get(I):
        wrong.append(f"imputation must come first, not {steps[0].value}: {reason(O, I)}")
    wrong += [f"{t.value} must follow {need.value}: {reason(t, need)}" for k, t in enumerate(steps) for need in NEEDS.get(t, ()) if first.get(need, -1) > k]
    wrong += [f"{b.value} must not follow {a.value} directly" for a, b in zip(steps, steps[1:]) if (a, b) in set(exclusions)]
    if strict and not wrong and not any(is_subsequence(steps, o) for o in orders):
        wrong.append(f"{' > '.join(t.value for t in steps)} is part of no standard order")
    return wrong


def suggest_order(steps: Sequence[StepType]) -> list[StepType]:
    """The steps by their place in the full order; equal ones keep their order."""
    place = {t: k for k, t in enumerate(STANDARD_ORDERS[0])}
    return sorted(steps, key=lambda t: place.get(t, len(place)))
