"""Checks of hyper-parameters."""

from __future__ import annotations

from collections.abc import Sequence


def check_range(
    name: str, value: float, low: float, high: float, *, open_low: bool = False, open_high: bool = False
) -> None:
    """Raise ValueError unless ``value`` lies in the interval."""
    above = value > low if open_low else value >= low
    below = value < high if open_high else value <= high
    if not (above and below):
        span = f"{'(' if open_low else '['}{low}, {high}{')' if open_high else ']'}"
        raise ValueError(f"{name}={value} is outside {span}")


def check_choice(name: str, value: str, choices: Sequence[str]) -> None:
    """Raise ValueError unless ``value`` is one of ``choices``."""
    if value not in choices:
        raise ValueError(f"{name}={value!r} is not one of {tuple(choices)}")
