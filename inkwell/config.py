"""Parameters of the pen-process operators."""

from __future__ import annotations

from dataclasses import dataclass


def _number(name: str, value, low: float = 0.0, high: float | None = None, open_low: bool = False) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{name} must be a number")
    if value < low or (open_low and value == low) or (high is not None and value > high):
        raise ValueError(f"{name} is out of range")


@dataclass(frozen=True)
class StrokeConfig:
    """Gaps in time and space (normalised units) that end a stroke, and whether a pen-down after a pen-up does."""

    max_time_gap_ms: int = 1000
    max_spatial_jump_norm: float = 0.15
    use_pen_state: bool = True

    def __post_init__(self):
        _number("max_time_gap_ms", self.max_time_gap_ms)
        _number("max_spatial_jump_norm", self.max_spatial_jump_norm)
        if not isinstance(self.use_pen_state, bool):
            raise ValueError("use_pen_state must be a bool")


@dataclass(frozen=True)
class MappingConfig:
    """Least share of a stroke inside a region, and how near two regions' shares are ambiguous."""

    min_coverage: float = 0.5
    ambiguity_epsilon: float = 0.02

    def __post_init__(self):
        _number("min_coverage", self.min_coverage, 0.0, 1.0, open_low=True)
        _number("ambiguity_epsilon", self.ambiguity_epsilon)


@dataclass(frozen=True)
class EventConfig:
    revision_pause_threshold_ms: int = 3000
    revision_overlap_threshold: float = 0.10
    process_end_timeout_ms: int | None = None

    def __post_init__(self):
        _number("revision_pause_threshold_ms", self.revision_pause_threshold_ms)
        _number("revision_overlap_threshold", self.revision_overlap_threshold, 0.0, 1.0)
        if self.process_end_timeout_ms is not None:
            _number("process_end_timeout_ms", self.process_end_timeout_ms)


@dataclass(frozen=True)
class FeatureConfig:
    inside_pause_threshold_ms: int = 500

    def __post_init__(self):
        _number("inside_pause_threshold_ms", self.inside_pause_threshold_ms)
