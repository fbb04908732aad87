"""Parameters of the operators; each checks its own ranges."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Hysteresis:
    """Onset/offset thresholds with optional padding (microseconds) around every region.

    ``min_off_us`` closes gaps up to that length, ``min_on_us`` then drops shorter regions; ``hysteresis`` itself does
    neither, ``speech_regions`` does both.
    """

    onset: float = 0.5
    offset: float | None = None
    pad_onset: int = 0
    pad_offset: int = 0
    min_on_us: int = 0
    min_off_us: int = 0

    def __post_init__(self) -> None:
        if self.offset is not None and self.offset > self.onset:
            raise ValueError("offset must not exceed onset")
        if self.min_on_us < 0 or self.min_off_us < 0:
            raise ValueError("minimum durations must not be negative")

    @property
    def low(self) -> float:
        return self.onset if self.offset is None else self.offset


@dataclass(frozen=True)
class CueLimits:
    """Cue layout; a cue follows its segment unless both limits are given."""

    max_line_width: int | None = None
    max_line_count: int | None = None
    long_pause_ms: int = 3000

    def __post_init__(self) -> None:
        for name in ("max_line_width", "max_line_count"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive")

    @property
    def by_segment(self) -> bool:
        return self.max_line_width is None or self.max_line_count is None

    @property
    def width(self) -> int:
        return 1000 if self.max_line_width is None else self.max_line_width


@dataclass(frozen=True)
class SplitLimits:
    """Line length limits of the linguistic subtitle splitter (general, and for complex scripts)."""

    max_line: int = 45
    min_chars: int = 30
    complex_max_line: int = 30
    complex_min_chars: int = 20


@dataclass(frozen=True)
class QualityLimits:
    compression_ratio: float = 2.4
    avg_logprob: float = -1.0
    no_speech: float = 0.6
