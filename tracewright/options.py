"""Run-time options, with the guards the engine applies to them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

# Fixed default values.
STALE_TIMEOUT_MS = 300_000
STALE_SWEEP_MS = 60_000
PART_SIZE_BYTES = 8 * 1024 * 1024


def non_negative(value) -> float | None:
    """The value when it is a finite number of at least zero, else None."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return value if math.isfinite(value) and value >= 0 else None


@dataclass(frozen=True)
class Options:
    """How traces are closed and how rows are labelled.

    ``sweep_ms=None`` closes a stale trace exactly ``stale_timeout_ms`` after its last activity; a
    number closes it at the first sweep tick after that moment, as a periodic sweeper would.
    ``as_of_us`` is the moment the input ends; without it, traces still open end at their last event.
    """

    stale_timeout_ms: int | None = STALE_TIMEOUT_MS
    sweep_ms: int | None = None
    grace_ms: int = 0
    as_of_us: int | None = None
    home: str = "/root"
    app_name: str = "tracewright"
    app_version: str = "1"
    created_from: str = "agent"
    record_kind: str = "SPAN"
    tags: tuple[str, ...] = ("agent",)
    max_group_rows: int = 1_000_000

    def __post_init__(self):
        def clamp(value, default):
            good = non_negative(value)
            return max(1000, int(default if good is None else good))

        if self.stale_timeout_ms is not None:
            object.__setattr__(self, "stale_timeout_ms", clamp(self.stale_timeout_ms, STALE_TIMEOUT_MS))
        if self.sweep_ms is not None:
            object.__setattr__(self, "sweep_ms", clamp(self.sweep_ms, STALE_SWEEP_MS))
        object.__setattr__(self, "grace_ms", math.floor(non_negative(self.grace_ms) or 0))

    def but(self, **changes) -> "Options":
        return replace(self, **changes)
