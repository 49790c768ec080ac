"""Options of a log, their defaults and presets."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from .functions.scalar import TICKS
from .operators.adaptive import Adaptive

MAINTENANCE, BUSY = ("background", "disabled"), ("raise", "silent", "flush")
GROUPS = {"adaptive": {f.name for f in fields(Adaptive)}, "compaction": {"target_bytes", "max_inputs", "max_windows"}}
#: Accepted because callers pass them; they steer buffers and threads that a Spark engine has no use for.
WITHOUT_EFFECT = {"ooo_budget_bytes", "sealed_max_runs", "sealed_wait_ms", "maintenance_wakeup_ms", "drain_batch_limit", "target_page_bytes", "busy_policy"}


@dataclass(frozen=True)
class Config:
    time_unit: str = "ms"
    maintenance: str = "background"
    busy_policy: str = "raise"
    memtable_max_bytes: int = 1 << 20
    target_page_bytes: int = 64 << 10
    ooo_budget_bytes: int = 0
    sealed_max_runs: int = 4
    sealed_wait_ms: int = 100
    maintenance_wakeup_ms: int = 100
    max_delta_segments: int = 8
    window_size: int = 0
    window_origin: int = 0
    delete_debt_threshold: float = 0.0
    drain_batch_limit: int = 0
    compaction_target_bytes: int = 0
    compaction_max_inputs: int = 0
    compaction_max_windows: int = 0
    adaptive: Adaptive = field(default_factory=Adaptive)

    def __post_init__(self) -> None:
        if self.time_unit not in TICKS:
            raise ValueError(f"time_unit must be one of {', '.join(TICKS)}")
        if self.maintenance not in MAINTENANCE or self.busy_policy not in BUSY:
            raise ValueError("maintenance or busy_policy has no such value")
        if not 0 <= self.delete_debt_threshold <= 1:
            raise ValueError("delete_debt_threshold must be from 0 to 1")
        if 0 < self.target_page_bytes < 256:
            raise ValueError("target_page_bytes must be at least 256")
        if self.window_size < 0 or min(self.compaction_target_bytes, self.compaction_max_inputs, self.compaction_max_windows) < 0:
            raise ValueError("sizes must not be negative")

    @property
    def window(self) -> int:
        """Of the grid: as given, else an hour."""
        return self.window_size or 3600 * TICKS[self.time_unit]

    @property
    def buffer_rows(self) -> int:
        """Rows that wait in the driver before a file is written: 16 bytes each count."""
        return max(1, (self.memtable_max_bytes or 1 << 20) // 16)


def configured(options: dict) -> Config:
    """From keywords. Grouped options come as a dict (adaptive={...}) or flat (adaptive_alpha=...), not both at once."""
    known, out = {f.name for f in fields(Config)}, dict(options)
    for group, names in GROUPS.items():
        nested = out.pop(group, None)
        if nested is not None and not isinstance(nested, (dict, Adaptive)):
            raise TypeError(f"{group} must be a dict")
        flat = {n: out.pop(f"{group}_{n}") for n in names if f"{group}_{n}" in out}
        values = dict(nested) if isinstance(nested, dict) else {}
        if unknown := set(values) - names:
            raise ValueError(f"{group} has no option {', '.join(sorted(unknown))}")
        if both := set(values) & set(flat):
            raise ValueError(f"given twice: {', '.join(sorted(both))}")
        values |= flat
        if group == "adaptive":
            out["adaptive"] = nested if isinstance(nested, Adaptive) else Adaptive(**values)
        else:
            out |= {f"{group}_{k}": v for k, v in values.items()}
    if unknown := set(out) - known:
        raise TypeError(f"unknown option: {', '.join(sorted(unknown))}")
    return Config(**out)


# What each preset sets.
PRESETS = {
    "streaming": {"maintenance": "background", "busy_policy": "flush"},
    "bulk_ingest": {"maintenance": "disabled", "busy_policy": "flush", "memtable_max_bytes": 16 << 20},
    "low_latency": {"maintenance": "background", "busy_policy": "raise", "memtable_max_bytes": 256 << 10, "sealed_wait_ms": 0},
}
