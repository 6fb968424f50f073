"""What to assess: columns, keys, selection, dimensions and their parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.accuracy import AccuracyTarget
from ..operators.consistency import Rule, rule_set
from ..operators.selection import check_fraction
from ..operators.timeliness import DEFAULT_VOLATILITY_HOURS, TimeColumn

# Dimension names and granularities.
DIMENSIONS = (
    "Volume",
    "Precision",
    "Accuracy",
    "Completeness_Missing",
    "Distinctness",
    "Timeliness",
    "Completeness_Frequency",
    "Completeness_Population",
    "Consistency",
)
GRANULARITIES = ("global", "attribute", "value", "tuple")


@dataclass(frozen=True)
class AssessmentConfig:
    """Configuration of one assessment; everything is validated before any job runs.

    ``granularity`` maps a dimension to granularities; blank or absent means global.
    "Consistency-R" among the dimensions forces the per-row consistency refresh.
    ``timestamps`` maps a timestamp column to its strptime format (None when typed).
    ``large_keys`` declares keys (or rule sides) with more values than a map task can
    combine; each gets a scan of its own, which changes the plan and not the result.
    """

    columns: Sequence[str]
    keys: Sequence[Sequence[str]] = ()
    dimensions: Sequence[str] = DIMENSIONS
    granularity: Mapping[str, Sequence[str]] = field(default_factory=dict)
    intervals: Mapping[str, Sequence[tuple]] = field(default_factory=dict)
    compare: str | Mapping[str, str] = "string"
    values: Mapping[str, Sequence | DataFrame] = field(default_factory=dict)
    expected_mean: Mapping[str, float] = field(default_factory=dict)
    interval_width: Mapping[str, float] = field(default_factory=dict)
    numeric_columns: Sequence[str] | None = None
    timestamps: Mapping[str, str | None] = field(default_factory=dict)
    volatility_hours: Mapping[str, float] = field(default_factory=dict)
    default_volatility_hours: float | None = None
    rules: Sequence = ()
    allow_list_names: Sequence[str] = ()
    refreshed_allow_list_names: Sequence[str] | None = None
    force_consistency: bool = False
    sample_fraction: float = 1.0
    sample_seed: int = 42
    sample_key: str | None = None
    on_invalid: str = "fail"
    large_keys: Sequence[Sequence[str]] = ()

    def __post_init__(self):
        known = set(self.columns)
        if not self.columns or len(known) != len(self.columns):
            raise ValueError("columns must be a non-empty list without repeats")
        for what, names in (
            ("key", [name for key in self.keys for name in key]),
            ("large key", [name for key in self.large_keys for name in key]),
            ("interval", self.intervals),
            ("value list", self.values),
            ("accuracy", [*self.expected_mean, *self.interval_width]),
            ("precision", self.numeric_columns or ()),
            ("rule", [name for x, y in self.rule_list() for name in x + y]),
            ("sample", [self.sample_key] if self.sample_key else ()),
        ):
            unknown = sorted(set(names) - known)
            if unknown:
                raise ValueError(f"{what} columns {unknown} are not among the assessed columns")
        if any(len(key) == 0 for key in self.keys):
            raise ValueError("a key needs at least one column")
        if set(self.expected_mean) != set(self.interval_width):
            raise ValueError("accuracy needs an expected mean and an interval width per column")
        for name in self.dimensions:
            if name not in DIMENSIONS and name != "Consistency-R":
                raise ValueError(f"unknown dimension {name!r}")
        for name, levels in self.granularity.items():
            if name not in DIMENSIONS:
                raise ValueError(f"granularity of unknown dimension {name!r}")
            unknown = set(levels) - set(GRANULARITIES) - {""}
            if unknown:
                raise ValueError(f"unknown granularities {sorted(unknown)} of {name}")
        check_fraction(self.sample_fraction)
        self.accuracy_targets(), self.time_columns()

    def requested(self, dimension: str) -> bool:
        names = {"Consistency" if d == "Consistency-R" else d for d in self.dimensions}
        return dimension in names

    def levels(self, dimension: str) -> set[str]:
        """Granularities of a requested dimension; blank or absent means global."""
        if not self.requested(dimension):
            return set()
        return {level for level in self.granularity.get(dimension, ()) if level} or {"global"}

    def wants(self, dimension: str, level: str) -> bool:
        return level in self.levels(dimension)

    def accuracy_targets(self) -> list[AccuracyTarget]:
        return [
            AccuracyTarget(c, float(self.expected_mean[c]), float(self.interval_width[c]))
            for c in self.columns
            if c in self.expected_mean
        ]

    def precision_columns(self) -> list[str]:
        if self.numeric_columns is not None:
            return list(self.numeric_columns)
        return [c for c in self.columns if c in self.expected_mean]

    def time_columns(self) -> list[TimeColumn]:
        """Timestamp columns among the assessed ones; a blank volatility takes the default."""
        return [
            TimeColumn(c, float(self.volatility_hours.get(c) or self.default_volatility_hours or DEFAULT_VOLATILITY_HOURS), self.timestamps[c])
            for c in self.columns
            if c in self.timestamps
        ]

    def rule_list(self, stored: Sequence = ()) -> list[Rule]:
        return rule_set(self.rules, stored)

    def refresh_consistency(self) -> bool:
        """Per-row consistency is recomputed when the lists changed or on request."""
        if self.force_consistency or "Consistency-R" in self.dimensions:
            return True
        known = self.refreshed_allow_list_names
        return known is None or set(known) != set(self.allow_list_names)
