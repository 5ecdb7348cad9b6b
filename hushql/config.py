"""Settings of the anonymizer and their rules."""

from __future__ import annotations

from dataclasses import dataclass, fields
from enum import IntEnum


class HushError(ValueError):
    """A query or setting that anonymized access doesn't allow."""


class AccessLevel(IntEnum):
    ANONYMIZED_UNTRUSTED = 0
    ANONYMIZED_TRUSTED = 1
    DIRECT = 2

    @property
    def label(self) -> str:
        return self.name.lower()

    @staticmethod
    def of(value: str | AccessLevel) -> AccessLevel:
        return value if isinstance(value, AccessLevel) else AccessLevel[value.upper()]


#: name: (least, most, least in strict mode)
RANGES = {
    "noise_layer_sd": (0.0, 1000.0, 1.0), "low_count_min_threshold": (1, 1000, 2), "low_count_mean_gap": (0.0, 1000.0, 2.0), "low_count_layer_sd": (0.0, 1000.0, 1.0),
    "outlier_count_min": (0, 1000, 1), "outlier_count_max": (0, 1000, 2), "top_count_min": (1, 1000, 2), "top_count_max": (1, 1000, 3),
}
#: Settings that an analyst may change, within the role's own access level.
OPEN = {"session_access_level", "compute_suppress_bin", "text_label_for_suppress_bin"}


@dataclass
class Config:
    session_access_level: str = "direct"
    default_access_level: str = "direct"
    treat_unmarked_tables_as_public: bool = False
    strict: bool = True
    salt: str = ""  # empty: the catalog's
    noise_layer_sd: float = 1.0
    low_count_min_threshold: int = 3
    low_count_mean_gap: float = 2.0
    low_count_layer_sd: float = 1.0
    outlier_count_min: int = 1
    outlier_count_max: int = 2
    top_count_min: int = 3
    top_count_max: int = 4
    compute_suppress_bin: bool = True
    text_label_for_suppress_bin: str = "*"

    def set(self, name: str, value) -> None:
        """Set one value; its range, and the strict minimum while strict, must hold."""
        if name not in {f.name for f in fields(self)}:
            raise HushError(f"Unknown setting '{name}'.")
        if name in ("session_access_level", "default_access_level"):
            value = AccessLevel.of(value).label
        if name in RANGES:
            self._check_range(name, value, self.strict)
        if name == "strict" and value:
            for other in RANGES:
                self._check_range(other, getattr(self, other), True)
            self._check_intervals(True)
        setattr(self, name, value)

    @staticmethod
    def _check_range(name: str, value, strict: bool) -> None:
        low, high, safe = RANGES[name]
        if not low <= value <= high:
            raise HushError(f"{value} is outside the valid range for parameter '{name}' ({low} .. {high}).")
        if strict and value < safe:
            raise HushError(f"Value of '{name}' is below the strict minimum {safe}; set strict to false first.")

    def _check_intervals(self, strict: bool) -> None:
        for kind in ("outlier_count", "top_count"):
            low, high = getattr(self, f"{kind}_min"), getattr(self, f"{kind}_max")
            if low > high:
                raise HushError(f"{kind}_min can't be larger than {kind}_max.")
            if strict and high - low < 1:
                raise HushError(f"{kind} interval must have a size of at least 1 in strict mode.")

    def validate(self) -> None:
        """What must hold whenever a query is anonymized."""
        self._check_intervals(self.strict)

    @property
    def exact(self) -> bool:
        """No result depends on a seed: no noise and fixed outlier and top counts."""
        return not self.noise_layer_sd and not self.low_count_layer_sd and self.outlier_count_min == self.outlier_count_max and self.top_count_min == self.top_count_max
