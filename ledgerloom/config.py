"""Settings of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Weights:
    """Shares of the description scores in the combined one; they need not sum to one."""

    jaro_winkler: float = 0.4
    token_sort: float = 0.3
    token_containment: float = 0.3


@dataclass(frozen=True)
class MatchConfig:
    """How two ledgers are matched. currency and fx_rate are reported only; polarity never changes a match, which compares absolute amounts."""

    date_tolerance_days: int = 3
    amount_tolerance_mode: str = "both"  # percent, fixed, or both: either suffices
    amount_tolerance_percent: float = 0.001
    amount_tolerance_fixed: float = 0.05
    description_threshold: float = 0.82
    description_weight: Weights = field(default_factory=Weights)
    polarity_mode: str = "opposite_sign"
    enabled_passes: tuple[int, ...] = (1, 2, 3, 4, 5)
    split_max_entries: int = 5
    split_pool: int = 20
    split_node_budget: int = 1_000_000
    currency: str = "USD"
    fx_rate: float | None = None
    ignore_reference_in_exact: bool = False
    case_sensitive_ref: bool = False

    def __post_init__(self) -> None:
        if self.amount_tolerance_mode not in ("percent", "fixed", "both"):
            raise ValueError(f"amount_tolerance_mode {self.amount_tolerance_mode}")
        if self.polarity_mode not in ("absolute", "opposite_sign", "same_sign", "auto_detect"):
            raise ValueError(f"polarity_mode {self.polarity_mode}")
        if not 0 <= self.amount_tolerance_percent < 1 or self.amount_tolerance_fixed < 0 or self.date_tolerance_days < 0:
            raise ValueError("tolerances are not negative, and a percentage is below 1")
        if not 2 <= self.split_max_entries <= 8:
            raise ValueError("a split has 2 to 8 entries")

    @property
    def percent(self) -> float:
        """The percentage that counts in this mode."""
        return 0.0 if self.amount_tolerance_mode == "fixed" else self.amount_tolerance_percent

    @property
    def fixed(self) -> float:
        """The fixed tolerance that counts in this mode."""
        return 0.0 if self.amount_tolerance_mode == "percent" else self.amount_tolerance_fixed

    def with_(self, **changes) -> MatchConfig:
        """These settings with some changed."""
        return replace(self, **changes)

    def toggle_pass(self, number: int) -> MatchConfig:
        """With a pass switched on or off."""
        on = set(self.enabled_passes) ^ {number}
        return replace(self, enabled_passes=tuple(sorted(on)))
