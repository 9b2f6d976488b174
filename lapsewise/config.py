"""Every tunable that changes a result, in one frozen object passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Params:
    # Churn and observation window.
    grace_days: int = 30
    window_open: date = date(2015, 1, 1)
    observation_cutoff: date = date(2017, 2, 28)
    epoch_sentinel: date = date(1970, 1, 1)

    # Survival fits: a group below this many observed events gets no curve.
    min_events: int = 100
    km_horizons: tuple[int, ...] = (30, 60, 90, 180, 365, 545, 730)
    confidence_z: float = 1.959963984540054  # two-sided 95%
    sensitivity_channel: int = 3
    material_pp: float = 1.0

    # Lifetime value and reactivation.
    ltv_horizons: tuple[int, ...] = (365, 730)
    reactivation_windows: tuple[int, ...] = (90, 180, 365)
    min_reliable_churners: int = 100

    # Backtest. The fit date belongs to the backtest only.
    fit_window_end: date = date(2016, 12, 31)
    min_followup_days: int = 365
    secondary_followup_days: int = 180
    min_cell_events: int = 100
    correlation_threshold: float = 0.3

    # Validation bounds.
    min_censoring: float = 0.01
    max_censoring: float = 0.99
    max_price_mismatch: float = 0.10

    @property
    def label_cutoff(self) -> date:
        """Last day on which a churn event can still be determined."""
        return self.observation_cutoff - timedelta(days=self.grace_days)

    @property
    def backtest_horizons(self) -> tuple[int, ...]:
        return (self.min_followup_days, self.secondary_followup_days)


DEFAULT = Params()

# Settings for the subscription view derived from the warehouse tables: a window that
# holds all of their dates, and small cohort cells.
WAREHOUSE = Params(
    window_open=date(1995, 1, 1),
    observation_cutoff=date(2001, 12, 31),
    fit_window_end=date(2000, 6, 30),
    min_cell_events=20,
)
