"""Fixed values of the analytics, and the configuration objects built from them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Conventions that results depend on.
TRADING_DAYS = 252
RISK_FREE_ANNUAL = 0.065
COST_BPS = 15.0
TRAIN_MONTHS = 36
HOLD_MONTHS = 3
MIN_HISTORY_DAYS = 500
MAX_MISSING_FRAC = 0.05
MAX_STALE_FRAC = 0.20
EXTREME_RETURN = 0.50
FFILL_LIMIT = 5
SEED = 42
HORIZON = 21
EWMA_LAMBDA = 0.94


@dataclass(frozen=True)
class RiskProfile:
    """Weight cap, least number of names and metric weights of a risk appetite."""

    name: str
    max_weight: float
    min_positions: int
    weights: dict[str, float] = field(default_factory=dict)


# The three profiles.
PROFILES = {
    "conservative": RiskProfile("conservative", 0.10, 15, {"sharpe": 0.25, "volatility": -0.35, "beta": -0.20, "var_95": -0.20}),
    "balanced": RiskProfile("balanced", 0.15, 12, {"sharpe": 0.40, "volatility": -0.20, "beta": -0.10, "mean_return": 0.30}),
    "aggressive": RiskProfile("aggressive", 0.20, 8, {"sharpe": 0.30, "mean_return": 0.50, "volatility": -0.05, "beta": 0.15}),
}


def daily_rate(annual: float = RISK_FREE_ANNUAL, days: int = TRADING_DAYS) -> float:
    """The daily rate that compounds to ``annual`` over a year of trading days."""
    return (1.0 + annual) ** (1.0 / days) - 1.0
