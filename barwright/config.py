"""Parameters of the analytics, frozen, with the effective defaults.

The numbers below are fixed values: they must equal the surveyed system's
effective settings for results to match (RSI 14, MA 20/50, MACD 12/26/9,
thresholds 30/70, Bollinger 20 and 2 sigma, volume average 20, ATR 14,
stochastic 14/3, stop-loss 2 %, take-profit 4 %, capital 100000,
commission 0.1 %, slippage 0.1 %, 95 % of cash per entry, train fraction 0.8,
lags 1..5, minimum 100 raw / 50 clean rows for ML).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
PRICE_SCALE = 100  # prices carry two decimals; exact sums run on integer cents


@dataclass(frozen=True)
class IndicatorParams:
    rsi_period: int = 14
    ma_short: int = 20
    ma_long: int = 50
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    bb_period: int = 20
    bb_std: int = 2
    volume_period: int = 20
    atr_period: int = 14
    stoch_k: int = 14
    stoch_d: int = 3


@dataclass(frozen=True)
class StrategyParams:
    rsi_oversold: int = 30
    rsi_overbought: int = 70
    stop_loss_pct: float = 0.02
    take_profit_pct: float = 0.04
    volume_spike_factor: float = 1.5
    volume_window: int = 20
    confirm_bonus: float = 0.1
    min_strength: float = 0.3
    risk_pct: float = 0.02


@dataclass(frozen=True)
class BacktestParams:
    initial_capital: float = 100000.0
    commission: float = 0.001
    slippage: float = 0.001
    cash_fraction: float = 0.95
    trading_days: int = 252


@dataclass(frozen=True)
class MLParams:
    model_type: str = "logistic_regression"
    train_fraction: float = 0.8
    max_lag: int = 5
    min_raw_rows: int = 100
    min_clean_rows: int = 50
    min_test_rows: int = 5
    small_test_fraction: float = 0.3
    seed: int = 42
    l2: float = 1.0  # inverse of C = 1.0
    max_iter: int = 1000
    max_fit_rows: int = 200_000  # rows of one symbol that a fit reads; beyond it a hashed sample
    tree_depth: int = 10
    tree_min_leaf: int = 10
    tree_min_split: int = 20
    forest_trees: int = 100


@dataclass(frozen=True)
class Params:
    indicators: IndicatorParams = field(default_factory=IndicatorParams)
    strategy: StrategyParams = field(default_factory=StrategyParams)
    backtest: BacktestParams = field(default_factory=BacktestParams)
    ml: MLParams = field(default_factory=MLParams)


DEFAULT = Params()
