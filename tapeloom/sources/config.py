"""Settings from YAML files; environment variables win for the database address."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, dict[str, Any]] = {
    "data": {
        "dsn": "jdbc:postgresql://localhost:5432/market",
        "mirror_dir": "data/mirror",
        "tables": ["daily_prices", "symbols", "index_series", "trading_calendar", "corporate_actions", "market_snapshot", "company_snapshot", "index_membership"],
        "index_code": "VNINDEX",
    },
    "features": {
        "universe": {"adtv_window": 20, "adtv_min": 1e9, "require_full_window": True},
        "label": {"horizon": 5, "horizons": [1, 5, 10, 21], "entry_price": "open"},
    },
    "model": {"dataset": {"start_date": "2010-01-01"}, "cv": {"n_splits": 6, "embargo": 5, "min_train_days": 750}},
    "backtest": {
        "portfolio": {"top_n": 30, "rebalance_every": 5, "init_cash": 1e9, "max_adtv_frac": 0.10},
        "costs": {"brokerage": 0.0015, "sell_tax": 0.0010, "slippage": 0.0010},
        "benchmark": "VNINDEX",
    },
}


def root() -> Path:
    return Path(os.environ.get("TAPELOOM_HOME", "."))


def path(relative: str) -> Path:
    return root() / relative


def load(name: str) -> dict[str, Any]:
    """Settings ``name``: the defaults, overlaid with config/<name>.yaml where there is one."""
    if name not in DEFAULTS:
        raise KeyError(f"no settings called {name}")
    out = _copy(DEFAULTS[name])
    file = path(f"config/{name}.yaml")
    if file.exists():
        import yaml

        _overlay(out, yaml.safe_load(file.read_text()) or {})
    return out


def dsn() -> str:
    return os.environ.get("DATABASE_URL") or load("data")["dsn"]


def _copy(value: Any) -> Any:
    return {k: _copy(v) for k, v in value.items()} if isinstance(value, dict) else list(value) if isinstance(value, list) else value


def _overlay(base: dict, more: dict) -> None:
    for k, v in more.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            _overlay(base[k], v)
        else:
            base[k] = v
