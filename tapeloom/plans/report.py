"""The alpha report: strongest features, their decay, spreads, turnover and overlaps."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..operators import alpha
from ..sources.mirror import Manifest

REDUNDANT, SUSPECT = 0.85, 0.15


def table(columns: list[str], rows: list[tuple]) -> str:
    """A Markdown table, numbers with four decimals."""

    def cell(value: object) -> str:
        return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)

    lines = [columns, ["---"] * len(columns), *([cell(v) for v in row] for row in rows)]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def _rows(df: DataFrame, columns: list[str]) -> list[tuple]:
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def build(joined: DataFrame, manifest: Manifest, features: list[str], horizon: int = 5, horizons: tuple[int, ...] = (1, 5, 10, 21), top: int = 10, now: datetime | None = None) -> str:
    """Markdown of the report; each section collects a few rows a feature."""
    columns = ["feature", "days", "mean_ic", "sd_ic", "ir", "t_stat", "hit_rate"]
    ics = _rows(alpha.ic_table(joined, features, horizon), columns)
    best = [r[0] for r in ics[:top]]
    out = [
        f"# Alpha report, {horizon} sessions",
        f"- snapshot: `{manifest.as_of}`, adjustment epochs {manifest.adjustment_epochs}, {sum(manifest.row_counts.values()):,} rows",
        f"- made: {(now or datetime.now(UTC)).isoformat(timespec='seconds')}",
        "## Information coefficients\n\nDaily correlation of a feature's rank with the rank of the forward return; `ir` is mean over deviation.",
        table(columns, ics[: 2 * top]),
    ]
    if best:
        fades = ["feature", *(f"{n}_{h}" for h in horizons for n in ("ic", "ir"))]
        by_name = {r[0]: r for r in _rows(alpha.ic_decay(joined, best, horizons), fades)}
        out += ["## Decay by horizon", table(fades, [by_name[f] for f in best if f in by_name])]
        spreads = []
        for f in best:
            s = alpha.spread_summary(alpha.spread(joined, f, horizon), f).first()
            spreads.append((f, s["spread_pct"], s["monotonic"], s["top_pct"], s["bottom_pct"], alpha.turnover(joined, f, step=horizon).first()["turnover"]))
        out += ["## Spread of the outer buckets, percent a period, and turnover of the top", table(["feature", "spread_pct", "monotonic", "top_pct", "bottom_pct", "turnover"], spreads)]
        pairs = [p for p in _rows(alpha.correlations(joined, best), ["a", "b", "corr"]) if p[2] is not None and abs(p[2]) > REDUNDANT] if len(best) > 1 else []
        if pairs:
            out += [f"## Pairs with a correlation beyond {REDUNDANT}", table(["a", "b", "corr"], pairs)]
    suspects = [r[0] for r in ics if abs(r[2]) > SUSPECT]
    said = "\n".join(f"- `{f}`" for f in suspects) or f"No feature has a mean coefficient beyond {SUSPECT}."
    out += [f"## Suspected leaks\n\nA mean coefficient beyond {SUSPECT} in daily data usually means that a feature saw the future.", said]
    return "\n\n".join(out) + "\n"
