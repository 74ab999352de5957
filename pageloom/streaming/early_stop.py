"""Early stopping and best-model selection as ordered folds over the validations of a run."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.ordering import fold


@dataclass(frozen=True)
class Rule:
    higher_is_better: bool = True
    patience: int = 10
    min_delta: float = 0.01
    window: int = 5
    warmup: int = 5
    spike: float = 0.5
    spikes: int = 3


@dataclass
class Progress:
    """What a run carries from one validation to the next; only the last ``window`` values are kept."""

    tail: list[float] = field(default_factory=list)
    best: float | None = None
    waited: int = 0
    spiked: int = 0
    seen: int = 0

    @classmethod
    def restored(cls, d: dict) -> Progress:
        return cls(list(d.get("tail", [])), d.get("best"), int(d.get("waited", 0)), int(d.get("spiked", 0)), int(d.get("seen", 0)))

    def saved(self) -> dict:
        return asdict(self)


def smoothed(tail: list[float]) -> float:
    alpha, out = 2.0 / (len(tail) + 1), tail[0]
    for v in tail[1:]:
        out += alpha * (v - out)
    return out


def decide(p: Progress, value: float, rule: Rule) -> str | None:
    """Takes one more validation; the reason to stop, or None. Nothing stops within the warm-up."""
    sign = 1.0 if rule.higher_is_better else -1.0
    p.tail = [*p.tail, value][-rule.window :]
    p.seen += 1
    now = smoothed(p.tail)
    if p.best is None or sign * (now - p.best) > rule.min_delta:
        p.best, p.waited = now, 0
    else:
        p.waited += 1
    p.spiked = p.spiked + 1 if sign * (p.best - value) > rule.spike else 0
    if p.seen <= rule.warmup:
        return None
    return "patience_exceeded" if p.waited >= rule.patience else "spike_detected" if p.spiked >= rule.spikes else None


SCHEMA = "run string, step long, value double, smoothed double, best double, waited int, spiked int, reason string"


def decisions(history: DataFrame, rule: Rule = Rule(), run: str = "run", step: str = "step", value: str = "value", saved: dict[str, dict] | None = None) -> DataFrame:
    """One row per validation with the state after it and the reason to stop there, if any.

    A value that isn't a number is a validation without improvement; rows where run, step or value is null are none. ``saved`` has
    the states of runs that go on from earlier validations.
    """
    rows = history.selectExpr(f"cast({run} as string) as run", f"cast({step} as long) as step", f"cast({value} as double) as value")
    rows = rows.filter("run is not null and step is not null and value is not null")

    def begin(run: str) -> Progress:
        return Progress.restored((saved or {}).get(run, {}))

    def one(p: Progress, row: dict) -> tuple[Progress, dict]:
        reason = decide(p, float(row["value"]), rule)
        return p, {"run": row["run"], "step": row["step"], "value": row["value"], "smoothed": smoothed(p.tail), "best": p.best, "waited": p.waited, "spiked": p.spiked, "reason": reason}

    return fold(rows, "run", ["step"], SCHEMA, one, begin)


SELECTED = "run string, step long, gate double, truth double, passed boolean, accepted boolean, best double"


def selections(history: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """history(run, step, gate, truth): a cheap gate that beats the best asks for the truth; only a better truth becomes the best."""
    sign = 1.0 if higher_is_better else -1.0

    def one(state: dict, row: dict) -> tuple[dict, dict]:
        best = state.get("best")
        passed = best is None or sign * (row["gate"] - best) > 0
        accepted = bool(passed and not pd.isna(row["truth"]) and (best is None or sign * (row["truth"] - best) > 0))
        best = float(row["truth"]) if accepted else best
        return {"best": best}, {"run": row["run"], "step": row["step"], "gate": row["gate"], "truth": row["truth"], "passed": bool(passed), "accepted": accepted, "best": best}

    return fold(history.selectExpr("cast(run as string) as run", "cast(step as long) as step", "cast(gate as double) as gate", "cast(truth as double) as truth"), "run", ["step"], SELECTED, one, lambda _: {})
