"""Run many named comparisons; one that fails does not stop the others."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.compare import Comparison, compare
from ..sources.reports import write_reports

_OPTIONS = {
    n for n, p in inspect.signature(compare).parameters.items() if n not in ("left", "right")
}
_OWN = {"name", "enabled", "description", "left", "right", "output", "full"}


@dataclass
class Outcome:
    name: str
    success: bool
    error: str | None = None
    written: dict[str, str] = field(default_factory=dict)


def run_scenarios(
    spark: SparkSession, scenarios: Sequence[Mapping[str, Any]], *, read: Callable[[Any], DataFrame],
    defaults: Mapping[str, Any] | None = None, base_path: str | None = None,
    action: Callable[[str, Comparison], dict[str, str] | None] | None = None,
    fmt: str = "parquet",
) -> tuple[list[Outcome], DataFrame]:
    """Run every enabled scenario and report its outcome.

    A scenario names its `left` and `right` table (handed to `read`), and any option of
    `compare`; `defaults` fill in what it leaves out. Unknown keys are an error of the
    scenario. `action` consumes the comparison; by default its reports are written to
    `base_path`/`output`, where `output` falls back to the name. The second result is
    the outcome table: name, success, error.
    """
    outcomes: list[Outcome] = []
    for number, scenario in enumerate(scenarios, 1):
        if not scenario.get("enabled", True):
            continue
        name = scenario.get("name", f"scenario {number}")
        try:
            settings = {**(defaults or {}), **scenario}
            unknown = sorted(set(settings) - _OWN - _OPTIONS)
            if unknown:
                raise ValueError(f"unknown settings: {unknown}")
            options = {k: v for k, v in settings.items() if k in _OPTIONS}
            cmp = compare(read(settings["left"]), read(settings["right"]), **options)
            if action is not None:
                written = action(name, cmp) or {}
            elif base_path is not None:
                target = f"{base_path.rstrip('/')}/{settings.get('output', name)}"
                written = write_reports(cmp, target, full=settings.get("full", False), fmt=fmt)
            else:
                raise ValueError("give base_path or action")
            outcomes.append(Outcome(name, True, written=written))
        except Exception as e:  # a failing scenario is reported, not raised
            outcomes.append(Outcome(name, False, f"{type(e).__name__}: {e}"))
    rows = [(o.name, o.success, o.error) for o in outcomes]
    return outcomes, spark.createDataFrame(rows, "name string, success boolean, error string")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.selectExpr(
        "count_if(success) as succeeded", "count_if(not success) as failed"
    )
