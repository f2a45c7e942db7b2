"""Named planners and detectors that callers may add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from hushpage.operators.detect import dom_detections, password_detections
from hushpage.operators.planning import plan_actions

Planner = Callable[[DataFrame, DataFrame], DataFrame]
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"dom": dom_detections, "password": password_detections}
_RULES: dict[str, Planner] = {
    "rules": plan_actions,
    "model": lambda tasks, elements: plan_actions(tasks, elements, model=True),
}
_planners = dict(_RULES)


def set_planner(name: str, planner: Planner) -> None:
    _planners[name] = planner


def get_planner(name: str = "rules") -> Planner:
    """The planner of that name; a name nobody registered is an error that lists those there are."""
    if name not in _planners:
        raise KeyError(f"no planner {name!r}; there are {sorted(_planners)}")
    return _planners[name]


def reset_planners() -> None:
    _planners.clear()
    _planners.update(_RULES)
