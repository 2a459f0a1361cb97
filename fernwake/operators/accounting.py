"""What a run costs and what it can afford: measured stages, keyed logs, provenance, update budgets."""

from __future__ import annotations

import resource
import subprocess
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "stage string, method string, fold string, seed int, seconds double, peak_mb double, revision string, version long"

# The names of a measurement's numbers, of a plan's, and the start-up seconds of a run.
MEASURED = ("seconds_per_step", "post_training_seconds_first_fold", "n_test_folds", "seeds", "losses", "epochs", "configured_steps_per_epoch")
OPTIONAL = ("preprocessing_seconds_first_fold", "encoder_setup_seconds_first_fold", "load_seconds")
PLANNED = ("steps_per_epoch", "runs", "training_hours", "overhead_hours", "estimated_hours_with_margin")
START_UP = 15.0


@dataclass
class Tracker:
    """Wall-clock and peak memory of the stages of a driver: ``with tracker.stage("fit", fold="a"): ...``."""

    rows: list[tuple] = field(default_factory=list)

    def stage(self, stage: str, method: str = "", fold: str = "", seed: int = 0) -> _Stage:
        return _Stage(self, (stage, method, fold, seed))

    def table(self, spark: SparkSession) -> DataFrame:
        """The measured stages, to be put into a log by ``sequences.upsert`` on (stage, method, fold, seed)."""
        return spark.createDataFrame(self.rows, LOG)


@dataclass
class _Stage:
    tracker: Tracker
    key: tuple

    def __enter__(self) -> _Stage:
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        self.tracker.rows.append((*self.key, time.perf_counter() - self.began, peak, git_revision(), time.time_ns()))


def git_revision(default: str = "unknown", folder: str | None = None) -> str:
    """The short revision of the working folder's repository, or ``default`` where there is none."""
    try:
        done = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5, check=True, cwd=folder)
        return done.stdout.strip() or default
    except (OSError, subprocess.SubprocessError):
        return default


def plan_budget(reports: DataFrame, max_hours: float = 9.5, reserve_hours: float = 1.0, safety: float = 1.35, least_steps: int = 32) -> DataFrame:
    """What each measured report affords: its columns, the ``PLANNED`` ones and ``refusal``, null where the sweep fits.

    A report has the columns ``MEASURED`` and, if known, ``OPTIONAL``. The hours without the
    reserve, divided by the safety margin, pay for the runs' fixed seconds first; the rest goes to
    updates, up to the configured ones. ``refusal`` is incomplete (a number is missing, not finite
    or not positive) or too little time (fewer than ``least_steps`` updates are left); the planned
    columns are null then.
    """
    if not 0 <= reserve_hours < max_hours or safety < 1 or least_steps < 1:
        raise ValueError("the hours, the margin or the least number of updates make no sense")
    number = lambda c: F.col(c).cast("double") if c in reports.columns else F.lit(None).cast("double")
    sound = lambda c: number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")) & (number(c) > 0)
    step, after, folds, seeds, losses, epochs, most = (F.when(sound(c), number(c)) for c in MEASURED)
    prepare, setup, load = (F.coalesce(number(c), F.lit(0.0)) for c in OPTIONAL)
    runs = folds * seeds * losses
    fixed = (prepare + setup + after + START_UP) * runs + load * losses
    affordable = (F.lit((max_hours - reserve_hours) * 3600 / safety) - fixed) / (runs * epochs * step)
    steps = F.least(F.floor(most), F.floor(affordable))
    spent = runs * epochs * steps * step
    refusal = F.when(~_all(sound(c) for c in MEASURED), "incomplete").when(steps < least_steps, "too little time")
    planned = dict(zip(PLANNED, (steps.cast("long"), runs.cast("long"), spent / 3600, fixed / 3600, (spent + fixed) * safety / 3600)))
    return reports.withColumn("refusal", refusal).withColumns({k: F.when(F.col("refusal").isNull(), v) for k, v in planned.items()})


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
