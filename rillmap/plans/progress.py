"""Weighted progress of a run."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.config import COMPONENT_SHARE, COMPONENT_STEPS, ELEMENT_SHARE, ELEMENT_STEPS

# What the old engine says to its users, whole.
ETA_UNKNOWN = "예상 소요 시간: 계산 중"
ETA_SOON = "예상 소요 시간: 거의 완료"
ETA_SECONDS = "예상 소요 시간: {}초"
ETA_MINUTES = "예상 소요 시간: {}분"


def format_eta(seconds: float | None) -> str:
    if seconds is None:
        return ETA_UNKNOWN
    if seconds < 1:
        return ETA_SOON
    return ETA_SECONDS.format(int(seconds)) if seconds < 60 else ETA_MINUTES.format(f"{seconds / 60:.1f}")


def eta_text(seconds: Column) -> Column:
    """What format_eta says, for a column of seconds; tenths are rounded by the binary value, as there."""
    minutes = F.call_function("format_number", seconds / 60, F.lit("0.0"))
    whole, minutes = F.format_string(ETA_SECONDS.format("%s"), seconds.cast("long")), F.format_string(ETA_MINUTES.format("%s"), minutes)
    return F.when(seconds.isNull(), ETA_UNKNOWN).when(seconds < 1, ETA_SOON).when(seconds < 60, whole).otherwise(minutes)


def progress_of(told: DataFrame) -> DataFrame:
    """(run, element, component, overall) of the shares that runs have told (run, step, share).

    A step counts with the last it told, as what is told never falls: the largest, cut to 0 to 1; steps of no name weigh nothing.
    """
    spark = told.sparkSession
    steps = spark.createDataFrame([(n, w, 0.0) for n, w in ELEMENT_STEPS] + [(n, 0.0, w) for n, w in COMPONENT_STEPS], "step string, element double, component double")
    shares = told.groupBy("run", "step").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.max("share"), F.lit(0.0)))).alias("share"))
    parts = shares.join(F.broadcast(steps), "step", "left")  # eleven rows
    sums = parts.groupBy("run").agg(*[F.coalesce(F.sum(F.col("share") * F.col(c)), F.lit(0.0)).alias(c) for c in ("element", "component")])
    return sums.withColumn("overall", ELEMENT_SHARE * F.col("element") + COMPONENT_SHARE * F.col("component"))


@dataclass
class Progress:
    """Shares done of all steps, by name; `renormalise` leaves out the step that no run ever starts."""

    renormalise: bool = False
    done: dict[str, float] = field(default_factory=dict)

    def update(self, step: str, share: float) -> None:
        if any(step == name for name, _ in ELEMENT_STEPS + COMPONENT_STEPS):
            self.done[step] = min(1.0, max(0.0, share))

    def _sum(self, steps) -> float:
        used = [(n, w) for n, w in steps if not (self.renormalise and n == "component_result")]
        return sum(w * self.done.get(n, 0.0) for n, w in used) / (sum(w for _, w in used) if self.renormalise else 1.0)

    def element(self) -> float:
        return self._sum(ELEMENT_STEPS)

    def component(self) -> float:
        return self._sum(COMPONENT_STEPS)

    def overall(self) -> float:
        return ELEMENT_SHARE * self.element() + COMPONENT_SHARE * self.component()


@dataclass
class StepTimer:
    clock: object = time.time
    started: float | None = None

    def start(self) -> None:
        self.started = self.clock()

    def eta_seconds(self, processed: int, total: int) -> float | None:
        """Seconds left at the rate so far; None before anything is known, 0 when done."""
        if self.started is None or processed <= 0 or total <= 0 or (spent := self.clock() - self.started) <= 0:
            return None
        return max(0, total - processed) * spent / processed


@dataclass
class RunState:
    """The current phase and step with its timer and the progress of all."""

    progress: Progress = field(default_factory=Progress)
    timer: StepTimer = field(default_factory=StepTimer)
    phase: str = ""
    step: str = ""

    def begin(self, phase: str, step: str) -> None:
        self.phase, self.step = phase, step
        self.timer.start()

    def heartbeat(self, share: float, eta: float | None = None, meta: dict | None = None) -> dict:
        """An event with whole percentages, cut off."""
        self.progress.update(self.step, share)
        p = self.progress
        percent = {"step_progress": share, "element_progress": p.element(), "component_progress": p.component(), "overall_progress": p.overall()}
        return {"phase": self.phase, "step": self.step, **{k: int(v * 100) for k, v in percent.items()}, "eta": format_eta(eta), "meta": meta or {}}
