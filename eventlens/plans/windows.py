"""Analysis windows: one baseline and labelled suspect windows, half-open, in UTC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 10


@dataclass(frozen=True)
class Window:
    label: str
    start: str
    end: str

    def holds(self, ts: Column) -> Column:
        """False for undated rows."""
        return F.coalesce((ts >= F.lit(self.start).cast("timestamp")) & (ts < F.lit(self.end).cast("timestamp")), F.lit(False))

    @property
    def seconds(self) -> Column:
        return F.unix_millis(F.lit(self.end).cast("timestamp")) / 1000 - F.unix_millis(F.lit(self.start).cast("timestamp")) / 1000


@dataclass(frozen=True)
class AnalysisWindows:
    baseline: Window
    suspects: tuple[Window, ...]

    def __post_init__(self):
        labels = [w.label for w in self.suspects]
        if not 1 <= len(labels) <= MOST or len(set(labels)) < len(labels):
            raise ValueError(f"1 to {MOST} suspect windows with different labels are needed")
        for w in (self.baseline, *self.suspects):
            if not w.start < w.end:
                raise ValueError(f"window {w.label} is empty")
            if w is not self.baseline and w.start < self.baseline.end and self.baseline.start < w.end:
                raise ValueError(f"window {w.label} overlaps the baseline")

    def all_labels(self, ts: Column) -> Column:
        """Labels of all suspect windows that hold ts."""
        return F.filter(F.array(*[F.when(w.holds(ts), F.lit(w.label)) for w in self.suspects]), lambda x: x.isNotNull())

    def first_label(self, ts: Column) -> Column:
        """Label of the first suspect window that holds ts, else null."""
        out = F.lit(None).cast("string")
        for w in reversed(self.suspects):
            out = F.when(w.holds(ts), F.lit(w.label)).otherwise(out)
        return out

    def any(self, ts: Column) -> Column:
        """In the baseline or a suspect window."""
        out = self.baseline.holds(ts)
        for w in self.suspects:
            out = out | w.holds(ts)
        return out
