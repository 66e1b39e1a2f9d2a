"""From stays and events to one wide, labelled feature table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidewatch.operators import cohort as C
from tidewatch.operators import guards, onepass, rules, windows


@dataclass
class FeatureOptions:
    """Which feature groups to build, over which window."""
    hours: float = 6.0
    bin_hours: float = 1.0
    anchors: list[int] = field(default_factory=lambda: [0, 1, 2, 3, 4, 6])
    vitals: list[str] = field(default_factory=list)
    labs: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=lambda: ["lab", "vital"])
    bins: bool = True
    trajectory: bool = True
    instability: bool = True
    process: bool = True
    row_rules: bool = True
    check_provenance: bool = False


def build_features(cohort: DataFrame, events: DataFrame, options: FeatureOptions, *, static: DataFrame | None = None,
                   positives: DataFrame | None = None, id_col: str = "stay_id", label: str = "mortality") -> DataFrame:
    """Every feature group of the windowed events, joined to the cohort by id.

    Events are shuffled once, for all groups together (``operators.onepass``)."""
    o = options
    busy = onepass.slice_counts(events, id_col)
    win = windows.windowed_events(events.join(busy, id_col, "left"), cohort, hours=o.hours, id_col=id_col, variable_col="variable")
    out = onepass.wide_features(win, cohort, hours=o.hours, vitals=o.vitals, labs=o.labs, bin_hours=o.bin_hours, anchors=o.anchors, sources=o.sources,
                                bins=o.bins, trajectory=o.trajectory, instability=o.instability, process=o.process, id_col=id_col)
    if static is not None:
        out = out.join(static, id_col, "left")
    if o.row_rules:
        out = rules.interactions(rules.organ_flags(rules.derived_flags(out)))
    if o.check_provenance:
        guards.provenance_gate(out, ignore=[id_col, "age_group"])
    return C.label_flag(out, positives, id_col, label) if positives is not None else out
