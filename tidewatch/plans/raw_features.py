"""From raw rows (charted and laboratory readings by item code) to the labelled feature table.

Item codes become variables in the scan, where the list of codes is a pushed filter; charted readings
meet the cohort by stay, laboratory readings by subject and time. Both are one table of windowed events, which is
shuffled once (``operators.onepass``); demographics, prior codes and labels have one row per stay or
subject when they join."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import flag, hours_between, plus_hours
from tidewatch.operators import cohort as C
from tidewatch.operators import guards, joins, onepass, rules
from tidewatch.sources.tables import require_columns


@dataclass
class RawTables:
    """Raw tables. ``cohort``: stay_id, subject_id, hadm_id, intime, one row per stay; the others as their comments say."""
    cohort: DataFrame
    chart: DataFrame  # stay_id, charttime, itemid, valuenum
    labs: DataFrame  # subject_id, charttime, itemid, valuenum
    patients: DataFrame | None = None  # subject_id, gender, anchor_age, anchor_year
    admissions: DataFrame | None = None  # subject_id, hadm_id, admittime
    diagnoses: DataFrame | None = None  # subject_id, hadm_id, icd_code, icd_version
    positives: DataFrame | None = None  # subject_id


@dataclass
class RawOptions:
    """Window, groups and item codes. ``convert`` brings Fahrenheit, inches and pounds to Celsius, centimetres and kilograms by code."""
    hours: float = 6.0
    bin_hours: float = 1.0
    anchors: list[int] = field(default_factory=lambda: [0, 1, 2, 3, 4, 6])
    tolerance: float = 0.5
    first_limit: float = 1.0
    edge_hours: float = 2.0
    vital_codes: dict[str, list[int]] = field(default_factory=lambda: dict(K.VITAL_CODES))
    lab_codes: dict[str, list[int]] = field(default_factory=lambda: dict(K.LAB_CODES))
    bins: bool = True
    trajectory: bool = True
    instability: bool = True
    process: bool = True
    row_rules: bool = True
    convert: bool = True
    check_provenance: bool = False
    per_slice: int = onepass.PER_SLICE


OTHER = {"urine_output": K.URINE_CODES, "height": K.HEIGHT_CODES, "weight": K.WEIGHT_CODES}
COLUMNS = ["charttime", "itemid", "valuenum"]


def variable_of(codes: dict[str, list[int]], item: str = "itemid") -> Column:
    """Variable of an item code, from a literal map: no join, no lookup table to send."""
    known = {int(c): v for v, cs in codes.items() for c in cs}
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])[F.col(item).cast("int")]


def converted(value: str = "valuenum", item: str = "itemid") -> Column:
    v, i = F.col(value).cast("double"), F.col(item)
    return (F.when(i.isin(K.FAHRENHEIT_CODES), (v - 32) * 5 / 9).when(i.isin(K.INCH_CODES), v * 2.54)
            .when(i.isin(K.POUND_CODES), v * 0.453592).otherwise(v))


def _coded(events: DataFrame, key: str, codes: dict[str, list[int]], source: str, convert: bool, what: str) -> DataFrame:
    require_columns(events, [key, *COLUMNS], what)
    listed = sorted({int(c) for cs in codes.values() for c in cs})
    known = events.where(F.col("itemid").isin(listed) & F.col(key).isNotNull() & F.col("charttime").isNotNull())
    return known.select(key, "charttime", variable_of(codes).alias("variable"), F.lit(source).alias("source"),
                        (converted() if convert else F.col("valuenum").cast("double")).alias("valuenum"))


def windowed_codes(raw: RawTables, options: RawOptions) -> DataFrame:
    """(stay_id, charttime, variable, source, valuenum, hours_from_admit, _slices) of all coded readings in their stay's window.

    A laboratory reading of a subject belongs to every stay of that subject whose window holds it."""
    o = options
    chart = _coded(raw.chart, "stay_id", o.vital_codes | OTHER, "vital", o.convert, "chart events")
    labs = _coded(raw.labs, "subject_id", o.lab_codes, "lab", o.convert, "lab events")
    stays = raw.cohort.groupBy("stay_id", "subject_id").agg(F.min("intime").alias("intime"))
    busy = onepass.slice_counts(chart, "stay_id", o.per_slice)
    by_stay = stays.join(busy, "stay_id", "left").select("stay_id", "_slices", "intime")
    mine = joins.spread_join(chart, by_stay, ["stay_id"], by=["charttime"])
    mine = mine.where((F.col("charttime") >= F.col("intime")) & (F.col("charttime") <= plus_hours("intime", o.hours)))
    busy = onepass.slice_counts(labs, "subject_id", o.per_slice)
    spans = stays.join(busy, "subject_id", "left").withColumn("_end", plus_hours("intime", o.hours))
    theirs = joins.interval_join(labs, spans, ["subject_id"], time="charttime", start="intime", end="_end", width=max(1.0, o.hours)).drop("_end", "subject_id")
    return mine.unionByName(theirs).withColumn("hours_from_admit", hours_between("intime", "charttime")).drop("intime")


def history(raw: RawTables) -> DataFrame:
    """(subject_id, counts of earlier diagnoses by chapter, has_metastatic_cancer) of every subject of the cohort."""
    subjects = raw.cohort.select("subject_id").distinct()
    codes = C.prior_codes(raw.cohort, raw.admissions, raw.diagnoses)
    chapters = C.chapter_counts(subjects, codes, C.diagnosis_chapter(F.col("icd_code"), F.col("icd_version")))
    cancer = C.any_code_flag(subjects, raw.diagnoses, C.metastatic(F.col("icd_code"), F.col("icd_version")), "has_metastatic_cancer")
    return chapters.join(cancer, "subject_id")


def body_mass(height: Column, weight: Column, height_range=(120, 220), weight_range=(30, 300)) -> Column:
    """Weight in kg by squared height in m; NULL if either is out of its range."""
    ok = height.between(*height_range) & weight.between(*weight_range)
    return F.when(ok, weight / ((height / 100) * (height / 100)))


def raw_features(raw: RawTables, options: RawOptions | None = None, label: str = "mortality") -> DataFrame:
    """The feature table of a cohort: demographics, event features, urine, INR, body mass index, history and label.

    Null values of readings count for the measurement process only."""
    o = options or RawOptions()
    win = windowed_codes(raw, o)
    vitals, labs = list(o.vital_codes), list(o.lab_codes)
    extra = {"urine_output_total": ("urine_output", "sum"), "urine_output_measured": ("urine_output", "measured"),
             "_height": ("height", "first"), "_weight": ("weight", "first")}
    # all that has few columns meets first, so that no join moves the wide rows
    keys = ["stay_id", "subject_id", "hadm_id"]
    stays = raw.cohort.select(*keys).distinct()
    base, own = stays.where(F.col("stay_id").isNotNull()), []
    if raw.patients is not None and raw.admissions is not None:
        base = base.join(C.demographics(stays, raw.patients, raw.admissions).select("stay_id", "age", "gender_numeric"), "stay_id", "left")
        own += ["age", "gender_numeric"]
    if raw.diagnoses is not None and raw.admissions is not None:
        past = history(raw)
        base = base.join(past, "subject_id", "left")
        own += [c for c in past.columns if c != "subject_id"]
        keys = ["subject_id", "stay_id", "hadm_id"]
    if raw.positives is not None:
        base = C.label_flag(base, raw.positives, "subject_id", "_label")
    out = onepass.wide_features(
        win, base, hours=o.hours, vitals=vitals, labs=labs, bin_hours=o.bin_hours, anchors=o.anchors, tolerance=o.tolerance,
        first_limit=o.first_limit, edge_hours=o.edge_hours, sources=["lab", "vital"], bins=o.bins, trajectory=o.trajectory,
        instability=o.instability, process=o.process, extra=extra, count_variables=[*vitals, *labs], whole_rows=True)
    made = [c for c in out.columns if c not in (*base.columns, "_height", "_weight")]
    bmi = body_mass(F.col("_height"), F.col("_weight"))
    out = out.select(*keys, *made, bmi.alias("bmi"), flag(bmi.isNotNull()).alias("bmi_measured"), *own, *(["_label"] if raw.positives is not None else []))
    if o.row_rules:
        out = rules.interactions(rules.organ_flags(rules.derived_flags(out)))
    if o.check_provenance:
        guards.provenance_gate(out.drop("_label"), ignore=["stay_id", "subject_id", "hadm_id", "age_group", "has_metastatic_cancer"])
    if raw.positives is None:
        return out
    return out.select("subject_id", *[c for c in out.columns if c not in ("subject_id", "_label")], F.col("_label").alias(label))
