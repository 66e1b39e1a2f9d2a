"""Cohort selection, patient-level history and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import flag, hours_between, plus_hours
from tidewatch.operators.joins import interval_join, spread_join
from tidewatch.plans.lineage import stored
from tidewatch.sources.tables import observed


def first_per_entity(stays: DataFrame, subject: str = "subject_id", time: str = "intime",
                     stay: str = "stay_id") -> DataFrame:
    """The earliest stay of each subject, stay id breaking ties.

    A min over a struct combines map-side, so a subject with very many stays never meets in
    one sort, as it would with a row_number window."""
    rest = [c for c in stays.columns if c not in (subject, time, stay)]
    best = stays.groupBy(subject).agg(F.min(F.struct(time, stay, *rest)).alias("_s"))
    return best.select(subject, *[F.col(f"_s.{c}").alias(c) for c in (time, stay, *rest)]).select(*stays.columns)


def earliest_record(events: DataFrame, stay: str = "stay_id", time: str = "charttime") -> DataFrame:
    return events.groupBy(stay).agg(F.min(time).alias("earliest_record"))


def select_cohort(stays: DataFrame, events: DataFrame, *, min_hours: float = 6.0, subject: str = "subject_id",
                  stay: str = "stay_id", time: str = "intime", end: str = "outtime",
                  event_time: str = "charttime") -> DataFrame:
    """First stays with at least ``min_hours`` between their earliest record and their end."""
    first = first_per_entity(stays, subject, time, stay)
    out = first.join(earliest_record(events, stay, event_time), stay)
    out = out.withColumn("duration_hours", hours_between("earliest_record", end))
    return out.where(F.col("duration_hours") >= min_hours)


def cohort_flow(stays: DataFrame, events: DataFrame, *, min_hours: float, subject: str = "subject_id",
                stay: str = "stay_id", time: str = "intime", end: str = "outtime",
                event_time: str = "charttime") -> DataFrame:
    """(step, n) rows of the selection. Stays without any record are their own step."""
    first = first_per_entity(stays, subject, time, stay).join(earliest_record(events, stay, event_time), stay, "left")
    hours = hours_between("earliest_record", end)
    f = first.agg(F.count("*").alias("first_stays"),
                  F.sum(flag(F.col("earliest_record").isNull())).alias("no_record"),
                  F.sum(flag(hours < min_hours)).alias("too_short"),
                  F.sum(flag(hours >= min_hours)).alias("kept"))
    t = stays.agg(F.count("*").alias("total_stays"), F.countDistinct(subject).alias("subjects"))
    one = t.crossJoin(f)
    steps = [("total_stays", F.col("total_stays")), ("subjects", F.col("subjects")),
             ("first_stays", F.col("first_stays")),
             ("excluded_repeat_stays", F.col("total_stays") - F.col("first_stays")),
             ("excluded_no_record", F.col("no_record")), ("excluded_short", F.col("too_short")),
             ("final_cohort", F.col("kept"))]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), c.cast("bigint").alias("n"))
        for i, (n, c) in enumerate(steps)])).alias("s")).select("s.step", "s.name", "s.n")


def _flow_rows(spark, steps: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, name, int(n)) for i, (name, n) in enumerate(steps)], "step int, name string, n long")


def observed_cohort(stays: DataFrame, events: DataFrame, *, min_hours: float = 6.0, subject: str = "subject_id", stay: str = "stay_id",
                    time: str = "intime", end: str = "outtime", event_time: str = "charttime") -> tuple[DataFrame, DataFrame]:
    """(cohort as ``select_cohort`` gives it, stored; its flow as (step, name, n)) from one pass over stays and events.

    The counts are metrics observed while the one job that writes the cohort runs: nothing is read again to report
    them. Stays without a subject count as one subject, as they do when first stays are chosen. A stage that is run again
    after an executor was lost may be counted again, so the flow is a report; the cohort itself is not affected."""
    every, first_, long_, read = (Observation(n) for n in ("stays", "first_stays", "durations", "events"))
    seen = events.observe(read, F.count("*").alias("n"), F.sum(flag(F.col(event_time).isNull())).alias("untimed"))
    first = first_per_entity(stays.observe(every, F.count("*").alias("n")), subject, time, stay).observe(first_, F.count("*").alias("n"))
    timed = first.join(earliest_record(seen, stay, event_time), stay, "left").withColumn("duration_hours", hours_between("earliest_record", end))
    d = F.col("duration_hours")
    told = timed.observe(long_, F.sum(flag(F.col("earliest_record").isNull())).alias("none"), F.sum(flag(d < min_hours)).alias("short"),
                         F.sum(flag(d >= min_hours)).alias("kept"))
    cohort = stored(told.where(d >= min_hours).select(stay, *[c for c in stays.columns if c != stay], "earliest_record", "duration_hours"), "cohort")
    total, firsts, n = observed(every)["n"], observed(first_)["n"], observed(long_)
    steps = [("total_stays", total), ("subjects", firsts), ("first_stays", firsts), ("excluded_repeat_stays", total - firsts),
             ("excluded_no_record", n["none"]), ("excluded_short", n["short"]), ("final_cohort", n["kept"]),
             ("events_read", observed(read)["n"]), ("events_without_time", observed(read)["untimed"])]
    return cohort, _flow_rows(stays.sparkSession, steps)


def with_window(cohort: DataFrame, hours: float, time: str = "intime", name: str = "window_end") -> DataFrame:
    return cohort.withColumn(name, plus_hours(time, hours))


def demographics(cohort: DataFrame, patients: DataFrame, admissions: DataFrame, subject: str = "subject_id",
                 admission: str = "hadm_id") -> DataFrame:
    """Age at admission (above 89 becomes 90) and sex as 1/0."""
    out = spread_join(cohort, patients, [subject], by=[admission], how="left")
    out = out.join(admissions, [subject, admission], "left")
    age = F.col("anchor_age") + F.year("admittime") - F.col("anchor_year")
    return out.select(*cohort.columns, F.when(age > 89, 90).otherwise(age).cast("int").alias("age"),
                      F.when(F.col("gender") == "M", 1).when(F.col("gender") == "F", 0).alias("gender_numeric"))


def prior_codes(cohort: DataFrame, admissions: DataFrame, codes: DataFrame, *, subject: str = "subject_id",
                admission: str = "hadm_id", intime: str = "intime", admittime: str = "admittime") -> DataFrame:
    """Codes of a subject's admissions that began before its stay (one stay per subject)."""
    begin = cohort.groupBy(subject).agg(F.min(intime).alias("_in"))
    prior = spread_join(admissions.select(subject, admission, admittime), begin, [subject], by=[admission])
    prior = prior.where(F.col(admittime) < F.col("_in")).select(subject, admission)
    own = codes.drop(subject)
    return spread_join(own, prior, [admission], by=[c for c in own.columns if c != admission])


def _plain_code(code: Column) -> Column:
    """A code in capitals without dots."""
    return F.translate(F.upper(F.trim(code)), ".", "")


def diagnosis_chapter(code: Column, version: Column) -> Column:
    """Chapter of an ICD-9 or ICD-10 code; V and E are ICD-9 prefixes, dots are ignored."""
    c = _plain_code(code)
    # the leading number, if it has at most three digits, picks its chapter from a list: evaluated once per code
    number = F.regexp_extract(F.upper(F.trim(code)), "^0*([0-9]{1,3})(?![0-9])", 1).try_cast("int")
    chapters = [next((n for low, high, n in K.ICD9_RANGES if low <= i <= high), "other_icd9") for i in range(1000)]
    nine = F.coalesce(F.get(F.array(*[F.lit(n) for n in chapters]), number), F.lit("other_icd9"))
    ten = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in K.ICD10_PREFIXES:
        ten = ten.when(c.rlike(pattern), F.lit(name))
    ten = ten.otherwise(F.lit("other_icd10"))
    return (F.when(code.isNull(), F.lit("unknown")).when(version == 9, nine).when(version == 10, ten)
            .otherwise(F.lit("unknown")))


def chapter_counts(subjects: DataFrame, codes: DataFrame, chapter: Column, chapters: list[str] = K.CHAPTERS,
                   subject: str = "subject_id", prefix: str = "prev_dx_") -> DataFrame:
    """Count of prior codes per chapter, total and a has-any flag; zero when there are none."""
    found = codes.select(subject, chapter.alias("_ch")).groupBy(subject).agg(
        F.count(F.when(F.col("_ch").isin(list(chapters)), 1)).alias("_total"), *[F.count(F.when(F.col("_ch") == c, 1)).alias(f"_{i}") for i, c in enumerate(chapters)])
    out = subjects.select(subject).distinct().join(found, subject, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select(subject, flag(F.col("_total") > 0).alias("has_prior_diagnoses"),
                      *[zero(f"_{i}").alias(f"{prefix}{n}_count") for i, n in enumerate(chapters)], zero("_total").alias(f"{prefix}count_total"))


def metastatic(code: Column, version: Column) -> Column:
    c = _plain_code(code)

    def begins(prefixes):  # one lookup per length of prefix
        found = F.lit(False)
        for n in sorted({len(p) for p in prefixes}):
            found = found | F.substring(c, 1, n).isin([p for p in prefixes if len(p) == n])
        return found

    nine = c.isin(K.METASTATIC_ICD9_EXACT) | begins(K.METASTATIC_ICD9_PREFIXES)
    return F.when(version == 9, nine).when(version == 10, begins(K.METASTATIC_ICD10_PREFIXES)).otherwise(F.lit(False))


def any_code_flag(subjects: DataFrame, codes: DataFrame, match: Column, name: str,
                  subject: str = "subject_id") -> DataFrame:
    """1 when any of the subject's codes matches, else 0."""
    hit = codes.groupBy(subject).agg(F.max(flag(match)).alias(name))
    return (subjects.select(subject).distinct().join(hit, subject, "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0))))


def label_flag(entities: DataFrame, positives: DataFrame, key: str, name: str = "label") -> DataFrame:
    """1 when the key is present in ``positives``."""
    hit = positives.select(key).distinct().withColumn(name, F.lit(1))
    return entities.join(hit, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def bridge(events: DataFrame, cohort: DataFrame, source: str = "subject_id", stay: str = "stay_id",
           time: str = "intime") -> DataFrame:
    """Give source-level events the stay of their source: the first stay of each source."""
    first = cohort.groupBy(source).agg(F.min(F.struct(time, stay)).alias("_s")).select(
        source, F.col(f"_s.{stay}").alias(stay))
    return spread_join(events, first, [source], by=[c for c in events.columns if c != source])


def bridge_overlapping(events: DataFrame, stays: DataFrame, *, source: str = "subject_id", time: str = "charttime", start: str = "intime",
                       end: str = "outtime", width: float = 24.0) -> DataFrame:
    """Give source-level events every stay of their source that is under way at their time.

    An event within several overlapping stays comes once per stay, one outside all of them not at all.
    ``width``: hours of a time bucket, near the usual length of a stay."""
    return interval_join(events, stays, [source], time=time, start=start, end=end, width=width)


def map_codes(events: DataFrame, items: DataFrame, code: str = "itemid", value: str | None = None,
              fahrenheit: list | None = None) -> DataFrame:
    """Keep events with a known code and name their variable; Fahrenheit codes become Celsius."""
    out = events.join(items, code)
    if value and fahrenheit:
        out = out.withColumn(value, F.when(F.col(code).isin(fahrenheit), (F.col(value) - 32) * 5 / 9)
                             .otherwise(F.col(value)))
    return out


def item_table(spark, codes: dict[str, list], code: str = "itemid") -> DataFrame:
    return spark.createDataFrame([(c, v) for v, cs in codes.items() for c in cs], f"{code} int, variable string")


def codes_by_label(items: DataFrame, pattern: str, code: str, label: str, extra: list) -> DataFrame:
    """Codes whose label matches (case-insensitive), plus codes that are always included."""
    return items.where(F.col(label).rlike(f"(?i){pattern}") | F.col(code).isin(extra)).select(code).distinct()
