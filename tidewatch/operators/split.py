"""Deterministic splits, folds and resampling, all from hash order: no random state on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import hash_fraction
from tidewatch.operators.joins import spread_join
from tidewatch.operators.ranking import hash_ranks
from tidewatch.plans.lineage import stored


def entity_labels(df: DataFrame, entity: str, label: str) -> DataFrame:
    return df.groupBy(entity).agg(F.max(label).alias("_y"))


def _strata(entities: DataFrame, stratify: bool) -> DataFrame:
    """One stratum per label, or a single one when a label has fewer than two entities; an entity
    without any label fails."""
    if not stratify:
        return entities.withColumn("_stratum", F.lit(""))
    counts = entities.groupBy("_y").agg(F.count("*").alias("_n"))
    small = counts.agg((F.coalesce(F.min("_n"), F.lit(0)) < 2).alias("_small"))
    return entities.crossJoin(small).withColumn(
        "_stratum", F.when(F.col("_y").isNull(), F.raise_error(F.lit("a stratified split needs a label for every entity")))
        .when(F.col("_small"), F.lit("")).otherwise(F.col("_y").cast("string"))).drop("_small")


def split_entities(df: DataFrame, entity: str, label: str, *, test: float = 0.2, valid: float = 0.2, seed: int = 42,
                   stratify: bool = True) -> DataFrame:
    """(entity, split): each entity in exactly one of train, validation, test.

    Fractions are of all entities, per label; the entity label is its largest row label."""
    if not (0 < test < 1 and 0 < valid < 1 and test + valid < 1):
        raise ValueError("test and valid must be in (0, 1) and sum to less than 1")
    ranked = hash_ranks(_strata(entity_labels(df, entity, label), stratify), ["_stratum"], entity, salt=f"|{seed}")
    at = (F.col("rank") - 1).cast("double") / F.col("n")
    return ranked.select(entity, F.when(at < F.lit(test), "test").when(at < F.lit(test + valid), "validation")
                         .otherwise("train").alias("split"))


def split_rows(df: DataFrame, entity: str, label: str, **options) -> DataFrame:
    """The rows of ``df`` with their entity's split."""
    return spread_join(df, split_entities(df, entity, label, **options), [entity], by=df.columns)


def split_overlap(assigned: DataFrame, entity: str) -> DataFrame:
    """Entities found in more than one split: must be empty."""
    pair = F.struct(F.min("split").alias("a"), F.max("split").alias("b"))
    return (assigned.groupBy(entity).agg(pair.alias("_p")).where(F.col("_p.a") != F.col("_p.b"))
            .select(entity, F.col("_p.a").alias("first_split"), F.col("_p.b").alias("last_split")))


def fold_entities(df: DataFrame, entity: str, label: str, *, k: int = 5, seed: int = 42,
                  stratify: bool = True) -> DataFrame:
    """(entity, fold): k folds, k capped by the smallest stratum's entity count."""
    ranked = stored(hash_ranks(_strata(entity_labels(df, entity, label), stratify), ["_stratum"], entity, salt=f"|{seed}"), "entities")
    cap = ranked.agg(F.least(F.lit(k), F.min("n")).cast("bigint").alias("_k"))
    return ranked.crossJoin(cap).select(entity, ((F.col("rank") - 1) % F.col("_k")).cast("int").alias("fold"))


def resample(df: DataFrame, label: str, row_key: str, *, how: str, seed: int = 42) -> DataFrame:
    """Balance classes: 'under' keeps as many rows per class as the smallest has, 'over' repeats
    rows up to the largest. Hash order decides which; ``copy`` numbers the repeats."""
    ranked = hash_ranks(df, [label], row_key, salt=f"|{seed}", digits=4, rank="_rank").withColumnRenamed("n", "_n")
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    if how == "under":
        target = counts.agg(F.min("_c").alias("_t"))
        out = ranked.crossJoin(target).where(F.col("_rank") <= F.col("_t"))
        return out.select(*df.columns, F.lit(0).alias("copy"))
    if how != "over":
        raise ValueError("how must be 'under' or 'over'")
    target = counts.agg(F.max("_c").alias("_t"))
    whole = F.floor(F.col("_t") / F.col("_n"))
    times = whole + F.when(F.col("_rank") <= F.col("_t") - whole * F.col("_n"), 1).otherwise(0)
    out = ranked.crossJoin(target).withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    return out.select(*df.columns, "copy")


def mask_observed(grid: DataFrame, keys: list[str], *, rate: float = 0.15, seed: int = 42, value: str = "value",
                  mask: str = "mask") -> DataFrame:
    """Hide a share of the observed cells; gives corrupted value, mask and hide flag."""
    hide = (F.col(mask) == 1) & (hash_fraction(*[F.col(k).cast("string") for k in keys], seed) < rate)
    return grid.select(*keys, F.when(hide, F.lit(0.0)).otherwise(F.col(value)).alias(value),
                       F.when(hide, F.lit(0)).otherwise(F.col(mask)).alias(mask),
                       hide.cast("int").alias("hidden"))
