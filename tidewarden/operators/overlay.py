"""Three tiers of elements: changes of the batch, kept state, base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(*tiers: DataFrame, keys: tuple[str, ...] = ("etype", "id"), keep_deleted: bool = False) -> DataFrame:
    """The first tier that knows a key wins; a deleted row there hides those below. Tiers have ``deleted``.

    The last tier is the large one: it is only anti-joined, never sorted or regrouped."""
    *upper, base = tiers
    if upper:
        ranked = reduce(DataFrame.unionByName, [t.withColumn("tier_", F.lit(k)) for k, t in enumerate(upper)])
        w = Window.partitionBy(*keys).orderBy("tier_")
        top = ranked.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_", "tier_")
        rest = base.join(top.select(*keys), list(keys), "left_anti")
        base = top.unionByName(rest)
    return base if keep_deleted else base.where(~F.col("deleted"))


def lookup(ids: DataFrame, *tiers: DataFrame, keys: tuple[str, ...] = ("etype", "id")) -> DataFrame:
    """For each asked key its row, with ``found``: 'value', 'deleted' or 'absent'."""
    asked = ids.select(*keys).distinct()
    hits = overlay(*[t.join(asked, list(keys), "left_semi") for t in tiers], keys=keys, keep_deleted=True)
    return asked.join(hits, list(keys), "left").withColumn("found", F.when(F.col("deleted").isNull(), "absent").when(F.col("deleted"), "deleted").otherwise("value"))


def upsert(state: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("etype", "id")) -> DataFrame:
    """New state: rows of the batch replace those of the same key; deletions stay as marks that hide the base."""
    return batch.unionByName(state.join(batch.select(*keys), list(keys), "left_anti"))


def delete(state: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return state.join(ids.select(*keys), list(keys), "left_anti")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edge tables only grow."""
    return edges.unionByName(more).distinct()
