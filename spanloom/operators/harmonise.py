"""Ontology lookups and harmonisation (J1-J4, J13, J14, A1, A15, G13's remapping).

A look-up by type or role is an expression over the row (``ontology.Lookup``), at every size of the ontology, so it
shuffles nothing however often one type occurs.  Dimension columns (groups, role lists as rows) are joined without a
broadcast hint: Catalyst broadcasts a dimension whose size it knows to be under its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import let, truthy
from spanloom.ontology import Ontology


def _key(*parts: Column) -> Column:
    return F.concat_ws("\t", *parts)


# ---- J1 / J2 --------------------------------------------------------------------------------
def remap_types(events: DataFrame, ontology: Ontology, keep_unmapped: bool = True) -> DataFrame:
    """J1 on flat rows ``dataset, event_type, …``; adds ``new_type`` and ``mapped`` (NULL when there is no type)."""
    own = F.col("event_type")
    unified = ontology.unified_type()(_key(F.col("dataset"), own))
    has = truthy(own).isNotNull()
    return events.withColumns({
        "new_type": F.when(has, F.coalesce(unified, own if keep_unmapped else F.lit("Unknown"))).otherwise(own),
        "mapped": F.when(has, unified.isNotNull())})


def _new_role(ontology: Ontology):
    exact, any_case = ontology.unified_role(), ontology.unified_role_any_case()
    return lambda ds, etype, role: F.coalesce(exact(_key(ds, etype, role)), any_case(_key(ds, etype, F.lower(role))), role)


def remap_roles(arguments: DataFrame, ontology: Ontology) -> DataFrame:
    """J2 on flat rows ``dataset, event_type, role, …``: exact, then first ignoring case, else unchanged."""
    return arguments.withColumn("new_role", _new_role(ontology)(F.col("dataset"), F.col("event_type"), F.col("role")))


def remap_corpus(corpus: DataFrame, ontology: Ontology, keep_unmapped: bool = True) -> DataFrame:
    """J1+J2 on corpus rows; adds ``mapped`` and ``unmapped`` counts."""
    unified, new_role = ontology.unified_type(), _new_role(ontology)
    ds = F.col("dataset")

    def argument(etype, a):
        first = F.when(a["role"].isNotNull(), 0).when(a["role_type"].isNotNull(), 1).when(a["label"].isNotNull(), 2)
        out = a
        for k, f in enumerate(("role", "role_type", "label")):
            out = out.withField(f, F.when(first == k, new_role(ds, etype, a[f])).otherwise(a[f]))
        return out

    def mention(e):
        etype = truthy(e["event_type"])
        other = e["event_type"] if keep_unmapped else F.lit("Unknown")
        new = F.coalesce(unified(_key(ds, etype)), other)
        args = F.when(etype.isNotNull(), F.transform(e["arguments"], lambda a: argument(etype, a))).otherwise(e["arguments"])
        return e.withField("event_type", F.when(etype.isNotNull(), new).otherwise(e["event_type"])).withField("arguments", args)

    known = F.filter("event_mentions", lambda e: truthy(e["event_type"]).isNotNull())
    mapped = F.size(F.filter(known, lambda e: unified(_key(ds, e["event_type"])).isNotNull()))
    return (
        corpus.withColumn("mapped", mapped.cast("long"))
        .withColumn("unmapped", F.size(known).cast("long") - F.col("mapped"))
        .withColumn("event_mentions", F.transform("event_mentions", mention))
    )


def remap_stats(remapped: DataFrame) -> DataFrame:
    """A1: per data set and in total (``dataset`` NULL)."""
    return remapped.rollup("dataset").agg(
        F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped"), F.count("*").alias("items"))


# ---- J3 / J4 --------------------------------------------------------------------------------
def roles_for(ontology: Ontology, domain: Column, etype: Column, seen: Column, unified: bool = False) -> Column:
    """The type's role list, else that of the first type equal ignoring case, else the roles seen.

    With ``unified`` the role lists of the unified types are used whatever the domain (Q7).
    """
    low = F.lower(F.coalesce(etype, F.lit("")))
    types = ontology.unified_role_lists()(low) if unified else ontology.role_lists()(_key(domain, low))
    listed = let(types, lambda ts: F.coalesce(F.get(F.filter(ts, lambda t: t["t"] == etype), F.lit(0)), F.get(ts, F.lit(0)))["r"])
    return let(listed, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array_distinct(seen)))


def roles_for_type(events: DataFrame, ontology: Ontology, domain: str, etype: Column, seen: Column, unified: bool = False) -> DataFrame:
    """J3 on rows: adds ``roles``."""
    return events.withColumn("roles", roles_for(ontology, F.col(domain), etype, seen, unified))


def display_tag(ontology: Ontology, domain: Column, etype: Column) -> Column:
    """The type's tag in its data set (spellings tried in turn), else in the first data set that has it, else the type.

    An empty tag under the exact spelling counts as found, and the type itself is shown.
    """
    own = ontology.tag()

    def at(key):
        return own(_key(domain, key))

    tag = F.coalesce(
        at(etype), truthy(at(F.lower(etype))), at(F.upper(etype)), at(F.translate(etype, ":/-", "___")), ontology.tag_anywhere()(etype))
    return F.coalesce(truthy(tag), truthy(etype), F.lit("Unknown"))


def tag_types(events: DataFrame, ontology: Ontology) -> DataFrame:
    """J4 on rows ``dataset, event_type, …``: adds ``tag``."""
    return events.withColumn("tag", display_tag(ontology, F.col("dataset"), F.col("event_type")))


# ---- J13 / J14 / A15 -------------------------------------------------------------------------
def route_models(requests: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their model, and those no model serves.

    ``models`` has ``model_key, model_path``; a cross-domain request uses one key for every data set.
    """
    keyed = requests.withColumn(
        "model_key", F.when(F.col("model_type") == "cross-domain", "cross-domain").otherwise(F.col("dataset")))
    return keyed.join(models, "model_key"), keyed.join(models, "model_key", "left_anti")


def type_hierarchy(events: DataFrame, ontology: Ontology) -> DataFrame:
    """Events with their unified type, its group and secondary type."""
    return remap_types(events, ontology).join(
        ontology.dim_unified(events.sparkSession).withColumnRenamed("unified_type", "new_type"), "new_type", "left")


def schema_tree(events: DataFrame, ontology: Ontology) -> DataFrame:
    """Types and roles each data set defines, next to how often each type occurs in the events."""
    spark = events.sparkSession
    seen = events.groupBy("dataset", "event_type").agg(F.count("*").alias("n_events"))
    dim = ontology.dim_event_roles(spark).groupBy("dataset", "event_type", "type_ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("role_ord", "role")))),
                                 lambda x: x["role"]), " | ").alias("roles"),
        F.count("role").alias("n_roles"))
    sizes = dim.groupBy("dataset").agg(F.count("*").alias("n_types"))
    return dim.join(sizes, "dataset").join(seen, ["dataset", "event_type"], "left").select(
        "dataset", "n_types", "event_type", "roles", "n_roles", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def dims_used(events: DataFrame, ontology: Ontology) -> DataFrame:
    """How much of the loaded dimensions the events touch, per data set."""
    spark = events.sparkSession
    hit = events.join(ontology.dim_types(spark), ["dataset", "event_type"], "left")
    return hit.groupBy("dataset").agg(
        F.count("*").alias("n_events"), F.count("type_ord").alias("n_known"), F.countDistinct("event_type").alias("n_types"))
