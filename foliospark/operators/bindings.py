"""Bindings of controls to elements of data stores, by store id and path.

Stores are (doc_id, store, item_id, readable), their elements (doc_id, store, node, parent, ord, namespace, name), bindings (doc_id, binding, store_id,
mappings, path). A path is a chain of child steps with names, mapped prefixes and places (``/p:root/p:item[2]``); it is read by column
expressions and followed for all bindings at once, one level at a time, by joins on (store, parent, name, place). Elements are numbered once
among their equally named siblings, so a step costs a lookup, however many siblings there are.

Each binding has one status, the first that applies: ``StoreIdMissing``, ``StoreIdInvalid``, ``StoreMissing``, ``StoreAmbiguous``,
``PrefixMappingsInvalid``, ``XPathMissing``, ``XPathUnsupported`` or ``XPathInvalid`` (by the first step at fault), ``StoreUnreadable``, ``TargetMissing``, else ``Resolved``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.lineage import checkpointed

#: A mapping ``xmlns:p='uri'``, and a name as XML allows it without a prefix.
_MAPPING = r"""xmlns:([A-Za-z_][\w.-]*)\s*=\s*("[^"]*"|'[^']*')"""
_NAME = r"^[\p{L}_][\p{L}\p{N}\p{Mn}\p{Mc}_.·-]*$"
MOST_CHARS = 4096


def normal_guid(value: Column) -> Column:
    """A GUID in lower case with hyphens; null for what is none. Braces or parentheses around it and missing hyphens are accepted."""
    plain = F.lower(F.regexp_extract(F.trim(value), r"^(?:\{([0-9A-Fa-f-]+)\}|\(([0-9A-Fa-f-]+)\)|([0-9A-Fa-f-]+))$", 0))
    plain = F.regexp_replace(plain, r"^[{(]|[)}]$", "")
    short = F.regexp_replace(plain, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.regexp_like(short, F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), short)


def prefixes(text: Column) -> tuple[Column, Column]:
    """(valid, map of prefixes to namespaces) of mappings such as ``xmlns:a='x' xmlns:b='y'``; no text maps none."""
    text = F.coalesce(text, F.lit(""))
    names = F.regexp_extract_all(text, F.lit(_MAPPING), 1)
    uris = F.transform(F.regexp_extract_all(text, F.lit(_MAPPING), 2), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    valid = (F.trim(F.regexp_replace(text, _MAPPING, " ")) == "") & (F.size(names) == F.size(F.array_distinct(names)))
    return valid, F.when(valid, F.map_from_arrays(names, uris))


def path_steps(path: Column, known: Column) -> Column:
    """Array of (fault, namespace, name, place) of the steps of a path; one fault for a path that doesn't begin with a child of the root."""
    unsupported, invalid = F.lit("XPathUnsupported"), F.lit("XPathInvalid")

    def step(raw: Column) -> Column:
        name = F.regexp_extract(raw, r"^([^\[]*)", 1)
        inside = F.regexp_extract(raw, r"^[^\[]*\[([^\[\]]*)\]$", 1)
        bracket, colons = F.contains(raw, F.lit("[")), F.length(name) - F.length(F.replace(name, F.lit(":"), F.lit("")))
        prefix, local = F.substring_index(name, ":", 1), F.when(colons == 0, name).otherwise(F.substring_index(name, ":", -1))
        uri = F.when(colons == 0, F.lit("")).otherwise(F.try_element_at(known, prefix))
        fault = (
            F.when(raw == "", invalid).when(bracket & (~F.regexp_like(inside, F.lit("^0*[1-9][0-9]{0,8}$"))), unsupported)
            .when((colons > 1) | ((colons == 1) & ((prefix == "") | (local == ""))), invalid).when(uri.isNull(), invalid).when(~F.regexp_like(local, F.lit(_NAME)), unsupported)
        )
        return F.struct(fault.alias("fault"), uri.alias("namespace"), local.alias("name"), F.when(bracket, inside.try_cast("int")).alias("place"))

    none = F.lit(None).cast("string")
    whole = (F.length(path) < 2) | ~F.startswith(path, F.lit("/")) | F.contains(path, F.lit("//")) | (F.length(path) > MOST_CHARS)
    alone = F.array(F.struct(unsupported.alias("fault"), none.alias("namespace"), none.alias("name"), F.lit(None).cast("int").alias("place")))
    return F.when(whole, alone).otherwise(F.transform(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), step))


def resolve(bindings: DataFrame, stores: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings with ``store``, ``status`` and ``n_targets``; targets (doc_id, binding, store, node, ord))."""
    ids = stores.withColumn("item_id", normal_guid(F.col("item_id"))).where("item_id is not null")
    ids = ids.groupBy("doc_id", "item_id").agg(F.count("*").alias("stores"), F.min("store").alias("store"), F.bool_and("readable").alias("readable"))
    valid, known = prefixes(F.col("mappings"))
    rows = bindings.withColumns({"item_id": normal_guid(F.col("store_id")), "_valid": valid, "_known": known}).join(ids, ["doc_id", "item_id"], "left")
    rows = rows.withColumn("_steps", F.when(F.col("_valid"), path_steps(F.col("path"), F.col("_known"))))
    fault = F.get(F.filter(F.transform("_steps", lambda s: s["fault"]), lambda x: x.isNotNull()), 0)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    state = (
        F.when(blank("store_id"), "StoreIdMissing").when(F.col("item_id").isNull(), "StoreIdInvalid").when(F.col("stores").isNull(), "StoreMissing").when(F.col("stores") > 1, "StoreAmbiguous")
        .when(~F.col("_valid"), "PrefixMappingsInvalid").when(blank("path"), "XPathMissing").when(fault.isNotNull(), fault).when(~F.col("readable"), "StoreUnreadable")
    )
    rows = checkpointed(rows.withColumn("_state", state).withColumn("store", F.when(F.col("stores") == 1, F.col("store"))))
    place = F.row_number().over(W.partitionBy("doc_id", "store", "parent", "namespace", "name").orderBy("ord"))
    indexed = checkpointed(elements.withColumn("place", place).select("doc_id", "store", F.coalesce("parent", F.lit(-1)).alias("parent"), "namespace", "name", "place", "node", "ord"))
    at = rows.where("_state is null").select("doc_id", "binding", "store", "_steps", F.lit(-1).cast("long").alias("parent"))
    ended, k = None, 0
    while not at.isEmpty():
        step = F.get("_steps", F.lit(k))
        named = at.select("doc_id", "binding", "store", "_steps", "parent", step["namespace"].alias("namespace"), step["name"].alias("name"), step["place"].alias("wanted"))
        found = named.join(indexed, ["doc_id", "store", "parent", "namespace", "name"]).where("wanted is null or wanted = place")
        found = checkpointed(found.select("doc_id", "binding", "store", "_steps", F.col("node").alias("parent"), "ord"))
        k += 1
        done = found.where(F.size("_steps") == k).select("doc_id", "binding", "store", F.col("parent").alias("node"), "ord")
        ended = done if ended is None else ended.unionByName(done)
        at = found.where(F.size("_steps") > k).drop("ord")
    if ended is None:
        ended = elements.limit(0).select("doc_id", F.lit(None).cast(bindings.schema["binding"].dataType).alias("binding"), "store", "node", "ord")
    counts = ended.groupBy("doc_id", "binding").agg(F.count("*").alias("n_targets"))
    out = rows.join(counts, ["doc_id", "binding"], "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
    status = F.coalesce("_state", F.when(F.col("n_targets") == 0, "TargetMissing").otherwise("Resolved"))
    return out.select(*bindings.columns, "store", status.alias("status"), "n_targets"), ended


def repeating_sections(sections: DataFrame, resolved: DataFrame) -> DataFrame:
    """Sections (doc_id, binding, items) with how many elements they are bound to and whether they have as many items."""
    joined = sections.join(resolved.select("doc_id", "binding", "status", "n_targets"), ["doc_id", "binding"], "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
    return joined.withColumn("matches", F.col("items") == F.col("n_targets"))
