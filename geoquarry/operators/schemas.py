"""Schema catalogs: class names of relations, properties of JSON schemas, enumerations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geoquarry.sources.scratch import stored

IGNORED = ("fact_sheet", "factsheet")
COMBINATORS = ("oneOf", "allOf", "anyOf")
#: Properties that carry plumbing, not content.
DROPPED = ("source_http_request",)
_PROPERTY = "map<string, struct<description: string, deprecated: boolean, enum: array<string>>>"
#: One node of a schema and one property, what is inside as text.
NODE = "properties map<string, string>, " + ", ".join(f"{c} array<string>" for c in COMBINATORS)
PROPERTY = "deprecated boolean, enum array<string>, deprecated_enum_values string"
# Fixed values.
PROPERTY_TYPES = ("LandParcel", "Building", "Unit", "ManufacturedHome")
#: Depth 0 and 1 of a schema: its own properties and those of its combinators' members.
SCHEMA = f"properties {_PROPERTY}, " + ", ".join(f"{c} array<struct<properties: {_PROPERTY}>>" for c in COMBINATORS)


def relation_classes(key: str) -> Column:
    """The two class names of ``a_has_b`` or ``a_to_b``, null for other names; further parts are ignored."""
    c = F.col(key)
    split = F.when(F.instr(c, "_has_") > 0, F.split(c, "_has_")).when(F.instr(c, "_to_") > 0, F.split(c, "_to_"))
    return F.slice(split, 1, 2)


def manifest_rows(docs: DataFrame, column: str) -> DataFrame:
    """name, cid, type of every entry of manifests that map names to entries."""
    parsed = docs.select(F.explode(F.from_json(column, "map<string, struct<ipfsCid: string, type: string>>")).alias("name", "entry"))
    return parsed.select("name", F.col("entry.ipfsCid").alias("cid"), F.col("entry.type").alias("type"))


def classes(manifest: DataFrame, schemas: DataFrame) -> DataFrame:
    """Distinct classes at either end of relations, with the class entry of the manifest and its display name."""
    ends = manifest.where("type = 'relationship'").select(F.explode(relation_classes("name")).alias("class")).select(F.lower(F.trim("class")).alias("class")).where(~F.col("class").isin(*IGNORED)).distinct()
    entry = manifest.where("type = 'class'").select(F.lower(F.trim("name")).alias("class"), "cid")
    named = schemas.select("cid", F.get_json_object("schema", "$.name").alias("own"), F.get_json_object("schema", "$.title").alias("title"))
    return ends.join(entry, "class").join(named, "cid", "left").select("class", "cid", F.coalesce("own", "title", "class").alias("display"))


def properties(schemas: DataFrame) -> DataFrame:
    """cid, property, description, enum: direct properties and those of combinators; the first description that is not empty wins."""
    parsed = schemas.select("cid", F.from_json("schema", SCHEMA).alias("s"))
    nodes = F.concat(F.array(F.col("s.properties")), *(F.transform(F.coalesce(F.col(f"s.{c}"), F.array().cast(f"array<struct<properties:{_PROPERTY}>>")), lambda m: m["properties"]) for c in COMBINATORS))
    flat = parsed.select("cid", F.posexplode(nodes).alias("position", "node")).select("cid", "position", F.explode("node").alias("property", "p"))
    kept = flat.where(~F.coalesce("p.deprecated", F.lit(False)) & ~F.lower("property").isin(*DROPPED))
    described = F.when(F.trim(F.coalesce("p.description", F.lit(""))) != "", F.col("position"))
    return kept.groupBy("cid", "property").agg(F.min_by("p.description", described).alias("description"), F.min_by("p.enum", "position").alias("enum"))


def _members(number: int, combinator: str) -> Column:
    """The schemas in a combinator, with their paths."""
    held = F.coalesce(F.col(f"s.{combinator}"), F.array().cast("array<string>"))
    return F.transform(held, lambda m, i: F.struct(F.concat("path", F.array(F.lit(number), i)).alias("path"), m.alias("node")))


def walk(schemas: DataFrame) -> DataFrame:
    """cid, path, position, property, node (JSON text) of the properties of a schema and of all schemas in its combinators, however deep.

    One round opens one level of all schemas: the members of a level's combinators are the next one, until a level has none.
    ``path`` has the number of the combinator and of the member for each step down, so ascending (path, position) is the order
    of a search that looks at a schema's own properties first, then at each member with all that is in it.
    """
    level = schemas.select("cid", F.array().cast("array<int>").alias("path"), F.col("schema").alias("node"))
    found = []
    while True:
        parsed = level.select("cid", "path", F.from_json("node", NODE).alias("s"))
        found.append(stored(parsed.select("cid", "path", F.posexplode("s.properties").alias("position", "property", "node")), "properties"))
        level = stored(parsed.select("cid", F.explode(F.concat(*(_members(k, c) for k, c in enumerate(COMBINATORS)))).alias("m")).select("cid", "m.path", "m.node"), "level")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, found)


def _first(schemas: DataFrame, name: str) -> DataFrame:
    """cid, property, p (what is known of it) of the first property of that name, in any case, in each schema that has one."""
    hit = walk(schemas).where(F.lower(F.trim("property")) == name.strip().lower())
    first = hit.groupBy("cid").agg(F.min_by(F.struct("property", F.from_json("node", PROPERTY).alias("p")), F.struct("path", "position")).alias("hit"))
    return first.select("cid", "hit.property", "hit.p")


def property_schema(schemas: DataFrame, name: str) -> DataFrame:
    """cid, property, deprecated, enum of the first property of that name, in any case, own properties first; combinators are followed at any depth."""
    return _first(schemas, name).select("cid", "property", F.coalesce("p.deprecated", F.lit(False)).alias("deprecated"), F.array_join("p.enum", ",").alias("enum"))


def property_answer(schemas: DataFrame, name: str) -> DataFrame:
    """cid, property, enum, error for every schema: a property that no node has, or a deprecated one, is an error.

    ``property_type``, spelled so, has fixed values; values that the property calls deprecated, in a list or as keys, are left out.
    """
    out = schemas.select("cid").join(_first(schemas, name), "cid", "left")
    values = F.when(F.col("property") == "property_type", F.array(*map(F.lit, PROPERTY_TYPES))).otherwise(F.col("p.enum"))
    out = out.withColumns({"v": values, "d": F.from_json("p.deprecated_enum_values", "array<string>"), "m": F.from_json("p.deprecated_enum_values", "map<string, string>")})
    error = F.when(F.col("property").isNull(), "not found").when(F.col("p.deprecated"), "deprecated")
    return out.select("cid", "property", F.when(error.isNull() & F.col("v").isNotNull(), F.array_join(enum_filter("v", "d", "m"), ",")).alias("enum"), error.alias("error"))


def enum_filter(values: str, deprecated_list: str, deprecated_map: str) -> Column:
    """Enumeration values without those that a list, or the keys of an object, call deprecated; order stays."""
    barred = F.concat(F.coalesce(F.col(deprecated_list), F.array().cast("array<string>")), F.coalesce(F.map_keys(deprecated_map), F.array().cast("array<string>")))
    return F.array_except(values, barred)
