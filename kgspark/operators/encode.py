"""Dictionaries of nodes, relations and qualified predicates; encoding by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import qualifier_json
from kgspark.operators.filters import TREATS
from kgspark.operators.ranking import global_rank

QUALIFIERS = ["subject_aspect_qualifier", "subject_direction_qualifier", "object_aspect_qualifier", "object_direction_qualifier"]


def edge_map(edges: DataFrame, position: str = "pos") -> DataFrame:
    """predicate_id, predicate and qualifiers: numbered in order of first appearance.  Distinct qualified
    predicates are few (a vocabulary), so ranking them is cheap."""
    keys = ["predicate", *QUALIFIERS]
    plain = edges.select(position, "predicate", *[F.coalesce(q, F.lit("")).alias(q) for q in QUALIFIERS])
    seen = plain.groupBy(*keys).agg(F.min(position).alias("__first"))
    return global_rank(seen, "__first", *keys, name="__n").select(F.concat(F.lit("predicate:"), (F.col("__n") - 1).cast("string")).alias("predicate_id"), *keys)


def edge_map_json(mapping: DataFrame) -> DataFrame:
    return mapping.select(qualifier_json("predicate", "subject_aspect_qualifier", "subject_direction_qualifier", "object_aspect_qualifier", "object_direction_qualifier").alias("key"), "predicate_id")


def translate(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges as triples with predicate ids."""
    plain = edges.withColumns({q: F.coalesce(q, F.lit("")) for q in QUALIFIERS})
    return plain.join(mapping, ["predicate", *QUALIFIERS]).select(F.col("subject").alias("head"), F.col("predicate_id").alias("relation"), F.col("object").alias("tail"))


def treats_ids(mapping: DataFrame) -> DataFrame:
    """Predicate ids of treats, the one without qualifiers marked."""
    bare = F.lit(True)
    for q in QUALIFIERS:
        bare = bare & (F.col(q) == "")
    return mapping.filter(F.col("predicate") == TREATS).select("predicate_id", bare.alias("unqualified"))


def dictionary(values: DataFrame, name: str = "label") -> DataFrame:
    """label, idx: distinct values numbered from 0 in code-point order."""
    distinct = values.select(F.col(values.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct()
    return global_rank(distinct, name, name="__n").select(name, (F.col("__n") - 1).alias("idx"))


def node_dict(triples: DataFrame) -> DataFrame:
    return dictionary(triples.select(F.explode(F.array("head", "tail")).alias("label")))


def rel_dict(triples: DataFrame) -> DataFrame:
    return dictionary(triples.select("relation"))


def node_names(nodes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """name, idx with the identifier where a name is missing; tabs and line ends become blanks."""
    named = nodes.filter((F.col("id") != "") & (F.col("name") != "")).groupBy("id").agg(F.max("name").alias("__name"))
    out = dictionary.join(named, dictionary["label"] == named["id"], "left")
    return out.select(F.translate(F.coalesce("__name", "label"), "\t\n\r", "   ").alias("name"), "idx")


def validate_dicts(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """One row of counts: sizes, indices on one side only, repeated indices and names."""
    a = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("idx").alias("node_indices"))
    b = names.agg(F.count("*").alias("names"), F.countDistinct("idx").alias("name_indices"), (F.count("*") - F.countDistinct("name")).alias("repeated_names"))
    only = nodes.select("idx").distinct().withColumn("__a", F.lit(1)).join(names.select("idx").distinct().withColumn("__b", F.lit(1)), "idx", "full")
    c = only.agg(F.count_if(F.col("__b").isNull()).alias("only_nodes"), F.count_if(F.col("__a").isNull()).alias("only_names"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # one row each


def encode(triples: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples as numbers; those with an unknown part are dropped."""
    h = nodes.select(F.col("label").alias("head"), F.col("idx").alias("h"))
    r = relations.select(F.col("label").alias("relation"), F.col("idx").alias("r"))
    t = nodes.select(F.col("label").alias("tail"), F.col("idx").alias("t"))
    return triples.join(h, "head").join(r, "relation").join(t, "tail").select("h", "r", "t")


def unknown_labels(triples: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, label of what the dictionaries lack."""
    ends = triples.select(F.explode(F.array("head", "tail")).alias("label")).distinct().join(nodes, "label", "left_anti").select(F.lit("entity").alias("kind"), "label")
    return ends.unionByName(triples.select(F.col("relation").alias("label")).distinct().join(relations, "label", "left_anti").select(F.lit("relation").alias("kind"), "label"))


def decode(numbers: DataFrame, nodes: DataFrame, column: str, name: str) -> DataFrame:
    """numbers with the label of an index column, UNKNOWN_<index> where there is none."""
    d = nodes.select(F.col("idx").alias(column), F.col("label").alias("__l"))
    return numbers.join(d, column, "left").withColumn(name, F.coalesce("__l", F.concat(F.lit("UNKNOWN_"), F.col(column).cast("string")))).drop("__l")


def resolve(curies: DataFrame, nodes: DataFrame, column: str = "curie") -> DataFrame:
    """curies with preferred: itself if it is a node, else the node it is a synonym of, else 'not exist'."""
    ids = nodes.select(F.col("id").alias(column), F.col("id").alias("__id")).distinct()
    other = nodes.select(F.explode("equivalent_identifiers").alias(column), "id").filter(F.col(column) != F.col("id")).groupBy(column).agg(F.max("id").alias("__primary"))
    return curies.join(ids, column, "left").join(other, column, "left").withColumn("preferred", F.coalesce("__id", "__primary", F.lit("not exist"))).drop("__id", "__primary")
