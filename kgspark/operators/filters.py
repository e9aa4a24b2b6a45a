"""Edge filters: styles by predicate and category, the baseline rule chain, degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import species

# Predicates, categories, sources and thresholds of the filter styles.
TREATS = "biolink:treats"
SUBCLASS = "biolink:subclass_of"
CHEMICAL = "biolink:ChemicalEntity"
DISEASE = "biolink:DiseaseOrPhenotypicFeature"
GENE = "biolink:Gene"
PRODUCT = "biolink:GeneOrGeneProduct"
DROPPED_PREDICATES = ["biolink:in_taxon", "biolink:related_to", "biolink:expressed_in", "biolink:located_in", "biolink:temporally_related_to"]
DROPPED_SOURCES = ["infores:text-mining-provider-targeted", "infores:zfin", "infores:tiga", "infores:flybase", "infores:sgd", "infores:rgd", "infores:mgi"]
LEAST_AFFINITY = 7.0
# Category pairs in either direction that a style accepts, and what it does before looking at them.
PAIRS = {
    "cd": [(CHEMICAL, DISEASE), (CHEMICAL, CHEMICAL), (DISEASE, DISEASE)],
    "ccggdd": [(CHEMICAL, DISEASE), (CHEMICAL, CHEMICAL), (CHEMICAL, GENE), (GENE, GENE), (DISEASE, DISEASE), (GENE, DISEASE)],
    "cggd": [(CHEMICAL, DISEASE), (CHEMICAL, GENE), (GENE, GENE), (GENE, DISEASE)],
    "cggd_alltreat": [(CHEMICAL, DISEASE), (CHEMICAL, PRODUCT), (PRODUCT, PRODUCT), (PRODUCT, DISEASE)],
    "cggd_minus": [(CHEMICAL, PRODUCT), (PRODUCT, PRODUCT), (PRODUCT, DISEASE)],
    "ccggdd_alltreat": [(CHEMICAL, DISEASE), (CHEMICAL, CHEMICAL), (CHEMICAL, PRODUCT), (PRODUCT, PRODUCT), (DISEASE, DISEASE), (PRODUCT, DISEASE)],
}
DROP_SUBCLASS_FIRST = {"ccggdd", "cggd"}


#: A bit for each category that a style asks for.
BIT = {c: 1 << i for i, c in enumerate((CHEMICAL, DISEASE, GENE, PRODUCT))}


def categories_of(nodes: DataFrame) -> DataFrame:
    """__id, __c: the categories of each node as bits."""
    bits = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.array_contains("category", c), F.lit(bit)).otherwise(F.lit(0)) for c, bit in BIT.items()])
    return nodes.select(F.col("id").alias("__id"), bits.alias("__c")).groupBy("__id").agg(F.bit_or("__c").alias("__c"))


def with_types(edges: DataFrame, nodes: DataFrame, style: str | None = None) -> DataFrame:
    """edges with __s and __o, the categories of both ends as bits (0 for unknown nodes).  With a style, edges that their subject rules out don't travel to their object."""
    types = categories_of(nodes)
    none = F.lit(0)
    s = types.select(F.col("__id").alias("subject"), F.col("__c").alias("__s"))
    o = types.select(F.col("__id").alias("object"), F.col("__c").alias("__o"))
    half = edges.join(s, "subject", "left").withColumn("__s", F.coalesce("__s", none))
    if style in PAIRS:
        some = F.col("__s").bitwiseAND(F.lit(sum(BIT[c] for c in {c for pair in PAIRS[style] for c in pair}))) != 0
        half = half.filter(some if style in DROP_SUBCLASS_FIRST else (F.col("predicate") == TREATS) | some)
    return half.join(o, "object", "left").withColumn("__o", F.coalesce("__o", none))


def pair_of(pairs: list[tuple[str, str]]) -> Column:
    """Have the two ends one of the category pairs, in either direction?"""

    def has(side: str, c: str) -> Column:
        return F.col(side).bitwiseAND(F.lit(BIT[c])) != 0

    def either(a: str, b: str) -> Column:
        one = has("__s", a) & has("__o", b)
        return one if a == b else one | (has("__s", b) & has("__o", a))

    return reduce(lambda x, y: x | y, [either(a, b) for a, b in pairs])


def keep(style: str) -> Column:
    """The condition under which a style keeps an edge of with_types()."""
    predicate = F.col("predicate")
    if style == "keepall":
        return F.lit(True)
    if style == "original":
        return (predicate != SUBCLASS) & ~F.col("subject").startswith("CAID")
    if style == "rcd":
        return ~pair_of([(CHEMICAL, DISEASE)])
    if style in DROP_SUBCLASS_FIRST:
        return (predicate != SUBCLASS) & pair_of(PAIRS[style])
    return (predicate == TREATS) | pair_of(PAIRS[style])


STYLES = ["original", "cd", "rcd", "ccggdd", "cggd", "cggd_alltreat", "cggd_minus", "ccggdd_alltreat", "keepall"]


def style_filter(edges: DataFrame, nodes: DataFrame, style: str) -> DataFrame:
    if style in ("original", "keepall"):  # these look at no categories
        return edges.filter(keep(style))
    return with_types(edges, nodes, style).filter(keep(style)).select(edges.columns)


def endpoints(edges: DataFrame, head: str = "subject", tail: str = "object") -> DataFrame:
    """One row for each end of each edge."""
    return edges.select(F.explode(F.array(head, tail)).alias("node"))


def treats_nodes(edges: DataFrame) -> DataFrame:
    return endpoints(edges.filter(F.col("predicate") == TREATS)).distinct()


def baseline_reason(edges: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """edges with reason: the first rule of the baseline chain that decides each edge."""
    if protected is not None:
        p = protected.select(F.col("node"), F.lit(True).alias("__p"))
        edges = edges.join(p.withColumnsRenamed({"node": "subject", "__p": "__ps"}), "subject", "left").join(p.withColumnsRenamed({"node": "object", "__p": "__po"}), "object", "left")
        safe = F.coalesce("__ps", "__po", F.lit(False))
    else:
        safe = F.lit(False)
    predicate, source = F.col("predicate"), F.coalesce("primary_knowledge_source", F.lit(""))

    def foreign(c: str) -> Column:
        return F.col(c).startswith("REACT:") & F.coalesce(species(c) != "HSA", F.lit(False))

    weak = F.coalesce(F.expr("try_cast(affinity AS double)") < LEAST_AFFINITY, F.lit(False))
    reason = (
        F.when(predicate == TREATS, "kept_treats")
        .when(safe, "kept_treats_node")
        .when(foreign("subject") | foreign("object"), "non_human_pathway")
        .when((predicate == "biolink:affects") & (source == "infores:bindingdb") & weak, "low_affinity")
        .when((predicate == SUBCLASS) & F.col("subject").startswith("NCIT:") & F.col("object").startswith("NCIT:"), "ncit_subclass")
        .when(predicate.isin(DROPPED_PREDICATES), "predicate")
        .when(source.isin(DROPPED_SOURCES), "source")
        .otherwise("kept")
    )
    return edges.withColumn("reason", reason).drop("__ps", "__po")


def baseline_edges(edges: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    return baseline_reason(edges, protected).filter(F.col("reason").startswith("kept")).drop("reason")


def degrees(edges: DataFrame, head: str = "subject", tail: str = "object") -> DataFrame:
    """node, degree: occurrences as an end (a loop counts twice)."""
    return endpoints(edges, head, tail).groupBy("node").agg(F.count("*").alias("degree"))


def low_degree_nodes(edges: DataFrame, min_degree: int = 2, protected: DataFrame | None = None) -> DataFrame:
    low = degrees(edges).filter(F.col("degree") < min_degree).select("node")
    return low if protected is None else low.join(protected, "node", "left_anti")


def low_degree_filter(edges: DataFrame, min_degree: int = 2, protected: DataFrame | None = None) -> DataFrame:
    """Edges without a low-degree end; a single pass, degrees are those before it."""
    low = low_degree_nodes(edges, min_degree, protected)
    return edges.join(low.withColumnRenamed("node", "subject"), "subject", "left_anti").join(low.withColumnRenamed("node", "object"), "object", "left_anti")


def edges_of_source(edges: DataFrame, source: str = "infores:drugmechdb") -> DataFrame:
    """Edges of one knowledge source with all three parts given."""
    full = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in ("subject", "predicate", "object")])
    return edges.filter((F.col("primary_knowledge_source") == source) & full)


def above_self_influence(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("TracInScore") >= F.col("SelfInfluence"))


def touching(scores: DataFrame, drugs: DataFrame, diseases: DataFrame, drug: str, disease: str, flag: str) -> DataFrame:
    """Score rows whose drug or disease is a test one, or that carry the flag."""
    d = drugs.select(F.col(drugs.columns[0]).alias(drug), F.lit(True).alias("__d")).distinct()
    s = diseases.select(F.col(diseases.columns[0]).alias(disease), F.lit(True).alias("__s")).distinct()
    return scores.join(d, drug, "left").join(s, disease, "left").filter(F.coalesce("__d", "__s", F.col(flag), F.lit(False))).select(scores.columns)
