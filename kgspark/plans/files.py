"""Queries that go through files: each writes its rows with a writer into the shared folder and returns what the
reader makes of them; and views and reports of the tables that files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import scalars as X
from kgspark.operators import adapters, aggregates, encode, graph, score
from kgspark.plans.queries import DOT, ORACLE, QUERIES, UND, emb, influence_links, khop_sql, nodes_of, paths_sql, query, type_sql
from kgspark.sources import readers, writers
from kgspark.sources.staging import new_path

__all__ = ["ORACLE", "QUERIES"]


def written(df: DataFrame, write, name: str, *args) -> tuple:
    """(session, folder) after writing df there."""
    path = new_path(df.sparkSession, name)
    write(df, path, *args)
    return df.sparkSession, path


@query("SELECT id, name, c1 AS first_category, synonym FROM nodes", "nodes")
def file_nodes(v):
    n = readers.nodes(*written(nodes_of(v), writers.json_lines, "nodes"))
    return n.select("id", "name", F.get("category", F.lit(0)).alias("first_category"), F.get("equivalent_identifiers", F.lit(0)).alias("synonym"))


@query("SELECT subject, predicate, object, primary_knowledge_source, object_aspect_qualifier, affinity FROM edges", "edges")
def file_edges(v):
    """Gzipped JSON lines."""
    e = v("edges").select([f.name for f in readers.EDGES if f.name in v("edges").columns])
    return readers.edges(*written(e, writers.json_lines, "edges", "gzip")).select("subject", "predicate", "object", "primary_knowledge_source", "object_aspect_qualifier", "affinity")


@query("SELECT head, relation, tail FROM triples", "triples")
def file_triples(v):
    return readers.triples(*written(v("triples"), writers.triples, "triples"))


@query("SELECT DISTINCT head, relation, tail FROM treats", "treats")
def file_treats(v):
    """With a header that the reader leaves out."""
    t = v("treats").select(F.col("head").alias("Drug"), F.col("relation").alias("Relation"), F.col("tail").alias("Disease"))
    return readers.treats_pairs(*written(t, writers.csv, "treats", "\t")).distinct()


@query()
def file_edge_map(v):
    keys = encode.edge_map_json(encode.edge_map(v("edges")))
    read = readers.edge_map(*written(keys, writers.edge_map, "edge-map"))
    return read.select("predicate_id", X.qualifier_json("predicate", *encode.QUALIFIERS).alias("key"))


ORACLE["file_edge_map"] = ORACLE["edge_map"]


@query()
def file_dictionary(v):
    """label and number, tab-separated."""
    return readers.dictionary(*written(encode.node_dict(v("triples")).select("label", "idx"), writers.plain, "dictionary"))


ORACLE["file_dictionary"] = ORACLE["node_dict"]


@query("SELECT drug, disease, path_id, COUNT(DISTINCT node) AS nodes, MIN(node) AS first FROM members GROUP BY drug, disease, path_id", "members")
def file_paths(v):
    p = v("members").groupBy("drug", "disease", "path_id").agg(F.collect_set("node").alias("nodes"))
    read = readers.mechanistic_paths(*written(p, writers.paths, "paths"))
    return read.select("drug", "disease", "path_id", F.size("nodes").cast("long").alias("nodes"), F.array_min("nodes").alias("first"))


NAMED = "(SELECT id, MAX(name) AS name FROM nodes WHERE name <> '' GROUP BY id)"


@query(
    f"SELECT TestHead, COALESCE(a.name, 'UNKNOWN_' || TestHead) AS TestHead_label, 'biolink:treats' AS TestRel, 'UNKNOWN_biolink:treats' AS TestRel_label, TestTail, COALESCE(b.name, 'UNKNOWN_' || TestTail) AS TestTail_label, TrainHead, COALESCE(c.name, 'UNKNOWN_' || TrainHead) AS TrainHead_label, TrainRel_label AS TrainRel, TrainRel_label, TrainTail, COALESCE(d.name, 'UNKNOWN_' || TrainTail) AS TrainTail_label, TracInScore, SelfInfluence FROM influence LEFT JOIN {NAMED} a ON a.id = TestHead LEFT JOIN {NAMED} b ON b.id = TestTail LEFT JOIN {NAMED} c ON c.id = TrainHead LEFT JOIN {NAMED} d ON d.id = TrainTail",
    "influence",
    "nodes",
)
def file_influence(v):
    """The fourteen columns of an influence file, with labels."""
    rows = v("influence").withColumns({"TestRel": F.lit("biolink:treats"), "TrainRel": F.col("TrainRel_label")})
    names = v("nodes").filter("name <> ''").groupBy("id").agg(F.max("name").alias("name"))
    for side in ("TestHead", "TestTail", "TrainHead", "TrainTail"):
        rows = rows.join(names.select(F.col("id").alias(side), F.col("name").alias(f"{side}_label")), side, "left")
    return readers.influence(*written(rows, writers.influence, "influence"))


@query("SELECT head, tail, PRINTF('%.6f', score) AS score FROM scores", "scores")
def file_scores(v):
    return readers.csv(*written(v("scores").select("head", "tail", "score"), writers.scores, "scores"))


@query("SELECT COUNT(*) AS n, ROUND(SUM(score), 4) AS total FROM scores", "scores")
def file_many(v):
    """All files below a folder."""
    s = v("scores").select("head", "tail", "score")
    path = new_path(s.sparkSession, "many")
    for name, part in (("high", s.filter("score >= 60")), ("low", s.filter("score < 60"))):
        writers.csv(part, f"{path}/{name}")
    return readers.many_csv(s.sparkSession, path).agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("double")), 4).alias("total"))


@query("SELECT n.name, MIN(l.id) AS name_CURIE FROM (SELECT DISTINCT name FROM nodes) n LEFT JOIN (SELECT LOWER(name) AS k, id FROM nodes UNION ALL SELECT LOWER(synonym), id FROM nodes) l ON l.k = LOWER(TRIM(n.name)) GROUP BY n.name", "nodes")
def resolved_names(v):
    return readers.resolve_names(v("nodes").select("name").distinct(), readers.synonyms(nodes_of(v)), "name")


# ---- views and reports ---------------------------------------------------------------------------------------------


@query("SELECT test_id, TrainHead AS source, TrainTail AS target, TrainRel_label AS relation, TracInScore AS score FROM influence UNION ALL SELECT DISTINCT test_id, TestHead, TestTail, 'biolink:treats', CAST(NULL AS DOUBLE) FROM influence", "influence")
def graph_links(v):
    """The links of an influence table, the test edge among them without a score."""
    return adapters.graph_links(v("influence").withColumn("TestRel_label", F.lit("biolink:treats")))


@query("SELECT test_id, node, CAST(MAX(t) AS INT) AS is_test FROM (SELECT test_id, UNNEST([TrainHead, TrainTail]) AS node, 0 AS t FROM influence UNION ALL SELECT test_id, UNNEST([TestHead, TestTail]), 1 FROM influence) x GROUP BY test_id, node", "influence")
def graph_nodes(v):
    return adapters.graph_nodes(v("influence"))


@query("SELECT subject, object, FIRST(predicate ORDER BY pos DESC, predicate DESC) AS predicate, COUNT(*) AS edges FROM edges GROUP BY subject, object", "edges")
def edge_attributes(v):
    """Of several edges of a pair the last one names it."""
    return v("edges").groupBy("subject", "object").agg(F.max(F.struct("pos", "predicate")).getField("predicate").alias("predicate"), F.count("*").alias("edges"))


@query("SELECT subject, predicate, object, COALESCE(primary_knowledge_source, 'unknown') AS source FROM edges WHERE predicate = 'biolink:treats'", "edges")
def treats_with_source(v):
    """Repeats stay."""
    return v("edges").filter("predicate = 'biolink:treats'").select("subject", "predicate", "object", F.coalesce("primary_knowledge_source", F.lit("unknown")).alias("source"))


@query("SELECT COUNT(*) AS paths, COUNT(DISTINCT drug || '|' || disease) AS pairs, ROUND(AVG(n), 6) AS mean_nodes, MIN(n) AS least_nodes, MAX(n) AS most_nodes FROM (SELECT path_id, MIN(drug) AS drug, MIN(disease) AS disease, COUNT(DISTINCT node) + 2 AS n FROM members GROUP BY path_id) x", "members")
def path_summary(v):
    return aggregates.path_summary(v("members"))


@query(khop_sql(True, 2, ", s AS (SELECT array_to_string(relations, ' | ') AS relations, COUNT(*) AS paths FROM found GROUP BY 1) SELECT relations, paths, CAST(ROW_NUMBER() OVER (ORDER BY paths DESC, relations) AS INT) AS rank FROM s QUALIFY rank <= 10"), "influence", "distant")
def predicate_sequences(v):
    return aggregates.frequent(graph.khop_paths(influence_links(v), v("distant"), 2).select(F.array_join("relations", " | ").alias("relations")), "relations", "paths", 10)


@query(khop_sql(False, 2, f", m AS (SELECT test_id, {type_sql('nodes[1]')} || list_aggregate(list_transform(range(1, len(relations) + 1), lambda i: ' -> ' || relations[i] || ' -> ' || {type_sql('nodes[i + 1]')}), 'string_agg', '') AS metapath FROM found WHERE connects), c AS (SELECT test_id, metapath, COUNT(*) AS paths, 100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY test_id) AS share FROM m GROUP BY test_id, metapath) SELECT test_id, CAST(ROW_NUMBER() OVER (PARTITION BY test_id ORDER BY paths DESC, metapath) AS INT) AS line, metapath || ': ' || CAST(paths AS VARCHAR) || ' (' || CAST(ROUND(ROUND(share, 6), 2) AS VARCHAR) || ' %)' AS text FROM c"), "influence", "distant")
def metapath_report(v):
    """Lines of a text report."""
    m = graph.metapaths(graph.khop_paths(influence_links(v), v("distant"), 2, directed=False, connecting=True))
    return aggregates.report_lines(m, ["test_id"], "metapath", "paths", "percentage")


@query(paths_sql("distant", 3, "SELECT test_id, array_to_string(nodes, '>') AS path FROM paths").replace(UND, "und AS (SELECT DISTINCT head AS a, tail AS b FROM triples)"), "triples", "distant")
def directed_paths(v):
    return graph.simple_paths(v("triples"), v("distant"), 3, directed=True).select("test_id", F.array_join("nodes", ">").alias("path"))


@query("SELECT COUNT(*) AS groups, CAST(COUNT_IF(n >= 20) AS BIGINT) AS large, ROUND(AVG(m), 6) AS mean_of_means, ROUND(MEDIAN(m), 6) AS median_of_means, MAX(n) AS most_rows FROM (SELECT test_id, COUNT(*) AS n, AVG(TracInScore) AS m FROM influence GROUP BY test_id) x", "influence")
def file_summary(v):
    """One row over the summaries of all result files."""
    return aggregates.summary_of_groups(v("influence"), ["test_id"], "TracInScore", 20)


@emb("topk_heads", f"SELECT tail, head, score, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS tail, e.vec_id AS head, ROUND({DOT.format('q.embedding', 'e.embedding')}, 6) AS score, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY ROUND({DOT.format('q.embedding', 'e.embedding')}, 6) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.label = 1) x WHERE rank <= 10")
def topk_heads(e):
    """The best heads of each tail: the inner product has no direction, so the tails ask."""
    asked = e.filter("label = 1").select(F.col("id").alias("query_id"), "vector")
    return score.best_tails(asked, e, 10).select(F.col("query_id").alias("tail"), F.col("tail").alias("head"), "score", "rank")

