"""The knowledge graph that the relational tables stand for, written once in SQL that Spark and DuckDB share.

Customers are chemicals, parts diseases, suppliers genes, nations anatomy; lineitem and orders give edges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.splits import sample_fraction

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # one row a line: customer - part (treats at high quantities), part - supplier
    "edges": """
SELECT l_orderkey * 10 + l_linenumber AS pos,
       'C:' || CAST(o_custkey AS STRING) AS subject,
       CASE WHEN l_quantity >= 49 THEN 'biolink:treats' WHEN l_quantity >= 25 THEN 'biolink:affects' ELSE 'biolink:related_to' END AS predicate,
       'P:' || CAST(l_partkey AS STRING) AS object,
       CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'infores:drugmechdb' WHEN '2' THEN 'infores:tiga' WHEN '3' THEN 'infores:bindingdb' WHEN '4' THEN 'infores:drugcentral' ELSE 'infores:zfin' END AS primary_knowledge_source,
       '' AS subject_aspect_qualifier, '' AS subject_direction_qualifier,
       CASE WHEN l_linestatus = 'O' THEN 'activity' ELSE '' END AS object_aspect_qualifier,
       CASE l_returnflag WHEN 'A' THEN 'increased' WHEN 'R' THEN 'decreased' ELSE '' END AS object_direction_qualifier,
       CASE WHEN l_linenumber = 1 THEN 'n/a' WHEN l_linenumber = 2 THEN CAST(NULL AS STRING) ELSE CAST(CAST(ROUND(l_discount * 100) AS INT) AS STRING) END AS affinity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT 1000000000000 + l_orderkey * 10 + l_linenumber, 'P:' || CAST(l_partkey AS STRING),
       CASE WHEN l_returnflag = 'R' THEN 'biolink:subclass_of' ELSE 'biolink:affects' END,
       'S:' || CAST(l_suppkey AS STRING), 'infores:bindingdb', 'abundance', '', '', '', CAST(CAST(ROUND(l_tax * 100) AS INT) AS STRING)
FROM lineitem WHERE l_quantity <= 2
UNION ALL
SELECT 2000000000000 + s_suppkey, 'S:' || CAST(s_suppkey AS STRING), 'biolink:in_taxon', 'N:' || CAST(s_nationkey AS STRING), 'infores:ctd', '', '', '', '', CAST(NULL AS STRING)
FROM supplier
UNION ALL
SELECT 3000000000000 + a.n_nationkey * 100 + b.n_nationkey, CASE WHEN a.n_nationkey % 2 = 0 THEN 'REACT:R-HSA-' ELSE 'REACT:R-MMU-' END || CAST(a.n_nationkey AS STRING), 'biolink:occurs_in', 'N:' || CAST(b.n_nationkey AS STRING), 'infores:reactome', '', '', '', '', CAST(NULL AS STRING)
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey
UNION ALL
SELECT 4000000000000 + n_nationkey, 'NCIT:C' || CAST(n_nationkey AS STRING), 'biolink:subclass_of', CASE WHEN n_regionkey < 3 THEN 'NCIT:R' ELSE 'CAID:R' END || CAST(n_regionkey AS STRING), 'infores:ncit', '', '', '', '', CAST(NULL AS STRING)
FROM nation
UNION ALL
SELECT 5000000000000 + c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CAID:' ELSE 'C:' END || CAST(c_custkey AS STRING), 'biolink:interacts_with', 'C:' || CAST(c_nationkey + 1 AS STRING), 'infores:mgi', '', '', '', '', CAST(NULL AS STRING)
FROM customer
UNION ALL
SELECT 6000000000000 + p_partkey, 'P:' || CAST(p_partkey AS STRING), 'biolink:subclass_of', 'P:' || CAST(p_size AS STRING), 'infores:mondo', '', '', '', '', CAST(NULL AS STRING)
FROM part
UNION ALL
SELECT 7000000000000 + s_suppkey, 'S:' || CAST(s_suppkey AS STRING), 'biolink:regulates', 'S:' || CAST(s_nationkey + 1 AS STRING), 'infores:sgd', '', '', '', '', CAST(NULL AS STRING)
FROM supplier""",
    "nodes": """
SELECT 'C:' || CAST(c_custkey AS STRING) AS id, c_name AS name, 'biolink:ChemicalEntity' AS c1, CAST(NULL AS STRING) AS c2, 'CUST:' || CAST(c_custkey AS STRING) AS synonym FROM customer
UNION ALL SELECT 'P:' || CAST(p_partkey AS STRING), p_name, 'biolink:DiseaseOrPhenotypicFeature', CAST(NULL AS STRING), 'PART:' || CAST(p_partkey AS STRING) FROM part
UNION ALL SELECT 'S:' || CAST(s_suppkey AS STRING), CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END, 'biolink:GeneOrGeneProduct', CASE WHEN s_nationkey < 15 THEN 'biolink:Gene' END, 'SUPP:' || CAST(s_suppkey AS STRING) FROM supplier
UNION ALL SELECT 'N:' || CAST(n_nationkey AS STRING), n_name, 'biolink:AnatomicalEntity', CAST(NULL AS STRING), 'NATION:' || CAST(n_nationkey AS STRING) FROM nation""",
    # a sparse graph for traversal
    "treats": """
SELECT DISTINCT 'C:' || CAST(o_custkey AS STRING) AS head, 'biolink:treats' AS relation, 'P:' || CAST(l_partkey AS STRING) AS tail
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49""",
    "triples": """
SELECT head, relation, tail FROM treats
UNION ALL SELECT DISTINCT 'P:' || CAST(l_partkey AS STRING), CASE WHEN l_returnflag = 'R' THEN 'biolink:affects' ELSE 'biolink:caused_by' END, 'S:' || CAST(l_suppkey AS STRING) FROM lineitem WHERE l_quantity <= 2
UNION ALL SELECT 'S:' || CAST(s_suppkey AS STRING), 'biolink:in_taxon', 'N:' || CAST(s_nationkey AS STRING) FROM supplier""",
    # every line as a triple: the dense graph, with hubs
    "all_triples": """
SELECT DISTINCT 'C:' || CAST(o_custkey AS STRING) AS head, CASE WHEN l_quantity >= 49 THEN 'biolink:treats' WHEN l_quantity >= 25 THEN 'biolink:affects' ELSE 'biolink:related_to' END AS relation, 'P:' || CAST(l_partkey AS STRING) AS tail
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'P:' || CAST(l_partkey AS STRING), CASE WHEN l_returnflag = 'R' THEN 'biolink:affects' ELSE 'biolink:caused_by' END, 'S:' || CAST(l_suppkey AS STRING) FROM lineitem
UNION ALL SELECT 'S:' || CAST(s_suppkey AS STRING), 'biolink:in_taxon', 'N:' || CAST(s_nationkey AS STRING) FROM supplier""",
    # a multiset of triples with scores
    "ev": """
SELECT event_id, 'U:' || CAST(user_id AS STRING) AS head, event_type AS relation, 'K:' || SUBSTRING(props, 7, LENGTH(props) - 7) AS tail, value FROM events""",
    "scores": """
SELECT head, tail, ROUND(AVG(value), 6) AS score, MAX(CASE WHEN relation = 'purchase' THEN 1 ELSE 0 END) AS is_treat FROM ev GROUP BY head, tail""",
    # the hundredth part of treats, by a hash order, is what shall be explained
    "tests": """
SELECT head || '|' || tail AS test_id, head, relation, tail FROM (
  SELECT head, relation, tail, ROW_NUMBER() OVER (ORDER BY MD5('42|' || head || '|' || relation || '|' || tail), head, tail) AS n, COUNT(*) OVER () AS total FROM treats) x
WHERE n <= FLOOR(total * 0.01)""",
    # customer - supplier pairs: the longest-known supplier of what the customer takes
    "distant": """
SELECT t.test_id, t.head, MIN(s.tail) AS tail FROM tests t JOIN triples s ON t.tail = s.head GROUP BY t.test_id, t.head""",
    # training edges that touch a test edge, or the test edge's neighbours, with influence: joins on one node each
    "near": """
SELECT DISTINCT f.test_id, f.test_head, f.test_tail, n.head, n.relation, n.tail FROM (
  SELECT DISTINCT e.test_id, e.test_head, e.test_tail, k.b FROM (
    SELECT test_id, head AS test_head, tail AS test_tail, head AS node FROM tests UNION SELECT test_id, head, tail, tail FROM tests) e
  JOIN (SELECT head AS a, tail AS b FROM triples UNION SELECT tail, head FROM triples) k ON k.a = e.node) f
JOIN (SELECT head AS node, head, relation, tail FROM triples UNION ALL SELECT tail, head, relation, tail FROM triples) n ON n.node = f.b""",
    "influence": """
SELECT test_id, test_head AS TestHead, test_tail AS TestTail, head AS TrainHead, relation AS TrainRel_label, tail AS TrainTail,
  ROUND(CAST((LENGTH(REPLACE(MD5(test_id || head || relation || tail), 'a', '')) - 30) * 50 + ASCII(MD5(tail || test_id || head)) AS DOUBLE) / 100, 6) AS TracInScore,
  ROUND(CAST(ASCII(MD5(head || tail || relation)) AS DOUBLE) / 100, 6) AS SelfInfluence
FROM near""",
    "truth": """
SELECT DISTINCT subject, predicate, object FROM edges WHERE primary_knowledge_source = 'infores:drugmechdb'""",
    # intermediates of a pair: suppliers and nations behind the part, as members of one path
    "members": """
SELECT test_id AS path_id, test_head AS drug, test_tail AS disease, head AS node FROM near UNION SELECT test_id, test_head, test_tail, tail FROM near""",
}

#: What each view reads besides tables.
NEEDS = {"triples": ["treats"], "scores": ["ev"], "tests": ["treats"], "distant": ["tests", "triples"], "near": ["tests", "triples"], "influence": ["near"], "truth": ["edges"], "members": ["near"]}


def with_needs(names: list[str]) -> list[str]:
    """The views in an order in which each comes after what it reads."""
    out: list[str] = []
    for n in names:
        out += [x for x in [*with_needs(NEEDS.get(n, [])), n] if x not in out]
    return out


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it names in front."""
    parts = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in with_needs(list(names)))
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts},\n{sql[len('WITH RECURSIVE'):]}"
    if sql.upper().startswith("WITH "):
        return f"WITH RECURSIVE {parts},\n{sql[len('WITH '):]}"
    return f"WITH {parts}\n{sql}"


def view(spark: SparkSession, sf_dir: str, name: str, read: dict[str, DataFrame] | None = None, sql: str | None = None) -> DataFrame:
    """A table or a view over the tables of a folder, each view a frame of its own; `read` holds those that a query
    has already asked for, sql what to take instead of the view's text.  The test sample is taken by the sampling operator, which ranks in ranges; the SQL
    form, for the oracle, ranks in one window."""
    read = {} if read is None else read

    def get(n: str) -> DataFrame:
        if n not in read:
            read[n] = view(spark, sf_dir, n, read)
        return read[n]

    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "tests":
        picked = sample_fraction(get("treats"), 0.01)
        return picked.select(F.concat_ws("|", "head", "tail").alias("test_id"), "head", "relation", "tail").persist()
    if name == "all_links":
        # the pairs of all_triples for traversal, which takes neighbours as sets: repeats are left in, as each DISTINCT moves all rows
        pairs = view(spark, sf_dir, "all_triples", read, VIEWS["all_triples"].replace("SELECT DISTINCT", "SELECT"))
        return pairs.select("head", "tail")
    sql = VIEWS[name] if sql is None else sql
    known = {n for n in re.findall(r"\b(?:FROM|JOIN) (\w+)", sql) if n in VIEWS or n in TABLES}
    text = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in known else m[0], sql)
    found = spark.sql(text, **{n: get(n) for n in known})
    return found.persist() if name == "near" else found  # read many times by one query
