"""Named queries: one for each operator family, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions import scalars as X
from kgspark.operators import aggregates, annotate, encode, filters, gradients, graph, influence, joins, metrics, score, splits, stats
from kgspark.operators import reach as reaching
from kgspark.operators.ranking import global_rank, hash_order, top_k
from kgspark.plans.views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Register a function (of a view reader) under its name, with its SQL over the named views."""

    def put(f):
        key = name or f.__name__

        def run(spark, sf_dir):
            read: dict[str, DataFrame] = {}
            return f(lambda v: read[v] if v in read else read.setdefault(v, view(spark, sf_dir, v, read)))

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = oracle(sql, *views)
        return f

    return put


def table(name: str):
    """A reader of one relational table."""
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes_of(v) -> DataFrame:
    n = v("nodes")
    return n.select("id", "name", F.array_compact(F.array("c1", "c2")).alias("category"), F.array("synonym").alias("equivalent_identifiers"))


# ---- filters ---------------------------------------------------------------------------------------

CATEGORY_SQL = {c: f"'{v}'" for c, v in {"C": filters.CHEMICAL, "D": filters.DISEASE, "G": filters.GENE, "P": filters.PRODUCT}.items()}
TYPED = "typed AS (SELECT e.*, LIST_FILTER([s.c1, s.c2], lambda x: x IS NOT NULL) AS st, LIST_FILTER([o.c1, o.c2], lambda x: x IS NOT NULL) AS ot FROM edges e LEFT JOIN nodes s ON s.id = e.subject LEFT JOIN nodes o ON o.id = e.object)"


def pairs_sql(pairs: str) -> str:
    one = "(list_contains(st, {0}) AND list_contains(ot, {1}) OR list_contains(st, {1}) AND list_contains(ot, {0}))"
    return "(" + " OR ".join(one.format(CATEGORY_SQL[p[0]], CATEGORY_SQL[p[1]]) for p in pairs.split()) + ")"


STYLE_SQL = {
    "original": "predicate <> 'biolink:subclass_of' AND subject NOT LIKE 'CAID%'",
    "keepall": "TRUE",
    "rcd": f"NOT {pairs_sql('CD')}",
    "cd": f"predicate = 'biolink:treats' OR {pairs_sql('CD CC DD')}",
    "ccggdd": f"predicate <> 'biolink:subclass_of' AND {pairs_sql('CD CC CG GG DD GD')}",
    "cggd": f"predicate <> 'biolink:subclass_of' AND {pairs_sql('CD CG GG GD')}",
    "cggd_alltreat": f"predicate = 'biolink:treats' OR {pairs_sql('CD CP PP PD')}",
    "cggd_minus": f"predicate = 'biolink:treats' OR {pairs_sql('CP PP PD')}",
    "ccggdd_alltreat": f"predicate = 'biolink:treats' OR {pairs_sql('CD CC CP PP DD PD')}",
}
for _style, _sql in STYLE_SQL.items():
    query(f"WITH {TYPED} SELECT pos, subject, predicate, object FROM typed WHERE COALESCE({_sql}, FALSE)", "edges", "nodes", name=f"style_filter_{_style}")(
        lambda v, style=_style: filters.style_filter(v("edges"), nodes_of(v), style).select("pos", "subject", "predicate", "object")
    )

REASON = """
tn AS (SELECT subject AS node FROM edges WHERE predicate = 'biolink:treats' UNION SELECT object FROM edges WHERE predicate = 'biolink:treats'),
reasoned AS (SELECT e.*, CASE WHEN predicate = 'biolink:treats' THEN 'kept_treats'
  WHEN {protect} THEN 'kept_treats_node'
  WHEN (subject LIKE 'REACT:%' AND split_part(subject, '-', 2) NOT IN ('HSA', '')) OR (object LIKE 'REACT:%' AND split_part(object, '-', 2) NOT IN ('HSA', '')) THEN 'non_human_pathway'
  WHEN predicate = 'biolink:affects' AND primary_knowledge_source = 'infores:bindingdb' AND TRY_CAST(affinity AS DOUBLE) < 7 THEN 'low_affinity'
  WHEN predicate = 'biolink:subclass_of' AND subject LIKE 'NCIT:%' AND object LIKE 'NCIT:%' THEN 'ncit_subclass'
  WHEN predicate IN ('biolink:in_taxon', 'biolink:related_to', 'biolink:expressed_in', 'biolink:located_in', 'biolink:temporally_related_to') THEN 'predicate'
  WHEN primary_knowledge_source IN ('infores:text-mining-provider-targeted', 'infores:zfin', 'infores:tiga', 'infores:flybase', 'infores:sgd', 'infores:rgd', 'infores:mgi') THEN 'source'
  ELSE 'kept' END AS reason FROM edges e)"""
PROTECT = "subject IN (SELECT node FROM tn) OR object IN (SELECT node FROM tn)"


@query(f"WITH {REASON.format(protect=PROTECT)} SELECT reason, COUNT(*) AS edges FROM reasoned GROUP BY reason", "edges")
def clean_baseline_reasons(v):
    e = v("edges")
    return filters.baseline_reason(e, filters.treats_nodes(e)).groupBy("reason").agg(F.count("*").alias("edges"))


@query(f"WITH {REASON.format(protect='FALSE')} SELECT pos, subject, predicate, object FROM reasoned WHERE reason LIKE 'kept%'", "edges")
def clean_baseline_edges(v):
    return filters.baseline_edges(v("edges")).select("pos", "subject", "predicate", "object")


@query("SELECT subject AS node FROM edges WHERE predicate = 'biolink:treats' UNION SELECT object FROM edges WHERE predicate = 'biolink:treats'", "edges")
def treats_nodes(v):
    return filters.treats_nodes(v("edges"))


DEGREES = "degrees AS (SELECT node, COUNT(*) AS degree FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) x GROUP BY node)"


@query(f"WITH {DEGREES}, low AS (SELECT node FROM degrees WHERE degree < 2) SELECT pos, subject, predicate, object FROM edges WHERE subject NOT IN (SELECT node FROM low) AND object NOT IN (SELECT node FROM low)", "edges")
def low_degree_filter(v):
    return filters.low_degree_filter(v("edges")).select("pos", "subject", "predicate", "object")


@query(f"WITH {DEGREES}, tn AS (SELECT subject AS n FROM edges WHERE predicate = 'biolink:treats' UNION SELECT object FROM edges WHERE predicate = 'biolink:treats') SELECT node FROM degrees WHERE degree < 10 AND node NOT IN (SELECT n FROM tn)", "edges")
def low_degree_nodes(v):
    e = v("edges")
    return filters.low_degree_nodes(e, 10, filters.treats_nodes(e))


@query("SELECT DISTINCT subject AS head, 'predicate:0' AS relation, object AS tail FROM edges WHERE predicate = 'biolink:treats'", "edges")
def treats_from_edges(v):
    e = v("edges").filter(F.col("predicate") == filters.TREATS)
    return e.select(F.col("subject").alias("head"), F.lit("predicate:0").alias("relation"), F.col("object").alias("tail")).distinct()


@query("SELECT pos, subject, predicate, object, primary_knowledge_source FROM edges WHERE primary_knowledge_source = 'infores:drugmechdb'", "edges")
def ground_truth_edges(v):
    return filters.edges_of_source(v("edges")).select("pos", "subject", "predicate", "object", "primary_knowledge_source")


@query("SELECT test_id, TrainHead, TrainRel_label, TrainTail, TracInScore FROM influence WHERE TracInScore >= SelfInfluence", "influence")
def influence_ge_self(v):
    return filters.above_self_influence(v("influence")).select("test_id", "TrainHead", "TrainRel_label", "TrainTail", "TracInScore")


@query("SELECT head, tail, score, is_treat FROM scores WHERE head IN (SELECT head FROM ev WHERE relation = 'signup') OR tail IN (SELECT tail FROM ev WHERE relation = 'signup') OR is_treat = 1", "scores", "ev")
def score_rows_touching(v):
    t = v("ev").filter("relation = 'signup'")
    s = v("scores").withColumn("__f", F.col("is_treat") == 1)
    return filters.touching(s, t.select("head"), t.select("tail"), "head", "tail", "__f").drop("__f")


# ---- dictionaries -------------------------------------------------------------------------------------

EDGE_MAP = """
em AS (SELECT 'predicate:' || CAST(ROW_NUMBER() OVER (ORDER BY MIN(pos), predicate, subject_aspect_qualifier, subject_direction_qualifier, object_aspect_qualifier, object_direction_qualifier) - 1 AS VARCHAR) AS predicate_id, predicate, subject_aspect_qualifier, subject_direction_qualifier, object_aspect_qualifier, object_direction_qualifier
FROM edges GROUP BY predicate, subject_aspect_qualifier, subject_direction_qualifier, object_aspect_qualifier, object_direction_qualifier)"""


@query(f"""WITH {EDGE_MAP} SELECT predicate_id, '{{"object_aspect_qualifier": "' || object_aspect_qualifier || '", "object_direction_qualifier": "' || object_direction_qualifier || '", "predicate": "' || predicate || '", "subject_aspect_qualifier": "' || subject_aspect_qualifier || '", "subject_direction_qualifier": "' || subject_direction_qualifier || '"}}' AS key FROM em""", "edges")
def edge_map(v):
    return encode.edge_map_json(encode.edge_map(v("edges")))


@query(f"WITH {EDGE_MAP} SELECT relation, COUNT(*) AS n, COUNT(DISTINCT head) AS heads FROM (SELECT e.subject AS head, em.predicate_id AS relation FROM edges e JOIN em USING (predicate, subject_aspect_qualifier, subject_direction_qualifier, object_aspect_qualifier, object_direction_qualifier)) x GROUP BY relation", "edges")
def translated_edges(v):
    e = v("edges")
    return encode.translate(e, encode.edge_map(e)).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("head").alias("heads"))


@query(f"WITH {EDGE_MAP} SELECT predicate_id, subject_aspect_qualifier = '' AND subject_direction_qualifier = '' AND object_aspect_qualifier = '' AND object_direction_qualifier = '' AS unqualified FROM em WHERE predicate = 'biolink:treats'", "edges")
def treats_predicate_ids(v):
    return encode.treats_ids(encode.edge_map(v("edges")))


NODE_DICT = "nd AS (SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY label) - 1 AS BIGINT) AS idx FROM (SELECT head AS label FROM triples UNION SELECT tail FROM triples) x)"
REL_DICT = "rd AS (SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY label) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT relation AS label FROM triples) x)"


@query(f"WITH {NODE_DICT} SELECT label, idx FROM nd", "triples")
def node_dict(v):
    return encode.node_dict(v("triples"))


@query(f"WITH {REL_DICT} SELECT label, idx FROM rd", "triples")
def rel_dict(v):
    return encode.rel_dict(v("triples"))


@query(f"WITH {NODE_DICT} SELECT COALESCE(NULLIF(n.name, ''), label) AS name, idx FROM nd LEFT JOIN nodes n ON n.id = nd.label", "triples", "nodes")
def node_name_dict(v):
    return encode.node_names(nodes_of(v), encode.node_dict(v("triples")))


@query(f"""WITH {NODE_DICT}, nn AS (SELECT COALESCE(NULLIF(n.name, ''), label) AS name, idx FROM nd LEFT JOIN nodes n ON n.id = nd.label)
SELECT (SELECT COUNT(*) FROM nd) AS nodes, (SELECT COUNT(DISTINCT idx) FROM nd) AS node_indices, (SELECT COUNT(*) FROM nn) AS names, (SELECT COUNT(DISTINCT idx) FROM nn) AS name_indices,
(SELECT COUNT(*) - COUNT(DISTINCT name) FROM nn) AS repeated_names, 0::BIGINT AS only_nodes, 0::BIGINT AS only_names""", "triples", "nodes")
def dict_validation(v):
    d = encode.node_dict(v("triples"))
    return encode.validate_dicts(d, encode.node_names(nodes_of(v), d))


@query(f"WITH {NODE_DICT}, {REL_DICT} SELECT h.idx AS h, r.idx AS r, t.idx AS t FROM (SELECT subject AS head, predicate AS relation, object AS tail FROM edges) e JOIN nd h ON h.label = e.head JOIN rd r ON r.label = e.relation JOIN nd t ON t.label = e.tail", "edges", "triples")
def mask_to_dict(v):
    t = v("triples")
    e = v("edges").select(F.col("subject").alias("head"), F.col("predicate").alias("relation"), F.col("object").alias("tail"))
    return encode.encode(e, encode.node_dict(t), encode.rel_dict(t))


@query("SELECT 'entity' AS kind, label FROM (SELECT subject AS label FROM edges UNION SELECT object FROM edges) e WHERE label NOT IN (SELECT head FROM triples UNION SELECT tail FROM triples) UNION ALL SELECT 'relation', predicate FROM (SELECT DISTINCT predicate FROM edges) p WHERE predicate NOT IN (SELECT relation FROM triples)", "edges", "triples")
def unknown_labels(v):
    t = v("triples")
    e = v("edges").select(F.col("subject").alias("head"), F.col("predicate").alias("relation"), F.col("object").alias("tail"))
    return encode.unknown_labels(e, encode.node_dict(t), encode.rel_dict(t))


@query(f"WITH {NODE_DICT} SELECT CAST(e.event_id % 5000 AS BIGINT) AS idx, COALESCE(nd.label, 'UNKNOWN_' || CAST(e.event_id % 5000 AS VARCHAR)) AS label, COUNT(*) AS n FROM events e LEFT JOIN nd ON nd.idx = e.event_id % 5000 GROUP BY 1, 2", "triples")
def label_enrichment(v):
    ids = v("ev").select((F.col("event_id") % 5000).alias("idx"))
    return encode.decode(ids, encode.node_dict(v("triples")), "idx", "label").groupBy("idx", "label").agg(F.count("*").alias("n"))


@query("SELECT curie, COALESCE(n.id, s.id, 'not exist') AS preferred FROM (SELECT synonym AS curie FROM nodes UNION ALL SELECT id FROM nodes UNION ALL SELECT DISTINCT head FROM ev) c LEFT JOIN nodes n ON n.id = c.curie LEFT JOIN nodes s ON s.synonym = c.curie", "nodes", "ev")
def synonym_resolution(v):
    n = v("nodes")
    curies = n.select(F.col("synonym").alias("curie")).unionByName(n.select(F.col("id").alias("curie"))).unionByName(v("ev").select(F.col("head").alias("curie")).distinct())
    return encode.resolve(curies, nodes_of(v))


@query("SELECT predicate, LOWER(COALESCE(regexp_extract(predicate, '^([^:]*):', 1), '')) AS prefix, CASE WHEN o = '' AND d = '' THEN predicate ELSE predicate || ' (' || TRIM(d || ' ' || o) || ')' END AS enriched, COUNT(*) AS n FROM (SELECT predicate, object_aspect_qualifier AS o, object_direction_qualifier AS d FROM edges) e GROUP BY ALL", "edges")
def enriched_relations(v):
    e = v("edges")
    out = e.select("predicate", F.lower(F.split_part("predicate", F.lit(":"), F.lit(1))).alias("prefix"), X.enrich_relation("predicate", "object_direction_qualifier", "object_aspect_qualifier").alias("enriched"))
    return out.groupBy("predicate", "prefix", "enriched").agg(F.count("*").alias("n"))


# ---- counts -------------------------------------------------------------------------------------------


@query("SELECT predicate AS value, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS percent FROM edges GROUP BY predicate", "edges")
def predicate_frequency(v):
    return aggregates.frequency(v("edges"), "predicate")


@query("SELECT primary_knowledge_source AS value, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS percent FROM edges GROUP BY primary_knowledge_source", "edges")
def source_frequency(v):
    return aggregates.frequency(v("edges"), "primary_knowledge_source")


@query("SELECT degree, COUNT(*) AS nodes FROM (SELECT node, COUNT(*) AS degree FROM (SELECT head AS node FROM triples UNION ALL SELECT tail FROM triples) x GROUP BY node) y GROUP BY degree", "triples")
def degree_histogram(v):
    return aggregates.degree_histogram(v("triples"))


@query("""SELECT COUNT(*) AS triples, COUNT(DISTINCT relation) AS relations, (SELECT COUNT(*) FROM (SELECT head FROM triples UNION SELECT tail FROM triples) e) AS entities,
(SELECT head FROM triples GROUP BY head ORDER BY COUNT(*) DESC, head LIMIT 1) AS out_node, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM triples GROUP BY head) o) AS out_degree,
(SELECT tail FROM triples GROUP BY tail ORDER BY COUNT(*) DESC, tail LIMIT 1) AS in_node, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM triples GROUP BY tail) i) AS in_degree,
ROUND(COUNT(*) / (SELECT COUNT(*) FROM (SELECT head FROM triples UNION SELECT tail FROM triples) e), 6) AS triples_per_entity FROM triples""", "triples")
def graph_stats(v):
    return aggregates.graph_stats(v("triples"))


@query("SELECT relation AS value, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS percent FROM ev GROUP BY relation ORDER BY n DESC, value LIMIT 10", "ev")
def top_relations(v):
    return aggregates.top_relations(v("ev"))


@query("SELECT relation, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS sd, ROUND(STDDEV_POP(value), 6) AS sd_population, ROUND(MEDIAN(value), 6) AS median, MIN(value) AS least, MAX(value) AS greatest FROM ev GROUP BY relation", "ev")
def grouped_describe(v):
    return aggregates.describe(v("ev"), ["relation"], "value")


PERCENTS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query("SELECT p AS share, ROUND((SELECT list_extract(quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]), i) FROM scores), 6) AS value FROM (SELECT UNNEST([0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS p, UNNEST([1, 2, 3, 4, 5, 6, 7]) AS i) x", "scores")
def percentiles(v):
    return aggregates.percentiles(v("scores"), "score", PERCENTS)


@query("SELECT CAST(LEAST(FLOOR((score - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, COUNT(*) AS n FROM scores, (SELECT MIN(score) AS lo, MAX(score) AS hi FROM scores) b GROUP BY 1", "scores")
def histogram(v):
    return aggregates.histogram(v("scores"), "score", 50)


@query("SELECT drug, disease, '[' || STRING_AGG(DISTINCT node, ', ' ORDER BY node) || ']' AS nodes FROM members GROUP BY drug, disease", "members")
def path_dedup(v):
    m = v("members").groupBy("drug", "disease", "path_id").agg(F.collect_list("node").alias("nodes"))
    return aggregates.union_of_lists(m, ["drug", "disease"], "nodes").select("drug", "disease", X.format_list("nodes").alias("nodes"))


@query("SELECT CAST(n AS BIGINT) AS nodes, COUNT(*) AS paths FROM (SELECT path_id, COUNT(DISTINCT node) + 2 AS n FROM members GROUP BY path_id) x GROUP BY n", "members")
def path_lengths(v):
    return v("members").groupBy("path_id").agg((F.countDistinct("node") + 2).alias("nodes")).groupBy("nodes").agg(F.count("*").alias("paths"))


# ---- joins and sets ------------------------------------------------------------------------------------


@query("SELECT head, tail, score, CASE WHEN EXISTS (SELECT 1 FROM ev e WHERE e.head = s.head AND e.tail = s.tail AND e.relation = 'purchase') THEN 1 ELSE 0 END AS in_pairs FROM scores s", "scores", "ev")
def pair_exists_flag(v):
    return joins.mark(v("scores").select("head", "tail", "score"), v("ev").filter("relation = 'purchase'").select("head", "tail"), ["head", "tail"], "in_pairs", as_int=True)


@query("SELECT head, tail, score FROM scores s WHERE EXISTS (SELECT 1 FROM ev e WHERE e.head = s.head AND e.tail = s.tail AND e.relation = 'purchase')", "scores", "ev")
def pair_filter(v):
    return QUERIES_pair(v).filter("in_pairs = 1").select("head", "tail", "score")


QUERIES_pair = pair_exists_flag


@query("SELECT DISTINCT n.id, n.id IN (SELECT head FROM triples UNION SELECT tail FROM triples) AS in_graph FROM nodes n", "nodes", "triples")
def nodes_in_graph(v):
    return joins.mark(v("nodes").select("id").distinct(), v("triples").select(F.explode(F.array("head", "tail")).alias("id")), ["id"], "in_graph")


@query("SELECT a.head, a.tail, a.mean_click, b.mean_purchase FROM (SELECT head, tail, ROUND(AVG(value), 6) AS mean_click FROM ev WHERE relation = 'click' GROUP BY head, tail) a JOIN (SELECT head, tail, ROUND(AVG(value), 6) AS mean_purchase FROM ev WHERE relation = 'purchase' GROUP BY head, tail) b USING (head, tail)", "ev")
def align_scores(v):
    def side(relation, name):
        return v("ev").filter(F.col("relation") == relation).groupBy("head", "tail").agg(F.round(F.avg("value"), 6).alias(name))

    return joins.align(side("click", "mean_click"), side("purchase", "mean_purchase"), ["head", "tail"])


@query("SELECT head, tail, relation, value, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY head, tail ORDER BY CASE relation WHEN 'purchase' THEN 0 ELSE 1 END, value DESC, event_id) AS n FROM ev) x WHERE n = 1", "ev")
def combine_keep_first(v):
    e = v("ev").select("head", "tail", "relation", "value", "event_id")
    return joins.combine_keep_first([e.filter("relation = 'purchase'"), e.filter("relation <> 'purchase'")], ["head", "tail"], F.col("value").desc(), F.col("event_id"))


@query("SELECT DISTINCT p.head AS drug, p.tail AS disease, a.path_id FROM treats p JOIN members a ON a.node = p.head JOIN members b ON b.node = p.tail AND b.path_id = a.path_id", "treats", "members")
def comembership_paths(v):
    return joins.comembership(v("members"), v("treats").select(F.col("head").alias("drug"), F.col("tail").alias("disease")))


@query("SELECT t.head AS drug, s.tail AS disease, 'predicate:38' AS relation FROM (SELECT DISTINCT head FROM tests) t CROSS JOIN (SELECT DISTINCT tail FROM tests) s", "tests")
def drug_disease_matrix(v):
    t = v("tests")
    return joins.matrix(t.select(F.col("head").alias("drug")), t.select(F.col("tail").alias("disease")), "predicate:38")


@query("SELECT COUNT(*) FILTER (a AND b) AS in_both, COUNT(*) FILTER (a AND NOT b) AS only_first, COUNT(*) FILTER (b AND NOT a) AS only_second, ROUND(100.0 * COUNT(*) FILTER (a AND b) / GREATEST(COUNT(*) FILTER (a), COUNT(*) FILTER (b)), 6) AS match_percent FROM (SELECT head, tail, BOOL_OR(relation = 'click') AS a, BOOL_OR(relation = 'view') AS b FROM ev GROUP BY head, tail) x", "ev")
def engine_diff(v):
    e = v("ev")
    return joins.compare_sets(e.filter("relation = 'click'").select("head", "tail"), e.filter("relation = 'view'").select("head", "tail"))


# ---- samples and splits ----------------------------------------------------------------------------------

CATEGORIES = """
counted AS (SELECT *, COUNT(*) OVER (PARTITION BY head) AS hs, COUNT(*) OVER (PARTITION BY tail) AS ts FROM treats),
nm AS (SELECT head AS node FROM counted WHERE hs > 1 AND ts > 1 UNION SELECT tail FROM counted WHERE hs > 1 AND ts > 1),
cat AS (SELECT head, relation, tail, CASE WHEN head IN (SELECT node FROM nm) OR tail IN (SELECT node FROM nm) THEN 'many_to_many' WHEN hs = 1 AND ts = 1 THEN 'one_to_one' WHEN hs > 1 AND ts = 1 THEN 'one_to_many' ELSE 'many_to_one' END AS category FROM counted)"""


@query(f"WITH {CATEGORIES} SELECT head, relation, tail, category, CASE category WHEN 'one_to_many' THEN head WHEN 'many_to_one' THEN tail ELSE head || '|' || relation || '|' || tail END AS \"group\" FROM cat", "treats")
def treats_categories(v):
    return splits.categorize(v("treats"))


SHARES = {"one_to_one": 0.06, "one_to_many": 0.02, "many_to_one": 0.02, "many_to_many": 0.02}


def group_sample_sql(group: str, shares: dict[str, float] = SHARES) -> str:
    """The walk over groups in hash order, one step a row."""
    listed = ", ".join(f"('{c}', CAST({s} AS DOUBLE))" for c, s in shares.items())
    fits = "w.taken + g.size <= GREATEST(s.target, FLOOR(s.target * 1.5))"
    return f"""WITH RECURSIVE {CATEGORIES}, c AS (SELECT *, {group} AS grp FROM cat),
g AS (SELECT category, grp, COUNT(*) AS size, ROW_NUMBER() OVER (PARTITION BY category ORDER BY MD5('42|' || category || '|' || grp), grp) AS n FROM c GROUP BY category, grp),
s AS (SELECT category, CAST(FLOOR(share * (SELECT COUNT(*) FROM c)) AS BIGINT) AS target FROM (VALUES {listed}) x(category, share)),
w AS (SELECT category, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS taken, CAST(NULL AS VARCHAR) AS grp, FALSE AS keep FROM s
UNION ALL SELECT w.category, g.n, CASE WHEN {fits} THEN w.taken + g.size ELSE w.taken END, g.grp, {fits} FROM w JOIN g ON g.category = w.category AND g.n = w.n + 1 JOIN s ON s.category = w.category WHERE w.taken < s.target)
SELECT c.head, c.relation, c.tail, c.category, c.grp AS "group" FROM c JOIN w ON w.category = c.category AND w.grp = c.grp AND w.keep"""


GROUP_SQL = "CASE category WHEN 'one_to_many' THEN head WHEN 'many_to_one' THEN tail ELSE head || '|' || relation || '|' || tail END"


@query(group_sample_sql(GROUP_SQL), "treats")
def group_sample(v):
    return splits.group_sample(splits.categorize(v("treats")), SHARES)


@query(group_sample_sql("head"), "treats")
def group_sample_by_head(v):
    """The same with all edges of a head as a group, whatever their category: groups of several edges, some passed over."""
    return splits.group_sample(splits.categorize(v("treats")).withColumn("group", F.col("head")), SHARES)


@query("SELECT head, relation, tail FROM tests", "tests")
def test_sample(v):
    return splits.sample_fraction(v("treats"), 0.01)


@query("SELECT head, relation, tail, CASE WHEN n <= FLOOR(total * 0.9) THEN 'train' ELSE 'valid' END AS part FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY MD5('42|' || head || '|' || relation || '|' || tail), head, relation, tail) AS n, COUNT(*) OVER () AS total FROM triples) x", "triples")
def train_valid_split(v):
    return splits.split(v("triples"))


@query("WITH p AS (SELECT head, relation, tail, CASE WHEN n <= FLOOR(total * 0.9) THEN 'train' ELSE 'valid' END AS part FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY MD5('42|' || head || '|' || relation || '|' || tail), head, relation, tail) AS n, COUNT(*) OVER () AS total FROM triples) x) SELECT part, COUNT(*) AS triples, COUNT(DISTINCT relation) AS relations, (SELECT COUNT(DISTINCT e) FROM (SELECT part AS q, head AS e FROM p UNION ALL SELECT part, tail FROM p) z WHERE z.q = p.part) AS entities FROM p GROUP BY part", "triples")
def split_stats(v):
    return aggregates.split_stats(splits.split(v("triples")))


@query("SELECT e.head, e.relation, e.tail FROM (SELECT head, relation, tail FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev t WHERE t.relation = 'signup' AND t.head = ev.head AND t.tail = ev.tail AND t.relation = ev.relation)) e", "ev")
def train_candidates_exact(v):
    e = v("ev").select("head", "relation", "tail")
    return splits.without_triples(e, e.filter("relation = 'signup'"))


@query("SELECT DISTINCT head, relation, tail FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev t WHERE t.relation = 'signup' AND t.head = ev.head AND t.tail = ev.tail)", "ev")
def train_candidates_pair(v):
    e = v("ev").select("head", "relation", "tail")
    return splits.train_candidates(e, e.filter("relation = 'signup'"))


@query("SELECT relation, COUNT(*) AS removed FROM ev WHERE relation <> 'signup' AND EXISTS (SELECT 1 FROM ev t WHERE t.relation = 'signup' AND t.head = ev.head AND t.tail = ev.tail) GROUP BY relation", "ev")
def leaked_predicates(v):
    e = v("ev").select("head", "relation", "tail")
    return splits.removed_predicates(e, e.filter("relation = 'signup'"))


@query("SELECT head, tail, score, is_treat FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tail ORDER BY MD5('42|' || head || '|' || tail), head) AS n FROM scores WHERE is_treat = 0) x WHERE n <= 20", "scores")
def negatives_per_tail(v):
    s = v("scores")
    return splits.negatives(s, s.filter("is_treat = 1"))


@query("SELECT event_id, head, relation, tail, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY relation ORDER BY MD5('42|' || CAST(event_id AS VARCHAR) || '|' || head || '|' || relation || '|' || tail), event_id) AS n, COUNT(*) OVER (PARTITION BY relation) AS total FROM ev) x WHERE n <= CEIL(total * 0.1)", "ev")
def stratified_sample(v):
    e = v("ev")
    w = Window.partitionBy("relation")
    ranked = e.withColumns({"__n": F.row_number().over(w.orderBy(hash_order(42, "event_id", "head", "relation", "tail"), "event_id")), "__all": F.count("*").over(w)})
    return ranked.filter(F.col("__n") <= F.ceil(F.col("__all") * 0.1)).drop("__n", "__all")


# ---- traversal ----------------------------------------------------------------------------------------------

UND = "und AS (SELECT head AS a, tail AS b FROM triples UNION SELECT tail, head FROM triples)"


def reach(name: str, seeds: str, hops: int) -> str:
    """Least number of hops from seeds (test_id, node), by a recursive set of walks."""
    return f"{name}_w AS (SELECT test_id, node, 0 AS hops FROM ({seeds}) s UNION SELECT w.test_id, u.b, w.hops + 1 FROM {name}_w w JOIN und u ON u.a = w.node WHERE w.hops < {hops}),\n{name} AS (SELECT test_id, node, CAST(MIN(hops) AS INT) AS hops FROM {name}_w GROUP BY test_id, node)"


HEADS, TAILS = "SELECT test_id, head AS node FROM {0}", "SELECT test_id, tail AS node FROM {0}"
ENDS = "SELECT test_id, head AS node FROM {0} UNION SELECT test_id, tail FROM {0}"


@query(f"WITH RECURSIVE {UND}, {reach('r', HEADS.format('tests'), 3)} SELECT test_id, node, hops FROM r", "triples", "tests")
def hop_distances(v):
    return graph.hop_distances(graph.undirected(v("triples")), v("tests").select("test_id", F.col("head").alias("node")), 3)


@query(f"WITH RECURSIVE {UND}, {reach('r', ENDS.format('tests'), 2)} SELECT test_id, COUNT(*) AS nodes FROM r GROUP BY test_id", "triples", "tests")
def khop_nodes(v):
    t = v("tests")
    seeds = t.select("test_id", F.explode(F.array("head", "tail")).alias("node"))
    return graph.hop_distances(graph.undirected(v("triples")), seeds, 2).groupBy("test_id").agg(F.count("*").alias("nodes"))


@query(f"WITH RECURSIVE {UND}, {reach('r', ENDS.format('tests'), 1)} SELECT DISTINCT r.test_id, t.head, t.relation, t.tail FROM r JOIN triples t ON t.head = r.node OR t.tail = r.node", "triples", "tests")
def khop_edges(v):
    t = v("tests")
    return graph.khop_edges(v("triples"), t.select("test_id", F.explode(F.array("head", "tail")).alias("node")), 2)


def filter_sql(engine: str, tests: str = "tests", hops: int = 2, path: str = "", select: str = "test_id, head, relation, tail") -> str:
    """The edge filter of an engine as SQL over distances dh and dt."""
    inside = "dh.hops IS NOT NULL AND dt.hops IS NOT NULL" if engine == "igraph" else "(dh.hops IS NOT NULL AND dt.hops IS NOT NULL) OR e.node IS NOT NULL"
    degree = {
        "networkx": "deg AS (SELECT i.test_id, i.node, d.degree FROM inside i JOIN (SELECT a, COUNT(*) AS degree FROM und GROUP BY a) d ON d.a = i.node)",
        "igraph": "deg AS (SELECT i.test_id, i.node, d.degree FROM inside i JOIN (SELECT a, COUNT(*) AS degree FROM (SELECT head AS a FROM triples UNION ALL SELECT tail FROM triples) x GROUP BY a) d ON d.a = i.node)",
        "pyg": "sub AS (SELECT DISTINCT x.test_id, u.a, u.b FROM dh x JOIN und u ON u.a = x.node JOIN dh y ON y.test_id = x.test_id AND y.node = u.b UNION SELECT x.test_id, u.a, u.b FROM dt x JOIN und u ON u.a = x.node JOIN dt y ON y.test_id = x.test_id AND y.node = u.b),\ndeg AS (SELECT test_id, a AS node, COUNT(*) AS degree FROM sub GROUP BY test_id, a)",
    }[engine]
    return f"""WITH RECURSIVE {UND}, {reach('dh', HEADS.format(tests), hops)}, {reach('dt', TAILS.format(tests), hops)}, ends AS ({ENDS.format(tests)}),
inside AS (SELECT k.test_id, k.node, dh.hops AS h, dt.hops AS t, e.node IS NOT NULL AS is_test FROM (SELECT test_id, node FROM dh UNION SELECT test_id, node FROM dt) k LEFT JOIN dh USING (test_id, node) LEFT JOIN dt USING (test_id, node) LEFT JOIN ends e USING (test_id, node) WHERE {inside}),
{degree},
kept AS (SELECT s.test_id, x.head, x.relation, x.tail, s.h AS sh, s.t AS st, o.h AS oh, o.t AS ot FROM triples x JOIN inside s ON s.node = x.head JOIN inside o ON o.node = x.tail AND o.test_id = s.test_id LEFT JOIN deg a ON a.test_id = s.test_id AND a.node = x.head LEFT JOIN deg b ON b.test_id = s.test_id AND b.node = x.tail WHERE s.is_test OR o.is_test OR COALESCE(a.degree, 0) >= 2 OR COALESCE(b.degree, 0) >= 2)
SELECT {select} FROM kept {path}"""


for _engine in ("pyg", "networkx", "igraph"):
    query(filter_sql(_engine), "triples", "tests", name=f"edge_filter_{_engine}")(lambda v, engine=_engine: graph.edge_filter(v("triples"), v("tests"), engine=engine))


@query(f"""WITH RECURSIVE {UND}, {reach('r', ENDS.format('tests'), 1)}, near2 AS (SELECT DISTINCT r.test_id, t.head, t.relation, t.tail FROM r JOIN triples t ON t.head = r.node OR t.tail = r.node),
deg AS (SELECT test_id, node, COUNT(*) AS degree FROM (SELECT test_id, head AS node FROM near2 UNION ALL SELECT test_id, tail FROM near2) x GROUP BY test_id, node), ends AS ({ENDS.format('tests')})
SELECT n.test_id, n.head, n.relation, n.tail FROM near2 n JOIN deg a ON a.test_id = n.test_id AND a.node = n.head JOIN deg b ON b.test_id = n.test_id AND b.node = n.tail LEFT JOIN ends x ON x.test_id = n.test_id AND x.node = n.head LEFT JOIN ends y ON y.test_id = n.test_id AND y.node = n.tail
WHERE x.node IS NOT NULL OR y.node IS NOT NULL OR a.degree >= 2 OR b.degree >= 2""", "triples", "tests")
def edge_filter_python(v):
    return graph.edge_filter(v("triples"), v("tests"), engine="python")


@query(filter_sql("pyg", path="WHERE (sh <= oh AND ot <= st AND sh + ot <= 3) OR (oh <= sh AND st <= ot AND oh + st <= 3)"), "triples", "tests")
def edge_filter_path(v):
    return graph.edge_filter(v("triples"), v("tests"), path_filter=True, max_length=3)


@query(filter_sql("networkx", select="reason, COUNT(*) AS triples", path="GROUP BY reason").replace("kept AS (SELECT s.test_id,", "kept AS (SELECT CASE WHEN s.is_test OR o.is_test THEN 'touches_test' WHEN COALESCE(a.degree, 0) >= 2 OR COALESCE(b.degree, 0) >= 2 THEN 'degree' ELSE 'low_degree' END AS reason, s.test_id,").replace(" WHERE s.is_test OR o.is_test OR COALESCE(a.degree, 0) >= 2 OR COALESCE(b.degree, 0) >= 2)", ")"), "triples", "tests")
def edge_filter_reasons(v):
    return graph.edge_filter(v("triples"), v("tests"), engine="networkx", reasons=True).groupBy("reason").agg(F.count("*").alias("triples"))


@query(filter_sql("pyg").replace("SELECT test_id, head, relation, tail FROM kept", "SELECT test_id, COUNT(*) AS triples, COUNT(DISTINCT relation) AS relations, ANY_VALUE(entities) AS entities, ANY_VALUE(mean_degree) AS mean_degree, ANY_VALUE(least_degree) AS least_degree, ANY_VALUE(greatest_degree) AS greatest_degree FROM kept JOIN (SELECT test_id, COUNT(*) AS entities, ROUND(AVG(d), 6) AS mean_degree, MIN(d) AS least_degree, MAX(d) AS greatest_degree FROM (SELECT test_id, node, COUNT(*) AS d FROM (SELECT test_id, head AS node FROM kept UNION ALL SELECT test_id, tail FROM kept) x GROUP BY test_id, node) y GROUP BY test_id) z USING (test_id) GROUP BY test_id"), "triples", "tests")
def edge_filter_stats(v):
    return aggregates.filter_stats(graph.edge_filter(v("triples"), v("tests")))


# ---- traversal of all lines: the graph with hubs, by bits of tests --------------------------------------------------------------

ALL_UND = UND.replace("triples", "all_triples")


@query(f"WITH RECURSIVE {ALL_UND}, {reach('r', HEADS.format('tests'), 3)} SELECT test_id, node, hops FROM r", "all_triples", "tests")
def full_hop_distances(v):
    return reaching.hop_distances(v("all_links"), v("tests").select("test_id", F.col("head").alias("node")), 3)


@query(f"WITH RECURSIVE {ALL_UND}, {reach('r', ENDS.format('tests'), 2)} SELECT test_id, hops, COUNT(*) AS nodes FROM r GROUP BY test_id, hops", "all_triples", "tests")
def full_khop_nodes(v):
    """Neighbourhoods by size and distance: counted from bits, so no row a test and node is made before the count."""
    t = v("tests")
    numbers = reaching.numbered_tests(t)
    seeds = reaching.seeded(t.select("test_id", F.explode(F.array("head", "tail")).alias("node")), numbers)
    near = reaching.reached_in(v("all_links"), seeds, 2)
    counts = [F.sum(F.call_function("shiftright", "bits", F.lit(i)).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{i}") for i in range(reaching.BITS)]
    each = near.groupBy("word", "hops").agg(*counts)
    pairs = each.select("word", "hops", F.posexplode(F.array(*[f"b{i}" for i in range(reaching.BITS)])).alias("bit", "nodes")).filter("nodes > 0")
    return pairs.join(numbers, ["word", "bit"]).select("test_id", "hops", "nodes")


for _engine in ("networkx", "igraph"):
    query(filter_sql(_engine, select="head, relation, tail, COUNT(*) AS tests", path="GROUP BY head, relation, tail").replace("triples", "all_triples"), "all_triples", "tests", name=f"full_edge_filter_{_engine}")(
        lambda v, engine=_engine: reaching.proximity(v("all_triples"), v("tests"), engine=engine)[0].groupBy("head", "relation", "tail").agg(F.sum(F.bit_count("bits")).alias("tests"))
    )


@query(filter_sql("networkx", select="test_id, COUNT(*) AS kept, COUNT(DISTINCT head) AS heads", path="GROUP BY test_id").replace("triples", "all_triples"), "all_triples", "tests")
def full_edge_filter_stats(v):
    """What the proximity filter leaves of all lines for each test."""
    kept = reaching.by_test(*reaching.proximity(v("all_triples"), v("tests")))
    return kept.groupBy("test_id", "head").agg(F.count("*").alias("n")).groupBy("test_id").agg(F.sum("n").alias("kept"), F.count("*").alias("heads"))


@query(f"WITH RECURSIVE {ALL_UND}, {reach('r', HEADS.format('distant'), 4)} SELECT d.test_id, r.hops AS length FROM distant d JOIN r ON r.test_id = d.test_id AND r.node = d.tail", "all_triples", "triples", "distant")
def full_shortest(v):
    """Edges between the ends of each distant pair, 4 at most: both ends meet half way."""
    return reaching.shortest(v("all_links"), v("distant"), 4)


def paths_sql(tests: str, length: int, tail: str) -> str:
    return f"""WITH RECURSIVE {UND}, p AS (SELECT test_id, tail AS goal, head AS cur, [head] AS nodes FROM {tests} WHERE head <> tail
UNION ALL SELECT p.test_id, p.goal, u.b, list_append(p.nodes, u.b) FROM p JOIN und u ON u.a = p.cur WHERE p.cur <> p.goal AND len(p.nodes) <= {length} AND NOT list_contains(p.nodes, u.b)),
paths AS (SELECT test_id, nodes FROM p WHERE cur = goal AND len(nodes) > 1) {tail}"""


@query(paths_sql("distant", 4, "SELECT test_id, array_to_string(nodes, '>') AS path FROM paths"), "triples", "distant")
def simple_paths(v):
    return graph.simple_paths(v("triples"), v("distant"), 4).select("test_id", F.array_join("nodes", ">").alias("path"))


@query(paths_sql("distant", 4, "SELECT test_id, COUNT(*) AS paths, MIN(len(nodes) - 1) AS shortest, MAX(len(nodes) - 1) AS longest, ROUND(AVG(len(nodes) - 1), 6) AS mean_length FROM paths GROUP BY test_id"), "triples", "distant")
def simple_path_stats(v):
    return graph.path_stats(graph.simple_paths(v("triples"), v("distant"), 4))


STEPS = ", steps AS (SELECT DISTINCT test_id, LEAST(nodes[i], nodes[i + 1]) AS low, GREATEST(nodes[i], nodes[i + 1]) AS high FROM paths, UNNEST(range(1, len(nodes))) r(i))"


@query(paths_sql("distant", 4, f"{STEPS} SELECT test_id, low, high FROM steps"), "triples", "distant")
def path_edges(v):
    return graph.path_edges(graph.simple_paths(v("triples"), v("distant"), 4))


@query(paths_sql("distant", 4, f"{STEPS} SELECT s.test_id, t.head, t.relation, t.tail FROM steps s JOIN triples t ON LEAST(t.head, t.tail) = s.low AND GREATEST(t.head, t.tail) = s.high"), "triples", "distant")
def edge_filter_strict(v):
    return graph.strict_path_edges(v("triples"), v("distant"), 4)


@query("SELECT head, relation, tail FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY LEAST(head, tail), GREATEST(head, tail) ORDER BY event_id) AS n FROM ev) x WHERE n = 1", "ev")
def edges_only_dedup(v):
    return graph.one_triple_per_edge(v("ev"), F.col("event_id")).select("head", "relation", "tail")


def khop_sql(directed: bool, k: int, tail: str, tests: str = "distant") -> str:
    back = "" if directed else " UNION ALL SELECT test_id, TrainTail, TrainRel_label, TrainHead, TracInScore FROM influence"
    return f"""WITH RECURSIVE hop AS (SELECT test_id, TrainHead AS a, TrainRel_label AS relation, TrainTail AS b, TracInScore AS score FROM influence{back}),
w AS (SELECT test_id, head AS h, tail AS t, 'Test Head' AS start_from, head AS cur, [head] AS nodes, CAST([] AS VARCHAR[]) AS relations, CAST([] AS DOUBLE[]) AS scores, 0 AS n FROM {tests}
UNION ALL SELECT test_id, head, tail, 'Test Tail', tail, [tail], CAST([] AS VARCHAR[]), CAST([] AS DOUBLE[]), 0 FROM {tests}
UNION ALL SELECT w.test_id, w.h, w.t, w.start_from, hop.b, list_append(w.nodes, hop.b), list_append(w.relations, hop.relation), list_append(w.scores, hop.score), w.n + 1 FROM w JOIN hop ON hop.test_id = w.test_id AND hop.a = w.cur WHERE w.n < {k} AND NOT list_contains(w.nodes, hop.b)),
found AS (SELECT *, nodes[1] = h AND cur = t AS connects, nodes[1] || list_aggregate(list_transform(range(1, len(relations) + 1), lambda i: ' -> ' || relations[i] || ' -> ' || nodes[i + 1]), 'string_agg', '') AS path,
  list_sum(scores) / len(scores) AS mean FROM w WHERE n = {k}) {tail}"""


def influence_links(v) -> DataFrame:
    return v("influence").select("test_id", F.col("TrainHead").alias("source"), F.col("TrainRel_label").alias("relation"), F.col("TrainTail").alias("target"), F.col("TracInScore").alias("score"))


PATH_SCORES = """ROUND(list_sum(scores), 6) AS score_sum, ROUND(mean, 6) AS score_mean,
ROUND(CASE WHEN list_contains(scores, 0.0) THEN 0.0 ELSE CASE WHEN len(list_filter(scores, lambda x: x < 0)) % 2 = 1 THEN -1 ELSE 1 END * EXP(list_sum(list_transform(scores, lambda x: LN(ABS(NULLIF(x, 0))))) / len(scores)) END, 5) AS score_geometric_mean,
ROUND(CASE WHEN list_contains(scores, 0.0) THEN 0.0 ELSE CASE WHEN len(list_filter(scores, lambda x: x < 0)) = len(scores) THEN -1 ELSE 1 END * len(scores) / list_sum(list_transform(scores, lambda x: 1 / ABS(NULLIF(x, 0)))) END, 5) AS score_harmonic_mean"""


@query(khop_sql(True, 2, f"SELECT test_id, start_from, path, connects, {PATH_SCORES} FROM found"), "influence", "distant")
def khop_paths_scored(v):
    p = graph.khop_paths(influence_links(v), v("distant"), 2)
    return p.select("test_id", "start_from", graph.path_string().alias("path"), "connects", *[F.round(c, 6 if c in ("score_sum", "score_mean") else 5).alias(c) for c in ("score_sum", "score_mean", "score_geometric_mean", "score_harmonic_mean")])


@query(khop_sql(True, 2, ", ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY test_id ORDER BY mean DESC, path) AS INT) AS path_rank FROM found WHERE connects) SELECT test_id, path_rank, path AS path_string, CAST(i - 1 AS INT) AS edge_pos, nodes[i] AS TrainHead, relations[i] AS TrainRel_label, nodes[i + 1] AS TrainTail, scores[i] AS TracInScore, ROUND(mean, 6) AS path_score_mean FROM ranked, UNNEST(range(1, len(nodes))) r(i)"), "influence", "distant")
def path_edges_exploded(v):
    return graph.ranked_path_edges(graph.khop_paths(influence_links(v), v("distant"), 2, connecting=True)).withColumn("path_score_mean", F.round("path_score_mean", 6))


def type_sql(x: str) -> str:
    return f"LEFT(UPPER(split_part({x}, ':', 1)), 2)"


@query(khop_sql(False, 2, f", m AS (SELECT test_id, {type_sql('nodes[1]')} || list_aggregate(list_transform(range(1, len(relations) + 1), lambda i: ' -> ' || relations[i] || ' -> ' || {type_sql('nodes[i + 1]')}), 'string_agg', '') AS metapath FROM found WHERE connects) SELECT test_id, metapath, COUNT(*) AS paths, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY test_id), 6) AS percentage FROM m GROUP BY test_id, metapath"), "influence", "distant")
def metapaths(v):
    return graph.metapaths(graph.khop_paths(influence_links(v), v("distant"), 2, directed=False, connecting=True)).drop("examples")


# ---- scores and ranks ------------------------------------------------------------------------------------------


def vectors(f):
    """Register a query over the embeddings table."""
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"))


DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def emb(name: str, sql: str):
    def put(f):
        QUERIES[name] = vectors(f)
        ORACLE[name] = sql
        return f

    return put


# a pair for each vector and the next of its label: what a table of candidate links would give
PAIRS_SQL = "pairs AS (SELECT vec_id AS head, COALESCE(LEAD(vec_id) OVER (PARTITION BY label ORDER BY vec_id), MIN(vec_id) OVER (PARTITION BY label)) AS tail FROM embeddings)"


def pairs_of(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("label").orderBy("id")
    return e.select(F.col("id").alias("head"), F.coalesce(F.lead("id").over(w), F.min("id").over(Window.partitionBy("label"))).alias("tail"))


@emb("score_pairs", f"WITH {PAIRS_SQL} SELECT head, tail, ROUND({DOT.format('h.embedding', 't.embedding')}, 6) AS score, ROUND(1 / (1 + EXP(-ROUND({DOT.format('h.embedding', 't.embedding')}, 6))), 6) AS sigmoid_score FROM pairs JOIN embeddings h ON h.vec_id = head JOIN embeddings t ON t.vec_id = tail")
def score_pairs(e):
    return score.score_pairs(pairs_of(e), e)


# the vectors of label 0 ask, all vectors answer; truth is the next of the label, known are the rest of it
SCORED_SQL = f"{PAIRS_SQL}, sc AS (SELECT q.vec_id AS query_id, e.vec_id AS tail, ROUND({DOT.format('q.embedding', 'e.embedding')}, 6) AS score, e.label FROM embeddings q, embeddings e WHERE q.label = 0), truth AS (SELECT query_id, sc.tail, score FROM sc JOIN pairs ON pairs.head = sc.query_id AND pairs.tail = sc.tail)"


def asking(e: DataFrame) -> DataFrame:
    return e.filter("label = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("group"))


def answering(e: DataFrame) -> DataFrame:
    """All vectors, with the label as the group whose own answers are known."""
    return e.select("id", "vector", F.col("label").alias("group"))


def truth_of(e: DataFrame) -> DataFrame:
    return pairs_of(e).join(e.filter("label = 0").select(F.col("id").alias("head")), "head", "left_semi").select(F.col("head").alias("query_id"), "tail")


RANKS_SQL = "ranks AS (SELECT t.query_id, t.tail, t.score, 1 + COUNT(*) FILTER (s.tail <> t.tail AND s.label <> 0 AND s.score {0} t.score) AS rank FROM truth t JOIN sc s USING (query_id) GROUP BY t.query_id, t.tail, t.score)"


@emb("filtered_rank", f"WITH {SCORED_SQL}, {RANKS_SQL.format('>')} SELECT query_id, tail, score, rank FROM ranks")
def filtered_rank(e):
    return score.count_ranks(asking(e), answering(e), truth_of(e))


@emb("pessimistic_rank", f"WITH {SCORED_SQL}, {RANKS_SQL.format('>=')} SELECT query_id, tail, score, rank FROM ranks")
def pessimistic_rank(e):
    return score.count_ranks(asking(e), answering(e), truth_of(e), ties="pessimistic")


@emb("link_metrics", f"WITH {SCORED_SQL}, {RANKS_SQL.format('>')} SELECT COUNT(*) AS queries, ROUND(AVG(rank), 6) AS mean_rank, ROUND(MEDIAN(rank), 6) AS median_rank, ROUND(AVG(1.0 / rank), 6) AS mrr, ROUND(AVG(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hits_at_1, ROUND(AVG(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hits_at_3, ROUND(AVG(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hits_at_5, ROUND(AVG(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hits_at_10 FROM ranks")
def link_metrics(e):
    return score.link_metrics(score.count_ranks(asking(e), answering(e), truth_of(e)))


@emb("topk_tails", f"WITH {SCORED_SQL} SELECT query_id, tail, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, tail, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, tail) AS rank FROM sc WHERE label <> 0) x WHERE rank <= 10")
def topk_tails(e):
    return score.best_tails(asking(e), answering(e), 10)


@emb("bce_loss", f"WITH {SCORED_SQL} SELECT query_id, ROUND(AVG(GREATEST(s.score, 0) + LN(1 + EXP(-ABS(s.score))) - s.score * (CASE WHEN t.tail IS NOT NULL THEN 0.9 ELSE 0 END + 0.1 / n)), 6) AS loss FROM sc s LEFT JOIN truth t USING (query_id, tail), (SELECT COUNT(*) AS n FROM embeddings) c GROUP BY query_id")
def bce_loss(e):
    return score.block_loss(asking(e).drop("group"), e.select("id", "vector"), truth_of(e), 0.1)


# x is the first half of a vector, delta the second
INF_SQL = f"f AS (SELECT vec_id, label, CAST(embedding[1:32] AS DOUBLE[]) AS x, CAST(embedding[33:64] AS DOUBLE[]) AS d FROM embeddings), i AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, ROUND(0.001 * list_dot_product(a.d, b.d) * (1 + list_dot_product(a.x, b.x)), 9) AS influence FROM f a, f b WHERE a.label = 0 AND b.label <> 0)"


def features_of(e: DataFrame) -> DataFrame:
    return e.select("id", "label", F.slice("vector", 1, 32).alias("x"), F.slice("vector", 33, 32).alias("delta"))


def strongest(e: DataFrame, signed: bool = False) -> DataFrame:
    f = features_of(e)
    return influence.best_influences(influence.indexed(f.filter("label = 0"), "id"), influence.indexed(f.filter("label <> 0"), "id"), 10, signed=signed)


def influence_rows(e: DataFrame) -> DataFrame:
    f = features_of(e)
    return influence.influences(f.filter("label = 0").select(F.col("id").alias("test_id"), "x", "delta"), f.filter("label <> 0").select(F.col("id").alias("train_id"), "x", "delta"))


@emb("influence", f"WITH {INF_SQL} SELECT test_id, train_id, influence FROM i")
def influence_all(e):
    return influence_rows(e)


@emb("influence_topk", f"WITH {INF_SQL} SELECT test_id, train_id, influence, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY test_id ORDER BY ABS(influence) DESC, train_id) AS rank FROM i) x WHERE rank <= 10")
def influence_topk(e):
    return strongest(e)


@emb("influence_topk_signed", f"WITH {INF_SQL} SELECT test_id, train_id, influence, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY test_id ORDER BY influence DESC, train_id) AS rank FROM i) x WHERE rank <= 10")
def influence_topk_signed(e):
    return strongest(e, signed=True)


@emb("self_influence", f"WITH {INF_SQL} SELECT vec_id AS train_id, ROUND(0.001 * list_dot_product(d, d) * (1 + list_dot_product(x, x)), 9) AS self_influence FROM f")
def self_influence(e):
    return influence.self_influence(features_of(e).withColumnRenamed("id", "train_id"))


# ---- annotation and metrics -------------------------------------------------------------------------------------------

ANNOTATED = """
gt AS (SELECT i.*, CASE WHEN EXISTS (SELECT 1 FROM truth g WHERE g.subject = i.TrainHead AND g.predicate = i.TrainRel_label AND g.object = i.TrainTail) THEN 1 ELSE 0 END AS IsGroundTruth FROM influence i),
pp AS (SELECT drug, disease, list_sort(list(DISTINCT node)) AS nodes FROM members WHERE LEFT(node, 1) = 'S' GROUP BY drug, disease),
an AS (SELECT gt.*, CASE WHEN p.nodes IS NULL THEN 0 WHEN list_contains(list_concat([TestHead], p.nodes, [TestTail]), TrainHead) AND list_contains(list_concat([TestHead], p.nodes, [TestTail]), TrainTail) THEN 1 ELSE 0 END AS In_path,
 CASE WHEN p.nodes IS NULL THEN 0 WHEN len(list_filter(range(1, len(p.nodes) + 2), lambda i: (list_concat([TestHead], p.nodes, [TestTail])[i] = TrainHead AND list_concat([TestHead], p.nodes, [TestTail])[i + 1] = TrainTail) OR (list_concat([TestHead], p.nodes, [TestTail])[i] = TrainTail AND list_concat([TestHead], p.nodes, [TestTail])[i + 1] = TrainHead))) > 0 THEN 1 ELSE 0 END AS On_specific_path
 FROM gt LEFT JOIN pp p ON p.drug = gt.TestHead AND p.disease = gt.TestTail)"""
KEYS = "test_id, TrainHead, TrainRel_label, TrainTail"
AN_VIEWS = ("influence", "truth", "members")


def pair_paths(v) -> DataFrame:
    m = v("members").filter(F.col("node").startswith("S")).select("drug", "disease", F.array("node").alias("nodes"), F.lit(0).alias("pos"))
    return annotate.paths_of_pairs(m, keep="any")


def annotated(v) -> DataFrame:
    return annotate.path_flags(annotate.is_ground_truth(v("influence"), v("truth")), pair_paths(v))


@query(f"WITH {ANNOTATED} SELECT {KEYS}, IsGroundTruth FROM gt", *AN_VIEWS)
def is_ground_truth(v):
    return annotate.is_ground_truth(v("influence"), v("truth")).select("test_id", *annotate.TRAIN, "IsGroundTruth")


@query(f"WITH {ANNOTATED} SELECT {KEYS}, In_path FROM an", *AN_VIEWS)
def in_path(v):
    return annotated(v).select("test_id", *annotate.TRAIN, "In_path")


@query(f"WITH {ANNOTATED} SELECT {KEYS}, On_specific_path FROM an", *AN_VIEWS)
def on_specific_path(v):
    return annotated(v).select("test_id", *annotate.TRAIN, "On_specific_path")


def ranked_edges(v) -> DataFrame:
    return graph.ranked_path_edges(graph.khop_paths(influence_links(v), v("distant"), 2, connecting=True))


def path_edges_with(tail: str) -> str:
    """The ranked path edges and the annotated rows, in one WITH."""
    base = khop_sql(True, 2, "", "distant").rstrip()
    return f"{base}, pe AS (SELECT test_id, path_rank, CAST(i - 1 AS INT) AS edge_pos, nodes[i] AS TrainHead, relations[i] AS TrainRel_label, nodes[i + 1] AS TrainTail FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY test_id ORDER BY mean DESC, path) AS INT) AS path_rank FROM found WHERE connects) r0, UNNEST(range(1, len(nodes))) r(i)),{ANNOTATED} {tail}"


@query(path_edges_with("SELECT pe.test_id, path_rank, edge_pos, pe.TrainHead, pe.TrainRel_label, pe.TrainTail, IsGroundTruth, On_specific_path FROM pe LEFT JOIN an USING (test_id, TrainHead, TrainRel_label, TrainTail)"), "distant", *AN_VIEWS)
def path_edges_with_gt(v):
    return annotate.with_truth(ranked_edges(v).select("test_id", "path_rank", "edge_pos", *annotate.TRAIN), annotated(v)).select("test_id", "path_rank", "edge_pos", *annotate.TRAIN, "IsGroundTruth", "On_specific_path")


@query(path_edges_with("SELECT DISTINCT pe.test_id, pe.TrainHead, pe.TrainRel_label, pe.TrainTail, IsGroundTruth, On_specific_path FROM pe LEFT JOIN an USING (test_id, TrainHead, TrainRel_label, TrainTail) WHERE path_rank <= 3"), "distant", *AN_VIEWS)
def topn_path_edges_gt(v):
    return annotate.top_path_edges(ranked_edges(v), annotated(v), 3).select("test_id", *annotate.TRAIN, "IsGroundTruth", "On_specific_path")


RANKED = "rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY test_id ORDER BY TracInScore DESC, TrainHead, TrainRel_label, TrainTail) AS rank, SUM(In_path) OVER (PARTITION BY test_id ORDER BY TracInScore DESC, TrainHead, TrainRel_label, TrainTail ROWS UNBOUNDED PRECEDING) AS relevant FROM an)"
TIES = ("TrainHead", "TrainRel_label", "TrainTail")


@query(f"WITH {ANNOTATED}, {RANKED}, eg AS (SELECT test_id, MIN(rank) AS fr, AVG(relevant / rank) AS ap FROM rk WHERE In_path = 1 GROUP BY test_id) SELECT (SELECT COUNT(DISTINCT test_id) FROM an) AS groups, COUNT(*) AS covered, ROUND(COALESCE(AVG(1.0 / fr), 0), 6) AS mrr, ROUND(COALESCE(AVG(ap), 0), 6) AS map, ROUND(AVG(fr), 6) AS mean_first_rank, ROUND(MEDIAN(fr), 6) AS median_first_rank, ROUND(COUNT(*) / (SELECT COUNT(DISTINCT test_id) FROM an), 6) AS coverage FROM eg", *AN_VIEWS)
def mrr_map(v):
    return metrics.mrr_map(annotated(v), ["test_id"], "TracInScore", "In_path", *TIES)


@query(f"WITH {ANNOTATED}, {RANKED} SELECT test_id, TrainHead, TrainRel_label, TrainTail, TracInScore, rank FROM rk WHERE In_path = 1", *AN_VIEWS)
def ranked_path_rows(v):
    r = metrics.positions(annotated(v), ["test_id"], "TracInScore", "In_path", *TIES)
    return r.filter("In_path = 1").select("test_id", *TIES, "TracInScore", F.col("rank").cast("long").alias("rank"))


RANKED_SCORES = "rs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tail ORDER BY score DESC, head) AS rank FROM scores)"


@query(f"WITH {RANKED_SCORES} SELECT head, tail, score, CAST(rank AS INT) AS rank FROM rs WHERE is_treat = 1", "scores")
def ranks_within_tail(v):
    w = Window.partitionBy("tail").orderBy(F.col("score").desc(), "head")
    return v("scores").withColumn("rank", F.row_number().over(w)).filter("is_treat = 1").drop("is_treat")


@query(f"WITH {RANKED_SCORES}, hits AS (SELECT rank FROM rs WHERE is_treat = 1) SELECT CAST(k AS INT) AS k, ROUND((SELECT COUNT(*) FROM hits WHERE rank <= k) / (SELECT COUNT(*) FROM hits), 6) AS hit_rate FROM UNNEST(range(1, 101)) r(k)", "scores")
def hit_at_k(v):
    w = Window.partitionBy("tail").orderBy(F.col("score").desc(), "head")
    return metrics.hit_at_k(v("scores").withColumn("rank", F.row_number().over(w)).filter("is_treat = 1"))


@query("SELECT head, tail, score, rank FROM (SELECT head, tail, score, ROW_NUMBER() OVER (ORDER BY score DESC, head, tail) AS rank FROM scores) x", "scores")
def score_ranks(v):
    return global_rank(v("scores").select("head", "tail", "score"), "score", "head", "tail", descending=True)


RATES_SQL = """ROUND((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS precision, ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall, ROUND(COALESCE(tn / NULLIF(tn + fp, 0), 0), 6) AS specificity,
ROUND(COALESCE(tn / NULLIF(tn + fn, 0), 0), 6) AS negative_value, ROUND(COALESCE(fp / NULLIF(fp + tn, 0), 0), 6) AS false_positive_rate, ROUND(COALESCE(fn / NULLIF(fn + tp, 0), 0), 6) AS false_negative_rate, ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1,
ROUND((COALESCE(tp / NULLIF(tp + fn, 0), 0) + COALESCE(tn / NULLIF(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, ROUND((tp + fn) / (tp + tn + fp + fn), 6) AS prevalence,
ROUND(COALESCE((tp::DOUBLE * tn - fp::DOUBLE * fn) / NULLIF(SQRT((tp::DOUBLE + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"""
COUNTS_SQL = "COUNT(*) FILTER (score >= {0} AND is_treat = 1) AS tp, COUNT(*) FILTER (score >= {0} AND is_treat = 0) AS fp, COUNT(*) FILTER (score < {0} AND is_treat = 0) AS tn, COUNT(*) FILTER (score < {0} AND is_treat = 1) AS fn"


@query(f"SELECT *, {RATES_SQL} FROM (SELECT {COUNTS_SQL.format('60')} FROM scores) c", "scores")
def confusion_metrics(v):
    return metrics.confusion(v("scores"), "score", "is_treat", 60.0)


@query(f"SELECT ROUND(th, 6) AS threshold, tp, fp, tn, fn, f1 FROM (SELECT *, {RATES_SQL} FROM (SELECT i, th, {COUNTS_SQL.format('th')} FROM scores, (SELECT i, lo + (hi - lo) * i / 99.0::DOUBLE AS th FROM (SELECT MIN(score) AS lo, MAX(score) AS hi FROM scores) b, UNNEST(range(0, 100)) r(i)) g GROUP BY i, th) c) m ORDER BY m.f1 DESC, i LIMIT 1", "scores")
def best_threshold(v):
    return metrics.best_threshold(v("scores"), "score", "is_treat")


# the scores, and coarser ones: two models of the same pairs
REPORT_SQL = f"""m AS (SELECT 'fine' AS model, score, is_treat FROM scores UNION ALL SELECT 'coarse', FLOOR(score / 10) * 10, is_treat FROM scores),
t AS (SELECT DISTINCT score AS threshold FROM m UNION SELECT CAST(x AS DOUBLE) FROM (VALUES (12.5), (70)) v(x)),
c AS (SELECT model, score, COUNT(*) FILTER (is_treat = 1) AS p, COUNT(*) FILTER (is_treat = 0) AS q FROM m GROUP BY model, score),
f AS (SELECT n.model, t.threshold, COALESCE(c.p, 0) AS p, COALESCE(c.q, 0) AS q FROM t CROSS JOIN (SELECT DISTINCT model FROM m) n LEFT JOIN c ON c.model = n.model AND c.score = t.threshold),
r AS (SELECT model, threshold, CAST(SUM(p) OVER w AS BIGINT) AS tp, CAST(SUM(q) OVER w AS BIGINT) AS fp, CAST(SUM(q) OVER a - SUM(q) OVER w AS BIGINT) AS tn, CAST(SUM(p) OVER a - SUM(p) OVER w AS BIGINT) AS fn FROM f WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY model)),
report AS (SELECT *, {RATES_SQL} FROM r)"""


def reported(v) -> DataFrame:
    s = v("scores").select("score", "is_treat")
    coarse = s.withColumn("score", (F.floor(F.col("score") / 10) * 10).cast("double"))
    return metrics.threshold_report({"fine": (s, "score", "is_treat"), "coarse": (coarse, "score", "is_treat")}, (12.5, 70.0))


@query(f"WITH {REPORT_SQL} SELECT * FROM report", "scores")
def threshold_report(v):
    return reported(v)


@query(f"WITH {REPORT_SQL}, k AS (SELECT model, 'f1' AS metric, threshold, f1 AS value FROM report UNION ALL SELECT model, 'balanced_accuracy', threshold, balanced_accuracy FROM report) SELECT model, metric, ROUND(threshold, 6) AS threshold, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model, metric ORDER BY value DESC, threshold) AS n FROM k) x WHERE n = 1", "scores")
def model_thresholds(v):
    return metrics.best_of_report(reported(v))


# two columns between 0 and 1 for each row of a result file stand for its p-values
P_VALUES = "p AS (SELECT test_id, AVG(TracInScore) - FLOOR(AVG(TracInScore)) AS p_mrr, CASE WHEN COUNT(*) > 3 THEN AVG(SelfInfluence) - FLOOR(AVG(SelfInfluence)) END AS p_map FROM influence GROUP BY test_id)"
MEASURE = "SELECT '{0}' AS measure, {1} AS p, COALESCE(p_{2} < 0.05, FALSE) AS m5, COALESCE(p_{2} < 0.01, FALSE) AS m1 FROM p"


@query(f"WITH {P_VALUES}, k AS ({MEASURE.format('p_mrr', 'p_mrr', 'mrr')} UNION ALL {MEASURE.format('p_map', 'p_map', 'map')} UNION ALL SELECT 'all', NULL, COALESCE(p_mrr < 0.05, FALSE) AND COALESCE(p_map < 0.05, FALSE), COALESCE(p_mrr < 0.01, FALSE) AND COALESCE(p_map < 0.01, FALSE) FROM p UNION ALL SELECT 'any', NULL, COALESCE(p_mrr < 0.05, FALSE) OR COALESCE(p_map < 0.05, FALSE), COALESCE(p_mrr < 0.01, FALSE) OR COALESCE(p_map < 0.01, FALSE) FROM p) SELECT measure, COUNT(*) AS tests, ROUND(AVG(p), 6) AS mean_p, ROUND(MEDIAN(p), 6) AS median_p, COUNT(*) FILTER (m5) AS significant_05, ROUND(100.0 * COUNT(*) FILTER (m5) / COUNT(*), 6) AS percent_05, COUNT(*) FILTER (m1) AS significant_01, ROUND(100.0 * COUNT(*) FILTER (m1) / COUNT(*), 6) AS percent_01 FROM k GROUP BY measure", "influence")
def significance_counts(v):
    """Exact means, as the side of a level on which the fraction of a mean like 2.01 lies depends on its last bit."""
    p = v("influence").groupBy("test_id").agg(metrics.exact_mean("TracInScore").alias("a"), metrics.exact_mean("SelfInfluence").alias("b"), F.count("*").alias("n"))
    p = p.select((F.col("a") - F.floor("a")).alias("p_mrr"), F.when(F.col("n") > 3, F.col("b") - F.floor("b")).alias("p_map"))
    return metrics.significance(p, ["p_mrr", "p_map"])


ROC_SQL = "by_score AS (SELECT score, COUNT(*) FILTER (is_treat = 1) AS p, COUNT(*) FILTER (is_treat = 0) AS q FROM scores GROUP BY score), pt AS (SELECT score, CAST(SUM(p) OVER w AS BIGINT) AS tp, CAST(SUM(q) OVER w AS BIGINT) AS fp, CAST(SUM(p) OVER () AS BIGINT) AS ps, CAST(SUM(q) OVER () AS BIGINT) AS qs FROM by_score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {ROC_SQL} SELECT score, ROUND(fp / qs, 6) AS fpr, ROUND(tp / ps, 6) AS tpr FROM pt", "scores")
def roc_points(v):
    return metrics.roc(v("scores"), "score", "is_treat").select("score", "fpr", "tpr")


@query(f"WITH {ROC_SQL} SELECT ROUND(SUM((fp - pf) * (tp + pt0) / 2) / ANY_VALUE(ps * qs), 6) AS auc FROM (SELECT *, COALESCE(LAG(fp) OVER (ORDER BY score DESC), 0) AS pf, COALESCE(LAG(tp) OVER (ORDER BY score DESC), 0) AS pt0 FROM pt) x", "scores")
def auc(v):
    return metrics.auc(v("scores"), "score", "is_treat")


@query("SELECT test_id, TrainHead, TrainRel_label, TrainTail, TracInScore, category, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY test_id, category ORDER BY TracInScore DESC, TrainHead, TrainRel_label, TrainTail) AS rank FROM (SELECT *, CASE WHEN TrainHead = TestHead AND TrainTail = TestTail THEN 'both' WHEN TrainHead = TestHead THEN 'shares_head' WHEN TrainTail = TestTail THEN 'shares_tail' ELSE 'neither' END AS category FROM influence) c) x WHERE rank <= 10", "influence")
def overlap_categories(v):
    r = annotate.overlap_category(v("influence"))
    return top_k(r, ["test_id", "category"], 10, F.col("TracInScore").desc(), *TIES).select("test_id", *TIES, "TracInScore", "category", "rank")


@query("WITH a AS (SELECT tail, ROUND(AVG(value), 6) AS x, COUNT(*) + 0.0 AS y FROM ev GROUP BY tail), r AS (SELECT x, y, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM a) SELECT COUNT(*) AS n, ROUND(CORR(x, y), 6) AS pearson, ROUND(CORR(rx, ry), 6) AS spearman, ROUND(REGR_SLOPE(y, x), 6) AS slope, ROUND(REGR_INTERCEPT(y, x), 6) AS intercept FROM r", "ev")
def correlation(v):
    a = v("ev").groupBy("tail").agg(F.round(F.avg("value"), 6).alias("x"), F.count("*").cast("double").alias("y"))
    return metrics.correlation(a, "x", "y")


# ---- statistics ------------------------------------------------------------------------------------------------------------


@query("WITH m AS (SELECT relation, MEDIAN(value) AS md FROM ev GROUP BY relation), d AS (SELECT e.relation, value, md, ABS(value - md) AS d FROM ev e JOIN m USING (relation)), s AS (SELECT relation, ANY_VALUE(md) AS md, MEDIAN(d) AS mad FROM d GROUP BY relation) SELECT relation, ROUND(ANY_VALUE(md), 6) AS median, ROUND(ANY_VALUE(mad), 6) AS mad, ROUND(ANY_VALUE(md + 3 * mad), 6) AS threshold, COUNT(*) FILTER (value > md + 3 * mad) AS outliers FROM ev JOIN s USING (relation) GROUP BY relation", "ev")
def mad_outliers(v):
    return stats.mad_outliers(v("ev"), ["relation"], "value")


@query("WITH s AS (SELECT relation, AVG(value) AS mean, STDDEV_SAMP(value) AS sd FROM ev GROUP BY relation) SELECT relation, ROUND(ANY_VALUE(mean), 6) AS mean, ROUND(ANY_VALUE(sd), 6) AS sd, COUNT(*) FILTER (value > mean + 3 * sd) AS outliers FROM ev JOIN s USING (relation) GROUP BY relation", "ev")
def sigma_outliers(v):
    return stats.sigma_outliers(v("ev"), ["relation"], "value")


def side_sql(name: str, flag: str) -> str:
    x = f"CASE WHEN {flag} THEN score END"
    return f"COUNT({x}) AS n_{name}, AVG({x}) AS mean_{name}, MEDIAN({x}) AS median_{name}, STDDEV_SAMP({x}) AS sd_{name}, QUANTILE_CONT({x}, 0.25) AS q25_{name}, QUANTILE_CONT({x}, 0.75) AS q75_{name}"


@query("SELECT n_on, n_off, " + ", ".join(f"ROUND({c}_{s}, 6) AS {c}_{s}" for s in ("on", "off") for c in ("mean", "median", "sd", "q25", "q75")) + f", ROUND((mean_on - mean_off) / SQRT(((n_on - 1) * sd_on * sd_on + (n_off - 1) * sd_off * sd_off) / (n_on + n_off - 2)), 6) AS cohens_d FROM (SELECT {side_sql('on', 'is_treat = 1')}, {side_sql('off', 'is_treat = 0')} FROM scores) x", "scores")
def cohens_d(v):
    return stats.two_sample(v("scores"), "score", "is_treat")


@query("WITH r AS (SELECT is_treat, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scores) SELECT COUNT(*) FILTER (is_treat = 1) AS n_on, COUNT(*) FILTER (is_treat = 0) AS n_off, ROUND(SUM(rk) FILTER (is_treat = 1) - COUNT(*) FILTER (is_treat = 1) * (COUNT(*) FILTER (is_treat = 1) + 1) / 2, 6) AS u FROM r", "scores")
def mann_whitney_u(v):
    return stats.mann_whitney_u(v("scores"), "score", "is_treat")


@query("WITH b AS (SELECT score, COUNT(*) FILTER (is_treat = 1) AS p, COUNT(*) FILTER (is_treat = 0) AS q FROM scores GROUP BY score) SELECT ROUND(MAX(ABS(a / pa - c / qa)), 6) AS ks FROM (SELECT SUM(p) OVER w AS a, SUM(q) OVER w AS c, SUM(p) OVER () AS pa, SUM(q) OVER () AS qa FROM b WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)) x", "scores")
def ks_stat(v):
    return stats.ks_statistic(v("scores"), "score", "is_treat")


@query("WITH s AS (SELECT COUNT(score) AS n, STDDEV_SAMP(score) AS sd, MIN(score) AS lo, MAX(score) AS hi FROM scores), g AS (SELECT CAST(i AS INT) AS i, lo + (hi - lo) * i / 49.0::DOUBLE AS x, n, sd * POW(n, -0.2) AS h FROM s, UNNEST(range(0, 50)) r(i)) SELECT i, ROUND(x, 9) AS x, ROUND(SUM(EXP(-0.5 * ((x - score) / h) * ((x - score) / h))) / ANY_VALUE(n * h * SQRT(2 * PI())), 9) AS density FROM g, scores GROUP BY i, x", "scores")
def kernel_density(v):
    return stats.kde(v("scores"), "score", 50)


@query()
def distribution_report(v):
    return stats.distribution_report(annotated(v), "test_id", "TracInScore", "In_path")


@query()
def permutation_test(v):
    return stats.permutation_test(annotated(v), "test_id", "TracInScore", "In_path")


# ---- the rest ----------------------------------------------------------------------------------------------------------------


@query("SELECT curie, CASE split_part(curie, ':', 1) WHEN 'C' THEN 'C' WHEN 'NCIT' THEN 'NC' WHEN 'REACT' THEN 'RE' WHEN 'CAID' THEN 'CA' ELSE LEFT(split_part(curie, ':', 1), 2) END AS type, replace(replace(replace(curie, ':', '_'), '/', '_'), ' ', '_') AS file_name FROM (SELECT subject AS curie FROM edges UNION SELECT object FROM edges) x", "edges")
def curie_types(v):
    c = v("edges").select(F.explode(F.array("subject", "object")).alias("curie")).distinct()
    return c.select("curie", X.entity_type("curie").alias("type"), X.sanitize_name("curie").alias("file_name"))


@query("SELECT path_id, CAST(COUNT(DISTINCT node) AS INT) AS nodes, MIN(node) AS first FROM members GROUP BY path_id", "members")
def parsed_lists(v):
    text = v("members").groupBy("path_id").agg(X.format_list(F.collect_set("node")).alias("t"))
    nodes = X.parse_list("t")
    return text.select("path_id", F.size(nodes).alias("nodes"), F.element_at(nodes, 1).alias("first"))


@query("SELECT head, tail, score FROM scores WHERE score > 84 AND head LIKE '%1%' AND TRIM(tail) <> ''", "scores")
def plain_filters(v):
    return v("scores").filter((F.col("score") > 84) & F.col("head").contains("1") & (F.trim("tail") != "")).na.drop(subset=["score"]).select("head", "tail", "score")


@query("SELECT test_id, head, relation, tail FROM tests ORDER BY test_id LIMIT 10 OFFSET 5", "tests")
def test_page(v):
    from kgspark.operators.adapters import page

    return page(v("tests").select("test_id", "head", "relation", "tail"), 5, 10, "test_id")


@query("SELECT head, tail, score, 'high' AS band FROM scores WHERE score >= 60 UNION ALL SELECT head, tail, score, 'low' FROM scores WHERE score < 40", "scores")
def tagged_union(v):
    from kgspark.operators.adapters import tagged_union as union

    s = v("scores").select("head", "tail", "score")
    return union({"high": s.filter("score >= 60"), "low": s.filter("score < 40")}, "band")


@query("SELECT n.id, n.name, COALESCE(a.score, b.score) AS score FROM (SELECT 'K:' || split_part(id, ':', 2) AS id, 'K:' || CAST(LENGTH(id) AS VARCHAR) AS name FROM nodes) n LEFT JOIN (SELECT tail, MAX(score) AS score FROM scores GROUP BY tail) a ON a.tail = n.id LEFT JOIN (SELECT tail, MAX(score) AS score FROM scores GROUP BY tail) b ON b.tail = n.name", "nodes", "scores")
def score_lookup(v):
    """Scores by identifier, or else by name."""
    best = v("scores").groupBy("tail").agg(F.max("score").alias("score"))
    n = v("nodes").select(F.concat(F.lit("K:"), F.split_part("id", F.lit(":"), F.lit(2))).alias("id"), F.concat(F.lit("K:"), F.length("id").cast("string")).alias("name"))
    a = best.select(F.col("tail").alias("id"), F.col("score").alias("__a"))
    b = best.select(F.col("tail").alias("name"), F.col("score").alias("__b"))
    return n.join(a, "id", "left").join(b, "name", "left").select("id", "name", F.coalesce("__a", "__b").alias("score"))


FEATURES_SQL = "[CAST(LENGTH({0}.head) AS DOUBLE), CAST(LENGTH({0}.tail) AS DOUBLE)]"


@query(filter_sql("pyg").replace("SELECT test_id, head, relation, tail FROM kept", "SELECT k.test_id, k.head AS TrainHead, k.relation AS TrainRel_label, k.tail AS TrainTail, ROUND(0.001 * (CAST(LENGTH(k.relation) AS DOUBLE) * LENGTH(t.relation) + 1) * (1 + CAST(LENGTH(k.head) AS DOUBLE) * LENGTH(t.head) + CAST(LENGTH(k.tail) AS DOUBLE) * LENGTH(t.tail)), 9) AS TracInScore, ROUND(0.001 * (CAST(LENGTH(t.relation) AS DOUBLE) * LENGTH(t.relation) + 1) * (1 + CAST(LENGTH(t.head) AS DOUBLE) * LENGTH(t.head) + CAST(LENGTH(t.tail) AS DOUBLE) * LENGTH(t.tail)), 9) AS SelfInfluence FROM kept k JOIN tests t ON t.test_id = k.test_id"), "triples", "tests")
def explain_tests(v):
    """Filter, influence and self influence in one plan; lengths of names stand in for learned features."""
    from kgspark.plans.pipeline import explain

    t = v("triples").distinct()
    number = lambda c: F.length(c).cast("double")
    features = t.select("*", F.array(number("head"), number("tail")).alias("x"), F.array(number("relation"), F.lit(1.0)).alias("delta"))
    return explain(v("triples"), v("tests"), features).select("test_id", "TrainHead", "TrainRel_label", "TrainTail", "TracInScore", "SelfInfluence")


def projected(e: DataFrame) -> DataFrame:
    return influence.project(e.select("id", "vector"), "vector", 16)


QUERIES["random_projection"] = vectors(projected)


def conv_scored(e: DataFrame) -> DataFrame:
    """Scores of the convolutional forward pass over the candidate pairs, with weights drawn from a seed."""
    import numpy as np

    n = e.agg(F.max("id")).first()[0] + 1
    rng = np.random.default_rng(5)
    w = {"entities": rng.normal(size=(n, 8)), "relations": rng.normal(size=(10, 8)), "conv": rng.normal(size=(4, 1, 2, 2)), "conv_bias": rng.normal(size=4)}
    w |= {"fc": rng.normal(size=(4 * 3 * 3, 8)), "fc_bias": rng.normal(size=8)} | {f"{b}_{k}": np.ones(s) if k == "scale" else np.zeros(s) for b, s in (("bn0", 1), ("bn1", 4), ("bn2", 8)) for k in ("scale", "shift")}
    pairs = pairs_of(e).join(e.select(F.col("id").alias("head"), F.col("label").cast("long").alias("r")), "head")
    return score.conv_scores(pairs.select(F.col("head").alias("h"), "r", F.col("tail").alias("t")), score.ConvScorer(w, 4, 2))


QUERIES["conv_scores"] = vectors(conv_scored)


# ---- the convolutional model over the table's own vectors ------------------------------------------------------------------


def conv_model():
    """A convolutional scorer of 64 components (8 x 8), relations 0 to 9 and layers drawn from a seed; entities are a table."""
    import numpy as np

    rng = np.random.default_rng(8)
    w = {"relations": rng.normal(0, 0.3, (10, 64)), "conv": rng.normal(0, 0.5, (4, 1, 3, 3)), "conv_bias": rng.normal(0, 0.1, 4), "fc": rng.normal(0, 0.1, (4 * 6 * 14, 64)), "fc_bias": rng.normal(0, 0.1, 64)}
    w |= {f"{b}_{k}": (rng.uniform(0.5, 1.5, s) if k == "scale" else rng.normal(0, 0.1, s)) for b, s in (("bn0", 1), ("bn1", 4), ("bn2", 64)) for k in ("scale", "shift")}
    return score.ConvScorer(w, 8, 8)


def labelled_links(e: DataFrame) -> DataFrame:
    """id, h, r, t: the candidate pairs, with the label as relation."""
    r = e.select(F.col("id").alias("head"), F.col("label").cast("long").alias("r"))
    return pairs_of(e).join(r, "head").select(F.col("head").alias("id"), F.col("head").alias("h"), "r", F.col("tail").alias("t"))


def conv_ranks(e: DataFrame, side: str) -> DataFrame:
    """Rank of the true tail, or head, of every pair among all vectors of other labels."""
    links, entities, scorer = labelled_links(e).withColumnRenamed("id", "query_id"), e.select("id", "vector"), conv_model()
    truth = score.conv_truth(links, entities, scorer, side)
    group = links.select("query_id", F.col("r").cast("int").alias("group"))
    if side == "tail":
        return score.count_ranks(score.conv_queries(links, entities, scorer).join(group, "query_id"), answering(e), truth).select("query_id", "tail", "score", "rank")
    heads = score.head_queries(links, entities).join(group, "query_id")
    return score.count_ranks(heads, answering(e), truth, scores=score.head_scores(scorer), by="r").select("query_id", F.col("tail").alias("head"), "score", "rank")


QUERIES["conv_tail_ranks"] = vectors(lambda e: conv_ranks(e, "tail"))
QUERIES["conv_head_ranks"] = vectors(lambda e: conv_ranks(e, "head"))


def layer_influence(e: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """The 10 training pairs (other labels) of strongest influence on each test pair (label 0), by gradients over the layers."""
    links, entities = labelled_links(e), e.select("id", "vector")
    found = [gradients.inputs_of(x, entities) for x in (links.filter("r = 0"), links.filter("r <> 0"))]
    return influence.best_influences(*found, 10, late=gradients.late_gradients(links, conv_model(), layers))


QUERIES["layer_influence_last"] = vectors(lambda e: layer_influence(e, gradients.last_layers()))
QUERIES["layer_influence_all"] = vectors(lambda e: layer_influence(e, gradients.LAYERS))


def sketch_influence(e: DataFrame) -> DataFrame:
    """The same from sketches of 256 values over all layers."""
    links, entities = labelled_links(e), e.select("id", "vector")
    found = [gradients.sketched(x, entities, conv_model()) for x in (links.filter("r = 0"), links.filter("r <> 0"))]
    return influence.best_influences(*found, 10)


QUERIES["layer_influence_sketch"] = vectors(sketch_influence)
