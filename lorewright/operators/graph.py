"""The knowledge graph: triples, dictionaries, adjacency, lookup, neighbourhoods, propagated vectors, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import page_title
from ..joins import grid, lookup, numbered, running, so_far
from ..registry import query, read, workspace
from ..sources.files import read_json_lines, read_triples, write_json_lines, write_triples
from ..staging import scratch, stage
from .indexes import holds
from .retrieval import QUERY_BLOCK, ROW_BLOCK, n_blocks, packed, unit

KG_SQL = """kg AS (
  SELECT 'Supplier#' || s_suppkey AS head, 'links_to' AS relation, n_name AS tail, 'Supplier#' || s_suppkey AS source_title, s_suppkey::BIGINT AS revid FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'is_a', 'Category:' || r_name, n_name, n_nationkey::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Customer#' || c_custkey, 'links_to', n_name, 'Customer#' || c_custkey, c_custkey::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Part ' || p_partkey, 'has_brand', p_brand, 'Part ' || p_partkey, p_partkey::BIGINT FROM part
  UNION ALL SELECT 'Part ' || p_partkey, 'is_a', 'Category:' || p_type, 'Part ' || p_partkey, p_partkey::BIGINT FROM part)"""


def kg(spark: SparkSession, d: str) -> DataFrame:
    """Triples (head, relation, tail, source_title, revid) over the star schema."""
    t = lambda n: read(spark, d, n)
    nation = t("nation")

    def triple(df: DataFrame, head: Column, relation: str, tail: Column, revid: str) -> DataFrame:
        return df.select(head.alias("head"), F.lit(relation).alias("relation"), tail.alias("tail"), head.alias("source_title"), F.col(revid).cast("long").alias("revid"))

    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    part = t("part")
    return (
        triple(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), name("Supplier#", "s_suppkey"), "links_to", F.col("n_name"), "s_suppkey")
        .unionByName(triple(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_name"), "is_a", name("Category:", "r_name"), "n_nationkey"))
        .unionByName(triple(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), name("Customer#", "c_custkey"), "links_to", F.col("n_name"), "c_custkey"))
        .unionByName(triple(part, name("Part ", "p_partkey"), "has_brand", F.col("p_brand"), "p_partkey"))
        .unionByName(triple(part, name("Part ", "p_partkey"), "is_a", name("Category:", "p_type"), "p_partkey"))
    )


_ANCHOR = r'<a href="/([^"#:]+)"'


@query("kg_html_links", f"SELECT page_id, replace(unnest(regexp_extract_all(html, '{_ANCHOR}', 1)), '_', ' ') AS target FROM pages")
def kg_html_links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1))).alias("t")).select("page_id", F.replace("t", F.lit("_"), F.lit(" ")).alias("target"))


_PAGE = "page_id, html, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang"


@query(
    "kg_triples",
    f"""WITH p AS (SELECT {_PAGE} FROM pages)
    SELECT title AS head, 'is_a' AS relation, 'Category:' || lang AS tail, title AS source_title, page_id AS revid FROM p WHERE lang <> ''
    UNION ALL SELECT title, 'has_host', host, title, page_id FROM p
    UNION ALL SELECT title, 'links_to', replace(unnest(regexp_extract_all(html, '{_ANCHOR}', 1)), '_', ' '), title, page_id FROM p""",
)
def kg_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples of the pages: their category, their host, and their links."""
    p = read(spark, d, "pages").select(
        "page_id", page_title(F.col("html")).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)).alias("links"),
    )
    edge = lambda r, t: F.struct(F.lit(r).alias("relation"), t.alias("tail"))
    own = F.array(F.when(F.col("lang") != "", edge("is_a", F.concat(F.lit("Category:"), "lang"))), edge("has_host", F.col("host")))
    links = F.transform("links", lambda x: edge("links_to", F.replace(x, F.lit("_"), F.lit(" "))))
    # one scan, one explode: no union of three scans
    e = p.select("page_id", "title", F.explode(F.concat(F.array_compact(own), links)).alias("e"))
    return e.select(F.col("title").alias("head"), "e.relation", "e.tail", F.col("title").alias("source_title"), F.col("page_id").alias("revid"))


@query("kg_nodes", f"WITH p AS (SELECT {_PAGE} FROM pages) SELECT title, [lang] AS categories, page_id AS revid FROM p")
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(page_title(F.col("html")).alias("title"), F.array(F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).alias("categories"), F.col("page_id").alias("revid"))


def entity_ids(triples: DataFrame, start: int = 0) -> DataFrame:
    """(label, id): ids from `start` in the order of first appearance. Rows are ordered by (revid, head, relation,
    tail), a head before its tail. Labels are numbered by ranges of that order, whatever the revids are."""
    order = F.struct("revid", "head", "relation", "tail")
    both = triples.select(order.alias("o"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("head").alias("label")), F.struct(F.lit(1).alias("side"), F.col("tail").alias("label")))).alias("e"))
    first = both.groupBy("e.label").agg(F.min(F.struct("o", "e.side")).alias("first"))
    return numbered(first, [F.col("first")], "id").select("label", (F.col("id") + start).alias("id"))


_IDS_SQL = """fa AS (SELECT label, min((revid, head, relation, tail, side)) AS f FROM (
    SELECT head AS label, revid, head, relation, tail, 0 AS side FROM {kg} UNION ALL SELECT tail, revid, head, relation, tail, 1 FROM {kg}) GROUP BY label),
  ids AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS id FROM fa)"""


@query("kg_entity_ids", f"WITH {KG_SQL}, {_IDS_SQL.format(kg='kg')} SELECT * FROM ids")
def kg_entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return entity_ids(kg(spark, d))


@query(
    "kg_entity_ids_resume",
    f"""WITH {KG_SQL}, old_kg AS (SELECT * FROM kg WHERE revid <= 50), {_IDS_SQL.format(kg='old_kg')},
    new_kg AS (SELECT * FROM kg WHERE revid > 50), {_IDS_SQL.format(kg='new_kg').replace('fa AS', 'fb AS').replace('FROM fa', 'FROM fb').replace('ids AS', 'ids2 AS')}
    SELECT label, id FROM ids UNION ALL
    SELECT label, (SELECT count(*) FROM ids) + row_number() OVER (ORDER BY id) - 1 FROM ids2 WHERE label NOT IN (SELECT label FROM ids)""",
)
def kg_entity_ids_resume(spark: SparkSession, d: str) -> DataFrame:
    """Known labels keep their ids; new ones go on after the last."""
    t = kg(spark, d)
    old = stage(entity_ids(t.filter("revid <= 50")), "ids")
    new = entity_ids(t.filter("revid > 50")).join(old, "label", "left_anti")
    start = old.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    return old.unionByName(numbered(new.withColumnRenamed("id", "at"), [F.col("at")], "id").select("label", (F.col("id") + start).alias("id")))


@query("kg_relation_ids", f"WITH {KG_SQL} SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS id FROM (SELECT DISTINCT relation FROM kg)")
def kg_relation_ids(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d).select("relation").distinct().select("relation", (F.row_number().over(W.orderBy("relation")) - 1).cast("long").alias("id"))


def adjacency(triples: DataFrame) -> DataFrame:
    """(src, dst, weight): both directions of every triple, multiplicities summed; a self loop counts twice."""
    both = triples.select(F.explode(F.array(F.struct(F.col("head").alias("src"), F.col("tail").alias("dst")), F.struct(F.col("tail").alias("src"), F.col("head").alias("dst")))).alias("e"))
    return both.groupBy("e.src", "e.dst").agg(F.count("*").cast("double").alias("weight"))


_ADJ_SQL = "adj AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT head AS src, tail AS dst FROM kg UNION ALL SELECT tail, head FROM kg) GROUP BY ALL)"


@query("kg_adjacency", f"WITH {KG_SQL}, {_ADJ_SQL} SELECT * FROM adj")
def kg_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return adjacency(kg(spark, d))


@query("kg_edge_counts", f"WITH {KG_SQL}, {_ADJ_SQL} SELECT count(DISTINCT src) AS nodes, count(*) // 2 AS edges FROM adj")
def kg_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return adjacency(kg(spark, d)).agg(F.countDistinct("src").alias("nodes"), F.floor(F.count("*") / 2).alias("edges"))


@query("kg_adjacency_sets", f"WITH {KG_SQL} SELECT head AS title, coalesce(list_sort(list(DISTINCT tail) FILTER (relation = 'links_to')), []) AS links, coalesce(list_sort(list(DISTINCT tail) FILTER (relation = 'is_a')), []) AS categories FROM kg GROUP BY head")
def kg_adjacency_sets(spark: SparkSession, d: str) -> DataFrame:
    of = lambda r: F.array_sort(F.collect_set(F.when(F.col("relation") == r, F.col("tail"))))
    return kg(spark, d).groupBy(F.col("head").alias("title")).agg(of("links_to").alias("links"), of("is_a").alias("categories"))


@query("kg_statistics", f"WITH {KG_SQL} SELECT (SELECT count(*) FROM (SELECT head FROM kg UNION SELECT tail FROM kg)) AS entities, (SELECT max(len(embedding)) FROM embeddings) AS dimension, count(DISTINCT relation) AS relations, count(*) AS triples, list_sort(list(DISTINCT relation))[1:20] AS relation_names FROM kg")
def kg_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = kg(spark, d)
    entities = t.select(F.explode(F.array("head", "tail")).alias("e")).distinct().agg(F.count("*").alias("entities"))
    # all sides are one row
    entities = entities.join(F.broadcast(read(spark, d, "embeddings").agg(F.max(F.size("embedding")).alias("dimension"))))
    return entities.join(F.broadcast(t.agg(F.countDistinct("relation").alias("relations"), F.count("*").alias("triples"), F.slice(F.array_sort(F.collect_set("relation")), 1, 20).alias("relation_names"))))


@query("kg_split", f"WITH {KG_SQL} SELECT head, relation, tail, CASE WHEN substring(md5(head || '|' || relation || '|' || tail), 1, 2) < 'e6' THEN 'train' WHEN substring(md5(head || '|' || relation || '|' || tail), 1, 2) < 'f3' THEN 'valid' ELSE 'test' END AS part FROM kg")
def kg_split(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d).select("head", "relation", "tail", split_part().alias("part"))


def split_part() -> Column:
    """About 90, 5 and 5 per cent, by the hash of the triple: the same on every run and every cluster."""
    h = F.substring(F.md5(F.concat_ws("|", "head", "relation", "tail")), 1, 2)
    return F.when(h < "e6", "train").when(h < "f3", "valid").otherwise("test")


@query(
    "kg_relationships",
    f"""WITH {KG_SQL}, q AS (SELECT lower(n_name) AS entity FROM nation)
    SELECT entity, CASE WHEN contains(lower(head), entity) THEN 'outgoing' ELSE 'incoming' END AS direction, relation, CASE WHEN contains(lower(head), entity) THEN tail ELSE head END AS other
    FROM q JOIN kg ON contains(lower(head), entity) OR contains(lower(tail), entity)""",
)
def kg_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose head or tail contains a queried name; the head wins. Labels are found by an index of their trigrams."""
    with scratch(spark) as keep:
        triples = stage(kg(spark, d).select("head", "relation", "tail"), "triples")
        labels = triples.select(F.explode(F.array("head", "tail")).alias("label")).distinct()
        names = read(spark, d, "nation").select(F.lower("n_name").alias("needle")).distinct()
        found = stage(holds(labels.select(F.lower("label").alias("text")).distinct(), names), "found")
        named = lambda end: triples.join(found, F.lower(end) == F.col("text")).select("head", "relation", "tail", F.col("needle").alias("entity"))
        out = named("head").withColumn("direction", F.lit("outgoing"))
        back = named("tail").filter(~F.contains(F.lower("head"), F.col("entity"))).withColumn("direction", F.lit("incoming"))
        other = F.when(F.col("direction") == "outgoing", F.col("tail")).otherwise(F.col("head"))
        return keep(stage(out.unionByName(back).select("entity", "direction", "relation", other.alias("other")), "relationships"))


def neighborhood(triples: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, entity, hop): breadth first, each entity at its least hop. A frontier step is a join and an anti join."""
    edges = triples.select(F.explode(F.array(F.struct(F.col("head").alias("a"), F.col("tail").alias("b")), F.struct(F.col("tail").alias("a"), F.col("head").alias("b")))).alias("e")).select("e.*").distinct()
    seen = seeds.select("seed", F.col("seed").alias("entity"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(edges, frontier["entity"] == edges["a"]).select("seed", F.col("b").alias("entity")).distinct()
        frontier = step.join(seen.select("seed", "entity"), ["seed", "entity"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


@query(
    "kg_neighborhood",
    f"""WITH RECURSIVE {KG_SQL}, e AS (SELECT head AS a, tail AS b FROM kg UNION SELECT tail, head FROM kg),
    r AS (SELECT 'Supplier#' || s_suppkey AS seed, 'Supplier#' || s_suppkey AS entity, 0 AS hop FROM supplier WHERE s_suppkey % 100 = 0
      UNION SELECT seed, b, hop + 1 FROM r JOIN e ON entity = a WHERE hop < 2)
    SELECT seed, entity, min(hop) AS hop FROM r GROUP BY ALL""",
)
def kg_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    seeds = read(spark, d, "supplier").filter("s_suppkey % 100 = 0").select(F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")).alias("seed"))
    return neighborhood(kg(spark, d), seeds, 2)


_ASKED_SQL = "q AS (SELECT lower(n_name) AS q FROM nation UNION SELECT lower(p_brand) FROM part UNION SELECT 'er#' || s_suppkey % 50 FROM supplier UNION SELECT lower(substring(p_type, 2, 4)) FROM part UNION SELECT 'no such name' FROM region UNION SELECT 'y:' FROM region)"


@query(
    "kg_entity_resolve",
    f"""WITH {KG_SQL}, {_IDS_SQL.format(kg='kg')}, {_ASKED_SQL}
    SELECT q AS name, arg_min(label, (CASE WHEN lower(label) = q THEN 0 ELSE 1 END, id)) AS label FROM q JOIN ids ON contains(lower(label), q) GROUP BY q""",
)
def kg_entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """An exact match, else the first label by id that contains the name; for whole and partial names, found and not found."""
    part, one = read(spark, d, "part"), lambda df, c: df.select(c.alias("needle"))
    names = one(read(spark, d, "nation"), F.lower("n_name")).union(one(part, F.lower("p_brand"))).union(one(part, F.lower(F.substring("p_type", 2, 4))))
    names = names.union(one(read(spark, d, "supplier"), F.concat(F.lit("er#"), (F.col("s_suppkey") % 50).cast("string")))).union(one(read(spark, d, "region"), F.explode(F.array(F.lit("no such name"), F.lit("y:"))))).distinct()
    with scratch(spark) as keep:
        ids = stage(entity_ids(kg(spark, d)).withColumn("text", F.lower("label")), "ids")
        found = holds(ids.select("text").distinct(), names)
        best = ids.join(found, "text").groupBy(F.col("needle").alias("name")).agg(F.min_by("label", F.struct((F.col("text") != F.col("needle")).alias("x"), "id")).alias("label"))
        return keep(stage(best, "resolved"))


@query("kg_by_relation", f"WITH {KG_SQL} SELECT head, relation, tail FROM kg WHERE contains(relation, 'brand') ORDER BY revid, head, relation, tail LIMIT 50")
def kg_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d).filter(F.contains("relation", F.lit("brand"))).orderBy("revid", "head", "relation", "tail").limit(50).select("head", "relation", "tail")


@query("kg_entity_docs", f"WITH {KG_SQL}, {_IDS_SQL.format(kg='kg')} SELECT id AS entity_id, label AS title, 'Knowledge graph entity: ' || label AS text, 'https://wiki.example.org/w/' || replace(label, ' ', '_') AS url, 'kg' AS source, TRUE AS kg_entity FROM ids")
def kg_entity_docs(spark: SparkSession, d: str) -> DataFrame:
    return entity_ids(kg(spark, d)).select(
        F.col("id").alias("entity_id"), F.col("label").alias("title"), F.concat(F.lit("Knowledge graph entity: "), "label").alias("text"),
        F.concat(F.lit("https://wiki.example.org/w/"), F.replace("label", F.lit(" "), F.lit("_"))).alias("url"), F.lit("kg").alias("source"), F.lit(True).alias("kg_entity"),
    )


@query("kg_entity_sample", f"WITH {KG_SQL}, {_IDS_SQL.format(kg='kg')} SELECT id, label FROM ids ORDER BY id LIMIT 25")
def kg_entity_sample(spark: SparkSession, d: str) -> DataFrame:
    return entity_ids(kg(spark, d)).orderBy("id").limit(25).select("id", "label")


def hash_vector(label: Column, dim: int) -> Column:
    """A vector of +1, -1 from the digits of the label's md5."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.when(F.substring(F.md5(label), i, 1) < "8", 1.0).otherwise(-1.0))


def propagate(adj: DataFrame, dim: int = 8, rounds: int = 2) -> list[DataFrame]:
    """For each round (node, v): hash-seeded vectors, replaced in each round by the weighted mean of the neighbours'.

    adj is a stored table, joined once a round; vectors stay whole and are summed by component in one aggregate, combined
    map-side. Vectors of hubs go to their edges by broadcast (lookup), the others by a shuffle. Each round is stored.
    """
    v = adj.select(F.col("src").alias("dst")).distinct()
    v = stage(v.select("dst", hash_vector(F.col("dst"), dim).alias("v")), "seeds")
    found = []
    for _ in range(rounds):
        sums = lookup(adj, v, ["dst"], 8 * dim + 60).groupBy("src").agg(F.sum("weight").alias("w"), *(F.sum(F.col("weight") * F.col("v")[i]).alias(f"c{i}") for i in range(dim)))
        v = stage(sums.select(F.col("src").alias("dst"), F.array(*(F.col(f"c{i}") / F.col("w") for i in range(dim))).alias("v")), "vectors")
        found.append(v.withColumnRenamed("dst", "node"))
    return found


_STEP = "SELECT src AS node, component, sum(weight * value) / sum(weight) AS value FROM adj JOIN {v} ON dst = node GROUP BY src, component"


@query(
    "kg_propagate",
    f"""WITH {KG_SQL}, {_ADJ_SQL}, v0 AS (SELECT node, i - 1 AS component, CASE WHEN substring(md5(node), i, 1) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE AS value
      FROM (SELECT DISTINCT src AS node FROM adj), (SELECT unnest(range(1, 9))::INT AS i)), v1 AS ({_STEP.format(v='v0')}), v2 AS ({_STEP.format(v='v1')})
    SELECT node, component, round(value, 9) AS value FROM v2""",
)
def kg_propagate(spark: SparkSession, d: str) -> DataFrame:
    v = entity_vectors(kg(spark, d))
    return v.select("node", F.posexplode("v").alias("component", "value")).withColumn("value", F.round("value", 9))


_VECTORS_SQL = f"""{KG_SQL}, {_ADJ_SQL}, v0 AS (SELECT node, i - 1 AS component, CASE WHEN substring(md5(node), i, 1) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE AS value
    FROM (SELECT DISTINCT src AS node FROM adj), (SELECT unnest(range(1, 9))::INT AS i)), v1 AS ({_STEP.format(v='v0')}), v2 AS ({_STEP.format(v='v1')}),
  vec AS (SELECT node, list(value ORDER BY component) AS v FROM v2 GROUP BY node)"""
#: Scores are whole numbers of this grid, so that equal ones are equal whatever the order of sums was.
GRID, SHIFT = 1000003, 0.3137

_RANK_SQL = f"""{_VECTORS_SQL}, tri AS (SELECT DISTINCT head, relation, tail FROM kg),
  tes AS (SELECT * FROM tri WHERE substring(md5(head || '|' || relation || '|' || tail), 1, 2) >= 'f3'),
  que AS (SELECT head, relation, tail, 'tail' AS side, head AS fixed, tail AS answer FROM tes UNION ALL SELECT head, relation, tail, 'head', tail, head FROM tes),
  kno AS (SELECT 'tail' AS side, head AS fixed, relation, tail AS other FROM tri UNION ALL SELECT 'head', tail, relation, head FROM tri),
  sco AS (SELECT q.*, c.node AS other, floor(list_inner_product(f.v, c.v) * {GRID} + {SHIFT})::BIGINT AS score, floor(list_inner_product(f.v, a.v) * {GRID} + {SHIFT})::BIGINT AS s
    FROM que q JOIN vec f ON f.node = q.fixed JOIN vec a ON a.node = q.answer, vec c),
  ranks AS (SELECT head, relation, tail, side, 1 + count(*) FILTER (score > s) AS optimistic, 1 + count(*) FILTER (score >= s) AS pessimistic, 1 + count(*) AS candidates
    FROM sco ANTI JOIN kno USING (side, fixed, relation, other) WHERE other <> answer GROUP BY ALL)"""


def entity_vectors(triples: DataFrame) -> DataFrame:
    """(node, v): the vectors of the last round of propagation, a stored table."""
    with scratch(triples.sparkSession) as keep:
        return keep(propagate(stage(adjacency(triples), "adjacency"))[-1])


_UNIT = "list_transform({v}, lambda x: x / CASE WHEN list_inner_product({v}, {v}) = 0 THEN 1 ELSE sqrt(list_inner_product({v}, {v})) END)"


@query(
    "kg_node_vectors",
    f"""WITH {_VECTORS_SQL}, one AS (SELECT node, list(value ORDER BY component) AS a FROM v1 GROUP BY node),
    cat AS (SELECT node, list_concat({_UNIT.format(v="a")}, {_UNIT.format(v="v")}) AS c FROM one JOIN vec USING (node))
    SELECT node, list_transform({_UNIT.format(v="c")}, lambda x: round(x, 6) + 0.0) AS v FROM cat""",
)
def kg_node_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors for retrieval: those of all rounds, each by its length, one after the other, by the length of the whole."""
    with scratch(spark) as keep:
        one, *more = propagate(stage(adjacency(kg(spark, d)), "adjacency"))
        joined = one.select("node", unit(F.col("v")).alias("c"))
        for v in more:
            joined = joined.join(v, "node").select("node", F.concat("c", unit(F.col("v"))).alias("c"))
        return keep(joined.select("node", F.transform(unit(F.col("c")), lambda x: F.round(x, 6) + 0.0).alias("v")))


def score(a: Column, b: Column) -> Column:
    return F.floor(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) * GRID + SHIFT)


#: Answers of one anchor that are looked up in one sorted row of scores.
ANSWERS = 4096


def both_sides(answer: str = "answer") -> Column:
    """For a triple the two questions it answers: which tail follows this head, and which head goes before this tail."""
    side = lambda name, fixed, other: F.struct(F.lit(name).alias("side"), F.col(fixed).alias("fixed"), F.col(other).alias(answer))
    return F.explode(F.array(side("tail", "head", "tail"), side("head", "tail", "head"))).alias("q")


def anchor_counts(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """(fixed, s, higher, least): for each anchor (fixed) and each score s that one of its answers has, how many of all
    entities score higher, and how many at least as much.

    pairs: (fixed, s) distinct; shapes: (shape, v, n), a vector and how many entities have it; fixed is the shape of the
    anchor. An anchor is scored against all shapes once for ANSWERS answers: its scores are sorted, and all its answers are
    found in them.
    """
    pairs = stage(pairs, "anchor-scores")
    many = pairs.groupBy("fixed").agg(F.count("*").alias("n")).filter(F.col("n") > ANSWERS)
    # at most one anchor for each ANSWERS pairs
    pairs = pairs.join(F.broadcast(many), "fixed", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("s"), F.ceil(F.col("n") / ANSWERS)), F.lit(0)))
    anchors = pairs.groupBy("fixed", "piece").agg(F.collect_list("s").alias("s"))
    anchors = stage(lookup(anchors, shapes.select(F.col("shape").alias("fixed"), "v"), ["fixed"]), "anchors")
    blocks, parts = n_blocks(anchors.count(), QUERY_BLOCK), n_blocks(shapes.count(), ROW_BLOCK)

    def run(asked: pa.Array, held: pa.Array, part: int) -> Iterator[pa.RecordBatch]:
        x, y = (z.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(z), -1) for z in (asked, held))
        got, n = np.floor(x @ y.T * GRID + SHIFT), held.field("n").to_numpy()
        s = asked.field("s")
        size, s = np.diff(s.offsets.to_numpy()), s.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        higher, least = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        single = np.flatnonzero(size == 1)
        own = s[ends[single] - 1][:, None]
        higher[ends[single] - 1], least[ends[single] - 1] = (got[single] > own) @ n, (got[single] >= own) @ n
        for i in np.flatnonzero(size > 1):
            order, at = np.argsort(got[i]), slice(ends[i] - size[i], ends[i])
            row, before = got[i][order], np.concatenate([[0], np.cumsum(n[order])])
            higher[at], least[at] = before[-1] - before[np.searchsorted(row, s[at], "right")], before[-1] - before[np.searchsorted(row, s[at], "left")]
        yield pa.RecordBatch.from_arrays([asked.field("fixed").take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(s), pa.array(higher), pa.array(least)], names=["fixed", "s", "higher", "least"])

    left = packed(anchors, ["fixed", "v", "s"], blocks, "block", "left_of")
    right = packed(shapes, ["shape", "v", "n"], parts, "part", "right_of")
    return grid(left, right, blocks, parts, run, "fixed long, s long, higher long, least long").groupBy("fixed", "s").agg(F.sum("higher").alias("higher"), F.sum("least").alias("least"))


def filtered_ranks(triples: DataFrame, test: DataFrame, vectors: DataFrame) -> DataFrame:
    """For both sides of each test triple the rank of the right entity among all entities but other right answers.

    triples and test are stored tables of distinct (head, relation, tail); vectors is a stored table (node, v). Entities
    of one vector are one shape, and scores are those of shapes. Each anchor's shape meets all shapes once, whatever its
    number of questions. The right answers of a question's anchor and relation are counted by shape and by score; their
    running count, from the greatest score down, tells each answer how many of them are before it. The work is that of
    triples plus the shapes of anchors times all shapes.
    """
    n = vectors.count()
    shapes = stage(vectors.groupBy("v").agg(F.count("*").alias("n")).withColumn("shape", F.monotonically_increasing_id()), "shapes")
    of = stage(lookup(vectors, shapes.select("v", "shape"), ["v"]).select("node", "shape"), "shape-of")
    end = lambda key, name: of.select(F.col("node").alias(key), F.col("shape").alias(name))
    vector = lambda key, name: shapes.select(F.col("shape").alias(key), F.col("v").alias(name))
    shaped = lambda df, other: stage(lookup(stage(lookup(df, end("fixed", "f"), ["fixed"]), "half"), end(other, "o"), [other]).drop(other), "shaped")

    def scored(pairs: DataFrame) -> DataFrame:
        """pairs of shapes (f, o) with their score s."""
        pairs = stage(pairs.select("f", "o").distinct(), "pairs")
        pairs = lookup(stage(lookup(pairs, vector("f", "x"), ["f"]), "half"), vector("o", "y"), ["o"])
        return stage(pairs.select("f", "o", score(F.col("x"), F.col("y")).alias("s")), "scores")

    q = shaped(stage(test.select("head", "relation", "tail", both_sides()).select("head", "relation", "tail", "q.*"), "questions"), "answer")
    q = stage(lookup(q, scored(q), ["f", "o"]).drop("o"), "questions")
    counts = stage(anchor_counts(q.select(F.col("f").alias("fixed"), "s").distinct(), shapes), "counts").withColumnRenamed("fixed", "f")
    groups = stage(q.select("relation", "side", "fixed").distinct(), "groups")
    known = triples.select("relation", both_sides("other")).select("relation", "q.*")
    known = shaped(stage(lookup(known, groups, ["relation", "side", "fixed"]), "known"), "other")
    known = stage(known.groupBy("relation", "side", "fixed", "f", "o").agg(F.count("*").alias("n")), "known")
    known = lookup(known, scored(known), ["f", "o"]).groupBy("relation", "side", "fixed", "s").agg(F.sum("n").alias("n"))
    known = stage(running(known, ["relation", "side", "fixed"], [F.col("s").desc()], "n"), "running")
    j = lookup(stage(lookup(q, counts, ["f", "s"]), "counted"), known, ["relation", "side", "fixed", "s"])
    # `before` right answers score higher, n as much, the answer itself among them
    return j.select(
        "head", "relation", "tail", "side", (F.col("higher") - F.col("before") + 1).alias("optimistic"),
        (F.col("least") - F.col("before") - F.col("n") + 1).alias("pessimistic"), (F.lit(n) - F.col("total") + 1).alias("candidates"),
    )


@query(
    "kg_relation_translation",
    f"""WITH {_VECTORS_SQL} SELECT relation, h.component, round(avg(t.value - h.value), 9) + 0.0 AS value, count(*) AS triples
    FROM (SELECT DISTINCT head, relation, tail FROM kg) JOIN v2 h ON h.node = head JOIN v2 t ON t.node = tail AND t.component = h.component GROUP BY relation, h.component""",
)
def kg_relation_translation(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each relation: the mean, over its triples, of the tail's vector less the head's."""
    triples = kg(spark, d)
    triples = stage(triples.select("head", "relation", "tail"), "triples")
    v = entity_vectors(triples)
    end = lambda key, name: v.select(F.col("node").alias(key), F.col("v").alias(name))
    j = lookup(lookup(triples.distinct(), end("head", "h"), ["head"]), end("tail", "t"), ["tail"])
    moved = j.select("relation", F.posexplode(F.zip_with("t", "h", lambda x, y: x - y)).alias("component", "value"))
    return moved.groupBy("relation", "component").agg((F.round(F.avg("value"), 9) + 0.0).alias("value"), F.count("*").alias("triples"))


def factors(adj: DataFrame, ids: DataFrame, rank: int = 8, rounds: int = 5, seed: int = 7) -> DataFrame:
    """(node, v): vectors from a factorisation of the weighted adjacency, by alternating least squares for implicit
    feedback. ids: (label, id) of all nodes; ids must fit 32 bits, as the factorisation asks."""
    key = lambda end: ids.select(F.col("label").alias(end), F.col("id").cast("int").alias(f"{end}_id"))
    edges = adj.join(key("src"), "src").join(key("dst"), "dst").select("src_id", "dst_id", F.col("weight").cast("float").alias("weight"))
    # numbers from zero: the greatest tells whether all of them fit
    if (ids.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more nodes than 32-bit ids")
    als = ALS(rank=rank, maxIter=rounds, implicitPrefs=True, userCol="src_id", itemCol="dst_id", ratingCol="weight", seed=seed, checkpointInterval=-1)
    return als.fit(edges).userFactors.join(ids, "id").select(F.col("label").alias("node"), F.transform("features", lambda x: x.cast("double")).alias("v"))


@query("kg_factors")
def kg_factors(spark: SparkSession, d: str) -> DataFrame:
    """Node vectors by factorisation; its numbers depend on the order of sums, so there is no SQL for them."""
    triples = kg(spark, d)
    return factors(adjacency(triples), entity_ids(triples))


@query("kg_filtered_ranks", f"WITH {_RANK_SQL} SELECT head, relation, tail, side, candidates, optimistic, pessimistic, (optimistic + pessimistic) / 2.0 AS realistic FROM ranks")
def kg_filtered_ranks(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        triples = stage(kg(spark, d).select("head", "relation", "tail"), "triples")
        vectors = entity_vectors(triples)
        triples = stage(triples.distinct().withColumn("part", split_part()), "distinct")
        ranks = filtered_ranks(triples, triples.filter("part = 'test'"), vectors)
        return keep(stage(ranks.withColumn("realistic", (F.col("optimistic") + F.col("pessimistic")) / 2.0), "ranks"))


#: Sums over ranks r among n candidates, m their median. Of a random rank k among n: h and hh are the sums of 1 / k and
#: its square over all k, p and pp those of k to the power 1 / count and 2 / count.
_METRICS = {
    "count": "count(r)", **{f"hits_at_{k}": f"avg(CASE WHEN r <= {k} THEN 1e0 ELSE 0e0 END)" for k in (1, 3, 5, 10)},
    "arithmetic_mean_rank": "avg(r)", "geometric_mean_rank": "exp(avg(ln(r)))", "harmonic_mean_rank": "1 / avg(1 / r)", "median_rank": "max(m)",
    "inverse_arithmetic_mean_rank": "1 / avg(r)", "inverse_geometric_mean_rank": "1 / exp(avg(ln(r)))", "inverse_harmonic_mean_rank": "avg(1 / r)", "inverse_median_rank": "1 / max(m)",
    "variance": "var_pop(r)", "standard_deviation": "stddev_pop(r)", "median_absolute_deviation": "max(mad) / 0.6744897501960817",
    "adjusted_arithmetic_mean_rank": "avg(r) / avg((n + 1) / 2.0)", "adjusted_arithmetic_mean_rank_index": "1 - (avg(r) - 1) / (avg((n + 1) / 2.0) - 1)",
    "z_arithmetic_mean_rank": "(avg((n + 1) / 2.0) - avg(r)) / sqrt(sum((n * n - 1) / 12.0) / (count(r) * count(r)))",
    "adjusted_hits_at_k": "(avg(CASE WHEN r <= 10 THEN 1e0 ELSE 0e0 END) - avg(least(10, n) / n)) / (1 - avg(least(10, n) / n))",
    "adjusted_geometric_mean_rank_index": "1 - (exp(avg(ln(r))) - 1) / (exp(sum(ln(p / n))) - 1)",
    "z_geometric_mean_rank": "(exp(sum(ln(p / n))) - exp(avg(ln(r)))) / sqrt(exp(sum(ln(pp / n))) - exp(2 * sum(ln(p / n))))",
    "adjusted_inverse_harmonic_mean_rank": "(avg(1 / r) - avg(h / n)) / (1 - avg(h / n))",
    "z_inverse_harmonic_mean_rank": "(avg(1 / r) - avg(h / n)) / sqrt(sum(hh / n - h / n * h / n) / (count(r) * count(r)))",
    "z_hits_at_k": "(avg(CASE WHEN r <= 10 THEN 1e0 ELSE 0e0 END) - avg(least(10, n) / n)) / sqrt(sum(least(10, n) / n * (1 - least(10, n) / n)) / (count(r) * count(r)))",
}


@query(
    "rank_metrics",
    f"""WITH {_RANK_SQL}, m AS (SELECT side, candidates::DOUBLE AS n, 'optimistic' AS mode, optimistic::DOUBLE AS r FROM ranks UNION ALL SELECT side, candidates, 'pessimistic', pessimistic FROM ranks UNION ALL SELECT side, candidates, 'realistic', (optimistic + pessimistic) / 2.0 FROM ranks),
    l AS (SELECT * FROM m UNION ALL SELECT 'both', n, mode, r FROM m), c AS (SELECT side, mode, median(r) AS m FROM l GROUP BY ALL),
    z AS (SELECT side, count(*) / 3.0 AS t FROM l GROUP BY side), y AS (SELECT side, x, sum(1e0 / x) OVER o AS h, sum(1e0 / (x * x)) OVER o AS hh, sum(pow(x, 1e0 / t)) OVER o AS p, sum(pow(x, 2e0 / t)) OVER o AS pp
      FROM z, (SELECT unnest(range(1, (SELECT max(candidates) + 1 FROM ranks)))::DOUBLE AS x) WINDOW o AS (PARTITION BY side ORDER BY x)),
    k AS (SELECT l.*, c.m, h, hh, p, pp, median(abs(r - c.m)) OVER (PARTITION BY l.side, l.mode) AS mad FROM l JOIN c USING (side, mode) JOIN y ON y.side = l.side AND y.x = l.n),
    w AS (SELECT side, mode, {", ".join(f"{e} AS {k}" for k, e in _METRICS.items())} FROM k GROUP BY side, mode)
    SELECT side, mode, metric, round(value::DOUBLE, 6) AS value FROM ({" UNION ALL ".join(f"SELECT side, mode, '{k}' AS metric, {k} AS value FROM w" for k in _METRICS)})""",
)
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(stage(metrics_of(kg_filtered_ranks(spark, d)), "metrics"))


def random_sums(r: DataFrame) -> DataFrame:
    """(side, n, h, hh, p, pp) for the numbers of candidates n that r (side, mode, n) has: sums over the ranks 1 to n."""
    count = {x.side: x["count"] for x in r.groupBy("side", "mode").count().collect()}  # three sides at most
    most = int(r.agg(F.max("n")).first()[0] or 0)
    x = F.col("x").cast("double")
    powers = {f"{name}_{side}": F.pow(x, F.lit(e / n)) for side, n in count.items() for name, e in (("p", 1.0), ("pp", 2.0))}
    sums = so_far(r.sparkSession.range(1, most + 2).withColumnRenamed("id", "x"), [F.col("x")], {"h": 1 / x, "hh": 1 / (x * x)} | powers)
    # what is before x = n + 1 is the sum over 1 to n; only the numbers that occur are kept
    sums = sums.withColumn("n", x - 1).join(F.broadcast(r.select("n").distinct()), "n", "left_semi")
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"p_{s}").alias("p"), F.col(f"pp_{s}").alias("pp")) for s in count))).alias("s")
    return sums.select("n", "h", "hh", each).select("s.side", "n", "h", "hh", "s.p", "s.pp")


def metrics_of(ranks: DataFrame) -> DataFrame:
    """By side and both, and by mode. Medians are exact: a histogram of ranks for each side and mode."""
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).cast("double").alias("r")) for m in ("optimistic", "pessimistic", "realistic")))).alias("m")
    r = ranks.select(F.explode(F.array("side", F.lit("both"))).alias("side"), F.col("candidates").cast("double").alias("n"), modes).select("side", "n", "m.*")
    r = r.join(F.broadcast(r.groupBy("side", "mode").agg(F.percentile("r", 0.5).alias("m"))), ["side", "mode"])
    r = r.join(F.broadcast(r.groupBy("side", "mode").agg(F.percentile(F.abs(F.col("r") - F.col("m")), 0.5).alias("mad"))), ["side", "mode"])
    r = lookup(r, stage(random_sums(r), "random-sums"), ["side", "n"])
    wide = r.groupBy("side", "mode").agg(*(F.expr(e).cast("double").alias(k) for k, e in _METRICS.items()))
    return wide.unpivot(["side", "mode"], list(_METRICS), "metric", "value").withColumn("value", F.round("value", 6))


@query(
    "kg_neighborhood_stats",
    f"""WITH RECURSIVE {KG_SQL}, e AS (SELECT head AS a, tail AS b FROM kg UNION SELECT tail, head FROM kg),
    r AS (SELECT 'Supplier#' || s_suppkey AS seed, 'Supplier#' || s_suppkey AS entity, 0 AS hop FROM supplier WHERE s_suppkey % 100 = 0 UNION SELECT seed, b, hop + 1 FROM r JOIN e ON entity = a WHERE hop < 2),
    m AS (SELECT seed, entity, min(hop) AS hop FROM r GROUP BY ALL), n AS (SELECT seed, hop, count(*) AS entities FROM m GROUP BY ALL),
    t AS (SELECT x.seed, greatest(x.hop, y.hop) AS hop, relation FROM kg JOIN m x ON x.entity = head JOIN m y ON y.entity = tail AND y.seed = x.seed)
    SELECT n.seed, n.hop, entities, count(relation) AS relationships, sum(entities) OVER (PARTITION BY n.seed)::BIGINT AS total FROM n LEFT JOIN t ON t.seed = n.seed AND t.hop = n.hop GROUP BY n.seed, n.hop, entities""",
)
def kg_neighborhood_stats(spark: SparkSession, d: str) -> DataFrame:
    """By seed and hop: entities first reached there, triples whose later end is reached there, and entities in all."""
    triples, m = kg(spark, d), kg_neighborhood(spark, d)
    end = lambda key, hop: m.select("seed", F.col("entity").alias(key), F.col("hop").alias(hop))
    t = triples.select("head", "tail").join(end("head", "x"), "head").join(end("tail", "y"), ["tail", "seed"])
    t = t.groupBy("seed", F.greatest("x", "y").alias("hop")).agg(F.count("*").alias("relationships"))
    n = m.groupBy("seed", "hop").agg(F.count("*").alias("entities")).join(t, ["seed", "hop"], "left")
    return n.select("seed", "hop", "entities", F.coalesce("relationships", F.lit(0)).alias("relationships"), F.sum("entities").over(W.partitionBy("seed")).alias("total"))


@query("triples_sink_roundtrip", f"WITH {KG_SQL} SELECT head, relation, tail FROM kg")
def triples_sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The triples as CSV, written and read again."""
    path = f"{workspace(spark)}/triples"
    write_triples(kg(spark, d), path)
    return read_triples(spark, path)


@query("nodes_sink_roundtrip", f"WITH p AS (SELECT {_PAGE} FROM pages) SELECT title, lang AS category, page_id AS revid FROM p")
def nodes_sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The nodes as JSON lines, written and read again."""
    path = f"{workspace(spark)}/nodes"
    write_json_lines(kg_nodes(spark, d).select("title", F.get("categories", F.lit(0)).alias("category"), "revid"), path)
    return read_json_lines(spark, path, "title string, category string, revid long")
