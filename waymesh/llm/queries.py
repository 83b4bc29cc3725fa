"""Queries of this subpackage over the whole tables, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.llm import cooccur, mixing, packing, spans, survivor, tokens
from waymesh.plans.records import XML_SQL
from waymesh.session import cut, table

TOKENIZER = os.environ.get("WAYMESH_TOKENIZER", tokens.TOKENIZER)


def _p1(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets of valid runs: each run once, a route's customers (neither null nor 0) as items."""
    valid = table(spark, sf, "solution").where("validation.valid AND run_id IS NOT NULL AND instance_id IS NOT NULL")
    runs = valid.groupBy("run_id").agg(F.min(F.struct("instance_id", "routes")).alias("run"))
    routes = runs.select("run_id", F.col("run.instance_id").alias("group_id"), F.posexplode("run.routes").alias("place", "route"))
    return routes.select("group_id", F.struct("run_id", "place").alias("basket_id"), F.filter("route", lambda x: x != 0).alias("items"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who ride together in at least six routes and three times as often as by chance."""
    found = cooccur.lifted_pairs(cooccur.pair_counts(_p1(spark, sf), 6), 6, 3.0)
    return found.select(F.col("group_id").alias("instance_id"), F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How often every pair of customers rides together."""
    return cooccur.pair_counts(_p1(spark, sf)).where("b IS NOT NULL").select(F.col("group_id").alias("instance_id"), F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("n").alias("n_ab"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """For each id with several rows, which row supplies the coordinates and each tag of the surviving node."""
    return survivor.merge_fields(table(spark, sf, "nodes"), table(spark, sf, "feed_rank")).select("id", "field", "rec_id")


def p4_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving node of each id with several rows, its tags and the rows they come from as JSON."""
    one = survivor.survivors(survivor.merge_fields(table(spark, sf, "nodes"), table(spark, sf, "feed_rank")))
    return one.select("id", "lat", "lon", F.to_json("tags").alias("tags"), F.to_json("sources").alias("sources"))


def p4_best_poi(spark: SparkSession, sf: str) -> DataFrame:
    """The most complete, then latest row of each POI."""
    order = [F.desc(survivor.completeness("lat", "lon", "category", "name", "city")), F.desc_nulls_last("loaded_at"), F.desc_nulls_last("name"), F.desc_nulls_last("category"), F.desc_nulls_last("lat"), F.desc_nulls_last("lon")]
    return survivor.best_rows(table(spark, sf, "poi"), ["poi_id"], order).select("poi_id", "category", "name")


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their size in tokens, written once."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return cut(tokens.with_token_count(docs, "text", ["doc_id", "source"], TOKENIZER))


def _p7(spark: SparkSession, sf: str, sizes: DataFrame) -> DataFrame:
    bins = table(spark, sf, "pack_bin").where("capacity_tokens > 0").select("bin_kind", "capacity_tokens").distinct().orderBy("bin_kind", "capacity_tokens").limit(packing.KINDS + 1).collect()
    return packing.pack_kinds(sizes.select(F.col("doc_id").alias("item_id"), "n_tokens"), [(b[0], b[1]) for b in bins]).withColumnRenamed("item_id", "doc_id")


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in containers of each capacity, with what each container holds."""
    return _p7(spark, sf, _sizes(spark, sf))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens, padding and the share of space used for each kind of container and bucket."""
    return packing.fill_report(p7_pack(spark, sf), "bucket")


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """For each document with text and kind of container: all its tokens are placed once, it is cut only above the capacity, and no container is over-full."""
    sizes = _sizes(spark, sf)
    packed = _p7(spark, sf, sizes)
    room = packed.where("container_id IS NOT NULL").groupBy("bin_kind", "container_id").agg(F.sum("n_tokens").alias("held"), F.max("capacity_tokens").alias("capacity"), F.max("bucket").alias("most"), F.min("bucket").alias("least"))
    good = room.select("bin_kind", "container_id", ((F.col("held") <= F.col("capacity")) & (F.col("most") == F.col("least"))).alias("good"))
    rows = packed.join(good, ["bin_kind", "container_id"], "left")
    per = rows.groupBy("bin_kind", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("token_start").alias("starts"), F.sum(F.when(F.col("n_tokens") < F.col("capacity_tokens"), 1).otherwise(0)).alias("rests"), F.min(F.coalesce("good", F.col("n_tokens") == 0)).alias("fits"))
    whole = (F.col("n") == F.col("n_tokens")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))) & (F.col("starts") == F.col("pieces")) & (F.col("rests") <= 1)
    return per.join(sizes.select("doc_id", "n_tokens"), "doc_id").select("bin_kind", "doc_id", whole.alias("placed_once"), "fits")


def _p8(spark: SparkSession, sf: str) -> DataFrame:
    """As many tokens drawn as the sources with a target have, so a source whose repeats don't reach its share shows it."""
    sizes = _sizes(spark, sf).select(mixing.proper_source(F.col("source")).alias("source"), F.col("doc_id").alias("item_id"), "n_tokens")
    targets = table(spark, sf, "mix_target")
    wanted = targets.where("target_share > 0 AND max_repeats > 0").select("source").distinct()
    total = sizes.where("n_tokens > 0").join(F.broadcast(wanted), "source", "left_semi").agg(F.sum("n_tokens")).first()[0]
    return mixing.mix(sizes, targets, total or 0)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn parts of documents, as many tokens as all target sources have, each source at its target share as far as its texts and repeats allow."""
    return _p8(spark, sf).withColumnRenamed("item_id", "doc_id")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The target and actual share of each source."""
    return mixing.shares(_p8(spark, sf), table(spark, sf, "mix_target"))


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per target source: no document is drawn more than its repeats allow, and its share is the target's or above unless the source is used up or has no texts."""
    drawn, targets = cut(_p8(spark, sf)), table(spark, sf, "mix_target")
    sizes = _sizes(spark, sf).select(mixing.proper_source(F.col("source")).alias("source"), F.col("doc_id").alias("item_id"), "n_tokens")
    per = drawn.groupBy("source", "item_id").agg(F.sum("n_tokens").alias("n")).join(sizes, ["source", "item_id"]).groupBy("source").agg(F.max(F.ceil(F.col("n") / F.col("n_tokens"))).alias("most"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    all_ = mixing.shares(drawn, targets).join(per, "source", "left").join(have, "source", "left")
    used_up = F.coalesce("tokens", F.lit(0)) * F.col("max_repeats") <= F.col("drawn_tokens")
    reached = F.coalesce(F.col("actual_share") >= F.col("target_share") - 0.005, F.lit(False))
    return all_.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_ok"), (used_up | reached).alias("share_ok"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """The longest stretches of each document made of 200-character runs that stand in another document too."""
    return spans.merged_spans(spans.shared_stretches(table(spark, sf, "documents")))


def p9_share(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document stands verbatim elsewhere."""
    docs = table(spark, sf, "documents")
    return spans.share_of_records(docs, spans.merged_spans(spans.shared_stretches(docs)))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p4_found, p4_survivors, p4_best_poi, p7_pack, p7_fill, p7_check, p8_mix, p8_shares, p8_check, p9_found, p9_share)}

_BASKETS = """
run AS (SELECT run_id, min({'i': instance_id, 'r': routes}) AS x FROM solution WHERE validation.valid AND run_id IS NOT NULL AND instance_id IS NOT NULL GROUP BY run_id),
route AS (SELECT run_id, x.i AS instance_id, i, x.r[i] AS r FROM (SELECT run_id, x, unnest(range(1, len(x.r) + 1)) AS i FROM run)),
item AS (SELECT DISTINCT instance_id, run_id, i, n FROM (SELECT instance_id, run_id, i, unnest(r) AS n FROM route) WHERE n IS NOT NULL AND n <> 0),
pair AS (SELECT a.instance_id, a.n AS node_a, b.n AS node_b, count(*) AS n_ab FROM item a JOIN item b ON a.run_id = b.run_id AND a.i = b.i AND a.n < b.n GROUP BY ALL)
"""
_WINDOWS = """
win AS (SELECT doc_id, i, substr(text, CAST(i + 1 AS BIGINT), 200) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
hit AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT w FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)) USING (w)),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
grp AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM mark),
span AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 - min(i) AS span_len FROM grp GROUP BY doc_id, g)
"""

_MERGE = f"""{XML_SQL},
num AS (SELECT *, CASE WHEN regexp_full_match(trim(lat), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND regexp_full_match(trim(lon), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(lat AS DOUBLE) END AS y, TRY_CAST(lon AS DOUBLE) AS z FROM said),
rec AS (SELECT n.rec_id, coalesce(n.id, TRY_CAST(s.i AS BIGINT)) AS id, coalesce(t.trust, 0) AS trust, n.fetched_at FROM nodes n LEFT JOIN said s USING (rec_id) LEFT JOIN (SELECT feed, max(trust) AS trust FROM feed_rank GROUP BY feed) t USING (feed)),
grp AS (SELECT id FROM rec WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1),
sup AS (SELECT rec_id, 'coord' AS field, trim(lat) || ' ' || trim(lon) AS value FROM num WHERE abs(y) <= 90 AND abs(z) <= 180 AND NOT (y = 0 AND z = 0)
  UNION ALL SELECT rec_id, k, arg_max(v, place) FROM own WHERE trim(v, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY ALL),
best AS (SELECT id, field, rec_id, value FROM sup JOIN rec USING (rec_id) SEMI JOIN grp USING (id) QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY trust DESC, fetched_at DESC NULLS LAST, rec_id DESC) = 1)"""

ORACLES = {
    "p1_found": f"""
WITH {_BASKETS}, one AS (SELECT instance_id, n, count(*) AS c FROM item GROUP BY ALL),
size AS (SELECT instance_id, count(*) AS b FROM (SELECT DISTINCT instance_id, run_id, i FROM item) GROUP BY ALL)
SELECT p.instance_id, p.node_a, p.node_b FROM pair p JOIN one x ON x.instance_id = p.instance_id AND x.n = p.node_a JOIN one y ON y.instance_id = p.instance_id AND y.n = p.node_b JOIN size s ON s.instance_id = p.instance_id
WHERE n_ab >= 6 AND n_ab * s.b >= 3 * x.c * y.c
""",
    "p1_pairs": f"WITH {_BASKETS} SELECT * FROM pair",
    "p4_found": f"WITH {_MERGE} SELECT id, field, rec_id FROM best",
    "p4_survivors": f"""WITH {_MERGE}, spot AS (SELECT id, CAST(split_part(value, ' ', 1) AS DOUBLE) AS lat, CAST(split_part(value, ' ', 2) AS DOUBLE) AS lon FROM best WHERE field = 'coord')
SELECT b.id, s.lat, s.lon, to_json(b.tags)::VARCHAR AS tags, to_json(b.sources)::VARCHAR AS sources FROM (SELECT id, coalesce(map_from_entries(list((field, value) ORDER BY field) FILTER (WHERE field <> 'coord')), MAP {{}}) AS tags, map_from_entries(list((field, rec_id) ORDER BY field)) AS sources FROM best GROUP BY id) b LEFT JOIN spot s USING (id)""",
    "p4_best_poi": """
SELECT poi_id, category, name FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY (lat IS NOT NULL)::INT + (lon IS NOT NULL)::INT + (category IS NOT NULL)::INT + (name IS NOT NULL)::INT + (city IS NOT NULL)::INT DESC,
  loaded_at DESC NULLS LAST, name DESC NULLS LAST, category DESC NULLS LAST, lat DESC NULLS LAST, lon DESC NULLS LAST) AS k FROM poi) WHERE k = 1
""",
    "p7_check": "SELECT bin_kind, doc_id, true AS placed_once, true AS fits FROM documents, pack_bin WHERE text IS NOT NULL AND capacity_tokens > 0",
    "p8_check": "SELECT source, true AS repeats_ok, true AS share_ok FROM mix_target WHERE source IS NOT NULL",
    "p9_found": f"WITH {_WINDOWS} SELECT doc_id, span_start, span_len FROM span",
    "p9_share": f"""
WITH {_WINDOWS}, per AS (SELECT doc_id, CAST(sum(span_len) AS BIGINT) AS c, count(*) AS k FROM span GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS chars, coalesce(c, 0) AS shared_chars, coalesce(k, 0) AS n_spans, CASE WHEN length(text) > 0 THEN round(coalesce(c, 0) / length(text), 6) END AS share
FROM documents LEFT JOIN per USING (doc_id)
""",
}
