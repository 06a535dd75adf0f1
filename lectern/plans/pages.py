"""Queries on tagged pages: words of test items set as fragments under marks, with a structure tree for each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.plans.catalog import query, table

# Words of a marked group, groups of a section.
_WORDS, _GROUPS = 9, 3
# The role of a group, alike in both languages: the first is a title, then text, list items and lower titles in turn; the
# last is an artifact or a table's cell on some pages.
_ROLE = "CASE WHEN k = last AND page % 3 = 1 THEN 'Artifact' WHEN k = last AND page % 5 = 4 THEN 'TD' WHEN k = 0 THEN 'H1' WHEN k % 4 = 2 THEN 'LI' WHEN k % 4 = 3 THEN 'H2' ELSE 'P' END"


@query(rf"""
    WITH RECURSIVE w AS (
      SELECT page, row_number() OVER (PARTITION BY page ORDER BY i) - 1 AS j, str FROM (
        SELECT item_id AS page, unnest(range(len(ws))) AS i, unnest(ws) AS str FROM (SELECT item_id, regexp_split_to_array(text, '\s+') AS ws FROM benchmark)) WHERE str <> ''
    ), g AS (
      SELECT page, j // {_WORDS} AS k, string_agg(str, ' ' ORDER BY j) AS t, max(max(j // {_WORDS})) OVER (PARTITION BY page) AS last FROM w GROUP BY page, j // {_WORDS}
    ), r AS (
      SELECT *, {_ROLE} AS role FROM g
    ), node AS (
      SELECT DISTINCT page, 's' || k // {_GROUPS} AS id, 'root' AS parent, CASE WHEN page % 2 = 1 THEN -(k // {_GROUPS}) ELSE k // {_GROUPS} END AS place, NULL::VARCHAR AS role, NULL::VARCHAR AS t FROM r
      UNION ALL SELECT page, 'e' || k, 's' || k // {_GROUPS}, k, role, CASE WHEN role <> 'LI' THEN t END FROM r
      UNION ALL SELECT page, 'b' || k, 'e' || k, 0, NULL, t FROM r WHERE role = 'LI'
    ), walk AS (
      SELECT DISTINCT page, 'root' AS id, []::BIGINT[] AS path, NULL::VARCHAR AS role, NULL::VARCHAR AS t FROM r
      UNION ALL
      SELECT n.page, n.id, list_append(walk.path, n.place), coalesce(n.role, walk.role), n.t FROM walk JOIN node AS n ON n.page = walk.page AND n.parent = walk.id
    ), b AS (
      SELECT page, path, role, CASE role WHEN 'H1' THEN '# ' WHEN 'H2' THEN '### ' WHEN 'LI' THEN CASE WHEN regexp_matches(t, '^([-*]|([0-9]+(\.[0-9]+)*|[a-zA-Z])[.)])\s') THEN '' ELSE '- ' END ELSE '' END || t AS t
      FROM walk WHERE t IS NOT NULL AND role <> 'Artifact'
    ), p AS (
      SELECT page, count(*)::INT AS n, string_agg(t, chr(10) || chr(10) ORDER BY path) AS text, bool_or(role = 'TD') AS cells FROM b GROUP BY page
    )
    SELECT page::VARCHAR AS page_id, CASE WHEN cells THEN '' ELSE text END AS text, CASE WHEN cells THEN 0 ELSE n END AS blocks, NOT cells AS used_tags, CASE WHEN cells THEN 'ambiguous: table' END AS error FROM p""")
def tagged_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose reading order and kinds a structure tree gives; odd pages tell their sections from the last."""
    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("j", "str"))
    k = F.floor(F.col("j") / _WORDS)
    none = lambda t: F.lit(None).cast(t)
    event = lambda name, shift: (k * (_WORDS + 2) + shift, name)

    def rows(frame: DataFrame, idx, text, place, name) -> DataFrame:
        twelve = F.lit(12.0)
        at = F.array(twelve, F.lit(0.0), F.lit(0.0), twelve, (F.col("j") % _WORDS * 60 + 50).cast("double"), (700 - k * 14).cast("double"))
        return frame.select(
            F.col("page").cast("string").alias("page_id"), idx.cast("long").alias("idx"), text.alias("str"), F.when(place, at).alias("transform"), F.when(place, 55.0).alias("width"), F.when(place, 12.0).alias("height"),
            F.lit(False).alias("has_eol"), F.lit("f1").alias("font_name"), none("int").alias("paragraph_id"), F.lit(name).cast("string").alias("event"), F.when(F.lit(name == "begin"), F.concat(F.lit("m"), k.cast("string"))).alias("marked_id"), F.when(F.lit(name == "begin"), "P").alias("tag"),
        )

    first = words.where(F.col("j") % _WORDS == 0)
    begin, end = event("begin", 0), event("end", _WORDS + 1)
    items = rows(words, k * (_WORDS + 2) + 1 + F.col("j") % _WORDS, F.col("str"), F.lit(True), None)
    for idx, name in (begin, end):
        items = items.union(rows(first, idx, none("string"), F.lit(False), name))

    groups = first.select("page", k.cast("long").alias("k")).join(words.groupBy("page").agg(F.max(k).cast("long").alias("last")), "page").withColumn("role", F.expr(_ROLE))
    content = F.concat(F.lit('{"type":"content","id":"m'), "k", F.lit('"}'))
    within = lambda role, inner: F.concat(F.lit('{"role":"'), role, F.lit('","children":['), inner, F.lit("]}"))
    element = (
        F.when(F.col("role") == "LI", within(F.lit("L"), within(F.lit("LI"), within(F.lit("LBody"), content))))
        .when(F.col("role") == "TD", within(F.lit("Table"), within(F.lit("TR"), within(F.lit("TD"), content))))
        .otherwise(within(F.col("role"), content))
    )
    joined = lambda by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, "json"))), lambda x: x["json"]), ",")
    section = F.floor(F.col("k") / _GROUPS)
    sections = groups.select("page", "k", F.when(F.col("page") % 2 == 1, -section).otherwise(section).alias("place"), element.alias("json")).groupBy("page", "place").agg(joined("k").alias("json"))
    trees = sections.withColumn("json", within(F.lit("Sect"), F.col("json"))).groupBy("page").agg(joined("place").alias("json"))
    trees = trees.select(F.col("page").cast("string").alias("page_id"), within(F.lit("Document"), F.col("json")).alias("tree"))
    return layout.reconstruct_pages(items, trees).select("page_id", "text", F.size("blocks").alias("blocks"), "used_tags", "error")
