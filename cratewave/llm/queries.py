"""The pN_ queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewave.llm import clusters, confusables, ivfpq, mojibake, names, packing, setjoin, tokens
from cratewave.session import table
from cratewave.storage import materialize, spread


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The cluster of every usable vector that is in one."""
    return clusters.clusters(table(spark, directory, "track_vectors").select("vec_id", "embedding"))


def p1_described(spark: SparkSession, directory: str) -> DataFrame:
    """Size and most typical members of every cluster."""
    vectors = table(spark, directory, "track_vectors").select("vec_id", "embedding")
    told = clusters.describe(materialize(clusters.clusters(vectors), "clusters"), vectors)
    return told.withColumn("typical", F.array_join(F.transform("typical", lambda v: v.cast("string")), ","))


def p2_classes(spark: SparkSession, directory: str) -> DataFrame:
    """The class of every row that names an artist, and the number of other rows that name the same one."""
    return names.with_links(materialize(_artists(spark, directory), "classes")).select("credit_id", "artist_class", "links")


def _artists(spark: SparkSession, directory: str) -> DataFrame:
    return names.resolve(table(spark, directory, "artist_credits").select("credit_id", "artist"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of rows that name the same person, duo or group."""
    classes = materialize(_artists(spark, directory), "classes")
    return names.same_artist(classes).select(F.col("a").alias("credit_a"), F.col("b").alias("credit_b"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of usable vectors of which one is among the five most similar of the other."""
    lists = ivfpq.neighbours(table(spark, directory, "track_vectors").select("vec_id", "embedding"))
    return ivfpq.pairs(lists).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def _fields(spark: SparkSession, directory: str) -> DataFrame:
    columns = ["title", "artist", "genre"]
    tables = [(table(spark, directory, t).select(k, *columns), t, k) for t, k in (("tracks", "ord"), ("shop_rows", "row_id"))]
    return mojibake.fields_of(tables, columns)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """The fields that hold text decoded with a wrong encoding."""
    _, places = mojibake.damaged(_fields(spark, directory))
    return places.select("table_name", "row_id", "field_name").distinct()


def p4_restored(spark: SparkSession, directory: str) -> DataFrame:
    """The damaged fields with their original text."""
    return mojibake.restore(_fields(spark, directory))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of tracks with largely the same set of tags."""
    tracks = table(spark, directory, "tracks").select("ord", "mytags", "tags")
    found = setjoin.similar(tracks, key="ord", values=setjoin.value_set("mytags", "tags"), threshold="0.7", smallest=4)
    return found.select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


def p5_classes(spark: SparkSession, directory: str) -> DataFrame:
    """Tracks with a similar set of tags: the class of equal sets, and the number of similar tracks."""
    tracks = table(spark, directory, "tracks").select("ord", "mytags", "tags")
    return setjoin.classes_of(tracks, key="ord", values=setjoin.value_set("mytags", "tags"), threshold="0.7", smallest=4)


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k; null and empty texts give an empty list."""
    return tokens.encode_corpus(spread(table(spark, directory, "documents").select("doc_id", "text")))


def _packed(spark: SparkSession, directory: str) -> DataFrame:
    docs = spread(table(spark, directory, "documents").select("doc_id", "text"))
    sizes = materialize(tokens.encode_corpus(docs, count_only=True), "sizes")
    usable = table(spark, directory, "pack_limits").where("limit_id is not null and capacity > 0")
    limits = [(r.limit_id, r.capacity) for r in usable.limit(packing.MAX_LIMITS + 1).collect()]
    return packing.pack(sizes, limits)


def p7_packed(spark: SparkSession, directory: str) -> DataFrame:
    """The container and the place in it of every document, for every capacity."""
    return _packed(spark, directory)


def p7_fill(spark: SparkSession, directory: str) -> DataFrame:
    """Containers and the used share of their room, by capacity."""
    return packing.fill(_packed(spark, directory), table(spark, directory, "pack_limits"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of documents that look the same and differ as stored."""
    docs = spread(table(spark, directory, "documents").select("doc_id", "text"))
    keyed = materialize(confusables.keys(docs), "skeletons")
    return confusables.same_looking(keyed).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p8_classes(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that look like another text: the class of what looks the same, and the number of rows of other texts."""
    docs = spread(table(spark, directory, "documents").select("doc_id", "text"))
    return confusables.looks(materialize(confusables.keys(docs), "skeletons"))


def p8_forms(spark: SparkSession, directory: str) -> DataFrame:
    """The consistent form of every text."""
    return confusables.forms(spread(table(spark, directory, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_described": p1_described,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_forms": p8_forms,
}

_USABLE = "len(embedding) = 128 AND len(list_filter(embedding, lambda x: isfinite(x))) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_SETS = """s AS (SELECT ord, list_distinct(list_filter(list_transform(list_concat(coalesce(mytags, []::VARCHAR[]), coalesce(tags, []::VARCHAR[])), lambda t: lower(trim(t))), lambda t: t IS NOT NULL AND t <> '')) AS t FROM tracks),
  f AS (SELECT ord, t, len(t) AS n FROM s WHERE len(t) >= 4), e AS (SELECT ord, n, unnest(t) AS tag FROM f)"""

_CLUSTERS = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM track_vectors WHERE {_USABLE}), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
      p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON list_dot_product(a.e, b.e) >= 0.75), n AS (SELECT a, list(b ORDER BY b) AS l FROM p GROUP BY a),
      found AS (SELECT l[1] AS cluster_id, a AS vec_id FROM (SELECT *, count(*) OVER (PARTITION BY l) AS same FROM n) WHERE same = len(l) AND len(l) >= 6)"""

#: Only what SQL can express over whole tables: exact results, without the methods' means.
ORACLES: dict[str, str] = {
    # a cluster is a set of vectors that all have the same neighbours, namely this set
    "p1_found": f"""WITH {_CLUSTERS} SELECT cluster_id, vec_id FROM found""",
    "p1_described": f"""WITH {_CLUSTERS}, m AS (SELECT cluster_id, vec_id, u.e FROM found JOIN u USING (vec_id)), x AS (SELECT cluster_id, unnest(e) AS y, unnest(range(128)) AS p FROM m),
      c AS (SELECT cluster_id, list(y ORDER BY p) AS s FROM (SELECT cluster_id, p, sum(y) AS y FROM x GROUP BY ALL) GROUP BY cluster_id),
      k AS (SELECT cluster_id, vec_id, round(list_dot_product(e, s) / sqrt(list_dot_product(s, s)), 6) AS cosine FROM m JOIN c USING (cluster_id)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cosine DESC, vec_id) AS r FROM k),
      z AS (SELECT cluster_id, count(*)::HUGEINT AS size, sum(round(cosine * 1000000000)::BIGINT)::HUGEINT AS s FROM k GROUP BY cluster_id)
      SELECT cluster_id, size::BIGINT AS size, ((s + 500 * size) // (1000 * size))::BIGINT / 1000000.0::DOUBLE AS tightness, typical FROM z JOIN (SELECT cluster_id, array_to_string(list(vec_id ORDER BY r), ',') AS typical FROM r WHERE r <= 5 GROUP BY cluster_id) USING (cluster_id)""",
    "p5_found": f"""WITH {_SETS}, o AS (SELECT a.ord AS ord_a, b.ord AS ord_b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.tag = b.tag AND a.ord < b.ord GROUP BY 1, 2)
      SELECT ord_a, ord_b FROM o WHERE k * 10 >= 7 * (n + m - k)""",
    "p5_classes": f"""WITH {_SETS}, o AS (SELECT a.ord AS a, b.ord AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.tag = b.tag AND a.ord <> b.ord GROUP BY 1, 2),
      l AS (SELECT a AS ord, count(*) AS links FROM o WHERE k * 10 >= 7 * (n + m - k) GROUP BY a), c AS (SELECT ord, min(ord) OVER (PARTITION BY list_sort(t)) AS class_id FROM f)
      SELECT ord, class_id, links FROM l JOIN c USING (ord)""",
}
