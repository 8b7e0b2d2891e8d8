"""Registered queries: standardising, density clusters, silhouettes, k-means, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplens.functions import numbers as N
from cliplens.operators import blocks, density, reports, vectors
from cliplens.plans.inputs import table
from cliplens.session import materialize

EPS = 1.15
STANDARD_EPS = 9.2
ROUNDS = 3
MIN_SAMPLES = 5


def points(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("bigint").alias("label"))


def standardize_vectors(spark, sf):
    z = vectors.standardize(points(spark, sf))
    return z.select("id", F.posexplode("embedding").alias("slot", "x")).select(
        "id", F.col("slot").cast("bigint").alias("slot"), N.rounded(F.col("x")).alias("x"))


def eps_neighbors(spark, sf):
    return density.neighbor_counts(points(spark, sf).select("id", "embedding"), EPS)


def dbscan_core_points(spark, sf):
    return eps_neighbors(spark, sf).where(F.col("n_neighbors") >= MIN_SAMPLES).select("id")


def dbscan_labels(spark, sf):
    return density.dbscan(points(spark, sf).select("id", "embedding"), EPS, MIN_SAMPLES)


def silhouette_by_label(spark, sf):
    return vectors.silhouette(points(spark, sf), ["label"]).withColumn(
        "score", N.rounded(F.col("score")))


def silhouette_with_nulls(spark, sf):
    """Every third point has no cluster; it belongs to none and is scored in none."""
    some = points(spark, sf).withColumn("label", F.when(F.col("id") % 3 != 0, F.col("label")))
    return vectors.silhouette(some, ["label"]).withColumn("score", N.rounded(F.col("score")))


def silhouette_squared_by_label(spark, sf):
    """The linear measure on squared distances."""
    score = vectors.silhouette_squared(points(spark, sf), "label")
    return points(spark, sf).agg(F.lit("label").alias("labeling"),
                                 N.rounded(F.lit(score)).alias("score"))


def dbscan_standardized(spark, sf):
    """Density clusters of the standardised vectors, summed up."""
    z = vectors.standardize(points(spark, sf))
    found = density.dbscan(materialize(z, "standardized"), STANDARD_EPS, MIN_SAMPLES)
    s = reports.cluster_summary(found, "cluster")
    return s.withColumn("noise_ratio", N.rounded(F.col("noise_ratio")))


def kmeans_lloyd(spark, sf):
    """Three passes of k-means from the ten smallest ids."""
    vecs = materialize(points(spark, sf).select("id", "embedding"), "points")
    starts = blocks.matrix(r["embedding"] for r in vecs.orderBy("id").limit(10).collect())
    centers = vectors.lloyd(vecs, starts, ROUNDS)
    return vectors.assign_centers(vecs, {"center": centers}).groupBy("center").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("id").alias("id_sum"))


def choose_k(spark, sf):
    return vectors.choose_k(points(spark, sf))


def kmeans_sizes(spark, sf):
    vecs = points(spark, sf).select("id", "embedding")
    centers = vectors.kmeans_sweep(vecs, [10])
    return vectors.assign_centers(vecs, {"cluster_id": centers[10]}).groupBy("cluster_id").agg(
        F.count("*").alias("n"))


def pca_2d(spark, sf):
    return vectors.pca_2d(points(spark, sf))


QUERIES = {f.__name__: f for f in [
    standardize_vectors, eps_neighbors, dbscan_core_points, dbscan_labels, dbscan_standardized,
    silhouette_by_label, silhouette_with_nulls, silhouette_squared_by_label, choose_k, kmeans_sizes,
    kmeans_lloyd, pca_2d,
]}

E_SQL = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
DIST = """sqrt(list_sum(list_transform(list_zip(a.v, b.v),
                lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"""


def near_sql(eps: float) -> str:
    return f"""
    near AS (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE {DIST} <= {eps}),
    degree AS (SELECT a AS id, count(*) AS n_neighbors FROM near GROUP BY 1),
    core AS (SELECT id FROM degree WHERE n_neighbors >= {MIN_SAMPLES})"""


NEAR_SQL = near_sql(EPS)
CLUSTER_SQL = """
      links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
      reach AS (
        SELECT id, id AS root FROM core
        UNION
        SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
      roots AS (SELECT id, min(root) AS root FROM reach GROUP BY 1),
      border AS (
        SELECT n.a AS id, min(r.root) AS root FROM near n JOIN roots r ON r.id = n.b
        WHERE n.a NOT IN (SELECT id FROM core) GROUP BY 1),
      numbers AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster
                  FROM (SELECT DISTINCT root FROM roots)),
      clusters AS (
        SELECT e.id, e.id IN (SELECT id FROM core) AS is_core, coalesce(n.cluster, -1) AS cluster
        FROM e LEFT JOIN (SELECT * FROM roots UNION ALL SELECT * FROM border) m ON m.id = e.id
        LEFT JOIN numbers n ON n.root = m.root)"""
Z_SQL = """x AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS x,
                 unnest(range(len(embedding))) AS slot FROM embeddings),
      e AS (SELECT id, list(z ORDER BY slot) AS v FROM (
              SELECT id, slot, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z
              FROM x WINDOW w AS (PARTITION BY slot)) GROUP BY id)"""
SCORE_SQL = """
      ab AS (SELECT id, max(CASE WHEN own = label THEN s / (n - 1) END) AS a,
                    max(CASE WHEN own = label THEN n END) AS own_n,
                    min(CASE WHEN own <> label THEN s / n END) AS b FROM sums GROUP BY 1)
      SELECT 'label' AS labeling,
             round(avg(CASE WHEN own_n = 1 THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END), 6)
               AS score FROM ab"""


def silhouette_sql(distance: str, label: str = "label") -> str:
    return f"WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, {label} AS label FROM embeddings)," + f"""
      sums AS (SELECT a.id, a.label AS own, b.label, sum({distance}) AS s, count(*) AS n
               FROM e a, e b WHERE a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY 1, 2, 3),
      """ + SCORE_SQL


def lloyd_sql() -> str:
    """Passes as chained views: the nearest center, then the means."""
    parts = [f"WITH {E_SQL}, c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS center, v FROM e ORDER BY id LIMIT 10)"]
    for i in range(ROUNDS + 1):
        parts.append(f"""n{i} AS (SELECT id, v, arg_min(center, (d, center)) AS center FROM (
            SELECT a.id, a.v, b.center, {DIST} AS d FROM e a, c{i} b) GROUP BY id, v)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS (SELECT center, list(m ORDER BY slot) AS v FROM (
                SELECT center, slot, avg(x) AS m FROM (
                  SELECT center, unnest(v) AS x, unnest(range(len(v))) AS slot FROM n{i})
                GROUP BY 1, 2) GROUP BY 1)""")
    return ", ".join(parts) + f"""
      SELECT center, count(*) AS n, min(id) AS first_id, CAST(sum(id) AS BIGINT) AS id_sum
      FROM n{ROUNDS} GROUP BY 1"""


ORACLES = {
    "standardize_vectors": f"WITH {E_SQL}," + """
      x AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS slot FROM e)
      SELECT id, slot, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) + 0.0 AS x
      FROM x WINDOW w AS (PARTITION BY slot)""",
    "eps_neighbors": f"WITH {E_SQL},{NEAR_SQL} SELECT * FROM degree",
    "dbscan_core_points": f"WITH {E_SQL},{NEAR_SQL} SELECT * FROM core",
    "dbscan_labels": f"WITH RECURSIVE {E_SQL},{NEAR_SQL},{CLUSTER_SQL} SELECT * FROM clusters",
    "dbscan_standardized": f"WITH RECURSIVE {Z_SQL},{near_sql(STANDARD_EPS)},{CLUSTER_SQL}" + """
      SELECT count(*) AS total_videos, count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters,
             count(*) FILTER (cluster = -1) AS n_noise,
             round(count(*) FILTER (cluster = -1) / count(*), 6) AS noise_ratio FROM clusters""",
    "silhouette_by_label": silhouette_sql(DIST),
    "silhouette_with_nulls": silhouette_sql(DIST, "CASE WHEN vec_id % 3 <> 0 THEN label END"),
    "silhouette_squared_by_label": silhouette_sql(DIST.replace("sqrt(", "(", 1)),
    "kmeans_lloyd": lloyd_sql(),
}
