"""Operator 13: centroid clustering, by plain Lloyd rounds in whole numbers.

Components become integers, so distances, sums and centroids are exact, and results don't depend on how rows are dealt. The
centroids are broadcast (k times the number of components, whatever the table's size). In each round ``mapInPandas`` computes
the squared differences of a batch to each centroid and takes the least; a task gives one row of sums for each centroid it
has met, and these merge in a ``groupBy``. Only sums and counts of k clusters reach the driver. However many vectors a
cluster holds, equal ones included, no task ever holds the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import space
from .words import only

#: What the query ``op13_centroids`` takes: components, centroids, rounds, scale of the components, salt of the first centroids.
SIZE, CLUSTERS, ROUNDS, SCALE, SALT = 64, 16, 3, 64, "1"
#: Integers below this in absolute value have squared distances of up to 64 components, and sums of 2**35 rows, in 64 bits.
MOST = 1 << 27
#: Vectors that are compared at a time.
BLOCK = 4096


def usable(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding of the rows whose vector has ``size`` components, all of them finite and small enough to be exact.

    Small enough: ``scale`` times a component is below MOST. Beyond it a squared distance wouldn't fit the result's long
    column; such vectors take no part, like those with other sizes or with null or non-finite components.
    """
    space.small_batches(vectors.sparkSession)
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < MOST))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == size) & fits)


def integers(values: pd.Series, size: int, scale: int) -> np.ndarray:
    """The vectors as rows of integers."""
    return np.floor(scale * np.concatenate([*values, np.zeros(0)]).astype(np.float64).reshape(-1, size)).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the lowest number of the nearest centroids, and the squared distance."""
    best, least = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), BLOCK):
        own = x[at : at + BLOCK]
        distance = np.stack([np.square(own - c).sum(axis=1) for c in centroids], axis=1)
        best[at : at + BLOCK] = distance.argmin(axis=1)
        least[at : at + BLOCK] = distance.min(axis=1)
    return best, least


def first_centroids(vectors: DataFrame, clusters: int, size: int, scale: int, salt: str) -> np.ndarray:
    """The vectors with the least sha256 of ``salt:vec_id``, one row a centroid. Rows that share a vec_id follow by their components.

    A row without a vec_id has no hash: it can't be a first centroid.
    """
    order = F.sha2(F.concat(F.lit(salt + ":"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(order, "embedding").limit(clusters).select("embedding").collect()
    return integers(pd.Series([r["embedding"] for r in rows], dtype=object), size, scale) if rows else np.zeros((0, size), dtype=np.int64)


def _round(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: floors of the exact means; a centroid that no vector is nearest to stays."""
    size = centroids.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only()
        own, count = np.zeros_like(sent.value), np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            x = integers(batch["embedding"], size, scale)
            cluster, _ = nearest(x, sent.value)
            count += np.bincount(cluster, minlength=len(count))
            for k in np.unique(cluster).tolist():
                own[k] += x[cluster == k].sum(axis=0)
        met = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": met, "n": count[met]} | {f"s{i}": own[met, i] for i in range(size)})

    schema = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(size))
    merged = vectors.select("embedding").mapInPandas(sums, schema).groupBy("cluster").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(size)]).collect()
    sent.destroy()
    out = centroids.copy()
    for cluster, n, *total in merged:
        out[cluster] = [s // n for s in total]
    return out


def lloyd(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = SALT, watch: Callable[[np.ndarray], None] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each vector after ``rounds`` rounds; the final centroids), for ``vectors`` (vec_id, embedding).

    See ``usable`` for the vectors that take part; each of their rows gives one row, also rows that share a vec_id or have
    none. Fewer vectors than ``clusters`` give as many centroids as there are; an empty table gives none and no rows. Other
    columns are ignored. ``watch`` is called with the centroids of each round. The result is written to the shared folder.
    """
    own = usable(vectors, size, scale)
    centroids = first_centroids(own, clusters, size, scale, salt)
    if not len(centroids):
        return own.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    for _ in range(rounds):
        centroids = _round(own, centroids, scale)
        if watch:
            watch(centroids)
    final = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only()
        for batch in batches:
            cluster, distance = nearest(integers(batch["embedding"], size, scale), final.value)
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})

    return space.cut(own.mapInPandas(assign, "vec_id long, cluster int, distance long"), "assigned"), centroids


def clustered(vectors: DataFrame, **options: object) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector; ``options`` as in ``lloyd``.

    The sums of distances are taken from the written assignment; the table of clusters that is joined to it has a row a
    centroid.
    """
    assigned, centroids = lloyd(vectors, **options)
    spark = vectors.sparkSession
    sums = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    whole = sum(sums.values())
    rows = [(k, int(s), int(whole), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sums.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(space.table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """The rounds one after another: a row for each vector and component, as lists of squared differences would be slow."""
    parts = [
        "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS (SELECT row_number() OVER () AS r, vec_id, x FROM e)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    for i in range(4):
        parts.append(f"d{i} AS (SELECT r, k, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM v, c{i})")
        parts.append(f"a{i} AS (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{i} GROUP BY r)")
        if i < 3:
            parts.append(f"s{i} AS (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) AS t(i) GROUP BY k, i)")
            parts.append(f"m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (k))")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, "
        "CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN v USING (r) JOIN c3 USING (k)"
    )


OP13_SQL = _op13_sql()
