"""Operator 12: MinHash near-dedup by HyperMinHash registers.

A set's shingle hashes are dealt over REGISTERS buckets, and each bucket keeps its least hash, compressed: the number of its
leading zeros in LEAD bits and the MANTISSA bits after them, 16 bits in all. Four registers side by side are one 64-bit
word, which is a band.

1. Banding. Sets that have a band in common are candidates; an empty band says nothing and isn't compared. A set that lacks
   d of the u shingles of a union spoils d bands at most, and at a similarity of 0.85 or more the chance that all BANDS bands
   differ is below (1 - 0.85**4)**BANDS = 2e-13 for large sets, and about BANDS**-5 for those of six or seven shingles.
2. Estimate. Of the registers that either set fills, the share that agrees, less the agreement that compression makes of
   different minima (expected from both sizes), estimates the similarity. Pairs that lie SPREAD standard deviations below the
   threshold go; the others of a band that few sets have form families, and all sets of a band that many have are one family.
3. Verification. Families are cut into blocks by size, and pairs of blocks are tasks of their own, as in ``jaccard``; there the
   estimate passes over pairs once more, and full sets decide the rest. A pair that links already join isn't looked at.

Bands that one set alone has are dropped before anything is joined. Candidate pairs are formed only in bands of up to
SHORT_LIST sets; the sets of longer ones meet their band's first set, so a group of n copies costs n rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import space
from .graph import components
from .jaccard import SHORT_LIST, Method, jaccard_classes
from .words import mixed, only

#: Bands, registers of a band, and bits of a register: leading zeros, and those that follow them.
BANDS, ROWS, LEAD, MANTISSA = 40, 4, 6, 10
REGISTERS = BANDS * ROWS
#: The query's rule: words of a shingle, percent of the union.
SHINGLE, PERCENT = 3, 85
#: Standard deviations of the estimate by which a pair may lie below the threshold.
SPREAD = 6.0
_EMPTY = np.uint16(0)


def registers(own: np.ndarray) -> np.ndarray:
    """REGISTERS compressed minima of a set of 64-bit hashes; 0 where the bucket is empty."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if not len(own):
        return out
    h = mixed(own ^ np.uint64(0xA24BAED4963EE407))
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    # The other 32 bits, and as many fresh ones, are the value whose minimum counts.
    value = mixed(h + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
    least = np.minimum.reduceat(value[order], first)
    out[bucket[order][first]] = compressed(least)
    return out


def compressed(value: np.ndarray) -> np.ndarray:
    """Leading zeros plus one, up to 2**LEAD - 1, and the MANTISSA bits after the first one: never 0."""
    lead = np.zeros(len(value), dtype=np.uint64)
    rest = value.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < np.uint64(1) << np.uint64(64 - step)
        lead[low] += np.uint64(step)
        rest[low] <<= np.uint64(step)
    lead = np.minimum(lead, np.uint64((1 << LEAD) - 2))
    after = (value << lead) << np.uint64(1)
    return ((lead + np.uint64(1)) << np.uint64(MANTISSA) | after >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def bands(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The BANDS words of a set, four registers each."""
    return registers(own).view(np.uint64)


def _met(n: np.ndarray) -> np.ndarray:
    """For sets of n hashes, the chance of each number of leading zeros of a bucket's minimum: (len(n), 2**LEAD - 1)."""
    edge = 2.0 ** -np.arange(1 << LEAD)
    edge[-1] = 0.0
    stay = np.exp(n[:, None] * np.log1p(-edge / REGISTERS))  # no hash of the bucket is below the edge
    return stay[:, 1:] - stay[:, :-1]


def chance(met_a: np.ndarray, met_b: np.ndarray) -> np.ndarray:
    """Registers that agree though the minima differ, to be expected: the leading zeros meet, and once in 2**MANTISSA the rest."""
    return REGISTERS * (met_a * met_b).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, by_chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of sets with registers ``a`` and ``b`` (a row a pair), and how many registers count: those that either fills.

    Of the registers that differ in truth, ``by_chance`` of REGISTERS agree all the same; that is taken off.
    """
    filled = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=1)
    agree = ((a == b) & (a != _EMPTY)).sum(axis=1)
    counted = np.maximum(filled, 1)
    return np.maximum(0.0, (agree - by_chance * (1 - agree / counted)) / counted), filled


def may_link(a: np.ndarray, b: np.ndarray, by_chance: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose estimate isn't clearly below the threshold."""
    found, filled = estimate(a, b, by_chance)
    p = percent / 100
    return found >= p - SPREAD * np.sqrt(p * (1 - p) / np.maximum(filled, 1))


def _alike(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes allow a link."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _families(sets: DataFrame, percent: int) -> DataFrame:
    """set, family of the sets (set, n, tokens: the bands) that may have links."""
    posts = sets.select("set", F.posexplode("tokens").alias("band", "word")).where("word <> 0").select("set", F.xxhash64("band", "word").alias("key"))
    lists = posts.groupBy("key").agg(F.min("set").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = space.cut_large(lists, "band-lists")
    met = space.cut_large(posts.join(lists, "key"), "band-sets")
    short = met.where(F.col("m") <= SHORT_LIST).groupBy("key").agg(F.sort_array(F.collect_list("set")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = space.cut_large(short.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), "band-pairs")
    side = [sets.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}")) for c in "ab"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            a, b = (batch.column(f"t_{c}").flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS) for c in "ab")
            n_a, n_b = (batch.column(f"n_{c}").to_numpy() for c in "ab")
            keep = _alike(n_a, n_b, percent) & may_link(a, b, chance(_met(n_a), _met(n_b)), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    close = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInArrow(near, "a long, b long")
    starred = met.where((F.col("m") > SHORT_LIST) & (F.col("set") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("set").alias("b"))
    edges = space.cut_large(close.unionByName(starred).distinct(), "family-links", done=(lists, met, pairs))
    return components(edges).select(F.col("node").alias("set"), F.col("label").alias("family"))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sorted sets have ``percent`` of their union in common."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` (None: within ``left``), as pairs (i, j).

    Sets are numbered left first. A pair that the forest joins already isn't looked at.
    """
    base = 0 if right is None else len(left)
    sets = left if right is None else left + right
    other = np.arange(base, len(sets))
    rows = np.array([registers(s) for s in sets]).reshape(-1, REGISTERS)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    met, label = _met(sizes), np.arange(len(sets))
    out = []
    for i in range(len(left)):
        able = other[(other > i) & (label[other] != label[i]) & _alike(sizes[other], sizes[i], percent)]
        if not len(able):
            continue
        able = able[may_link(rows[able], rows[i : i + 1], chance(met[able], met[i : i + 1]), percent)]
        for j in able.tolist():
            if label[j] != label[i] and linked(sets[i], sets[j], percent):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


#: HyperMinHash in place of T-occurrence search.
METHOD = Method(bands, _families, forest)


def near_copies(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links reach, and ``kept`` tells whether it is the row's own. A null or empty
    text, or one without words, has no shingles, its own doc_id, and is kept. A row without a doc_id takes no part: its
    component_id and ``kept`` are null. Rows with equal sets are linked, also those that share a doc_id. An empty table gives
    none.
    """
    classes = jaccard_classes(docs, size=size, percent=percent, method=METHOD)
    return classes.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(space.table(spark, sf_dir, "documents"), size=SHINGLE, percent=PERCENT)


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * m >= 85 * (x.n + y.n - m)),
c(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.reached) AS component_id, d.doc_id = min(c.reached) AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
