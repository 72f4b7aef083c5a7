"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, centroids, crosstoken, hyperminhash, jaccard, licenses, neighbours, packing, pieces, pseudonyms, quality, secrets, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_warc": archives.op2_warc,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_quality": quality.op5_quality,
    "op6_secrets": secrets.op6_secrets,
    "op7_packing": packing.op7_packing,
    "op8_licenses": licenses.op8_licenses,
    "op9_substrings": substrings.op9_substrings,
    "op10_pseudonyms": pseudonyms.op10_pseudonyms,
    "op11_crosstoken": crosstoken.op11_crosstoken,
    "op12_hyperminhash": hyperminhash.op12_hyperminhash,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE_SQL: dict[str, str] = {"op2_warc": archives.OP2_SQL, "op4_jaccard": jaccard.OP4_SQL, "op9_substrings": substrings.OP9_SQL, "op12_hyperminhash": hyperminhash.OP12_SQL, "op13_centroids": centroids.OP13_SQL}
