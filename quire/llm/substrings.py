"""Operator 9: removal of passages that an earlier document has, by Rabin-Karp hashes of all fixed-length word windows.

Most windows occur once, and shuffling all of them would move more bytes than the texts have. So each window is first
known by its minimizer, the least hash of the GRAM-word runs in it: equal windows have equal minimizers, neighbouring
windows mostly share one, and only windows whose minimizer two documents have can repeat. All of those are hashed and
counted in Spark; whole copies of an earlier text need no windows. Nothing is sampled: a window that repeats is found.

A window's hash has 64 bits; two different windows that meet share one with a chance of 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import space
from .words import Words, chunks, flat_bytes, mixed, only, rolling, spans, split_words

#: Words of a window, and of the runs of which the least hash is its minimizer.
WINDOW, GRAM = 50, 25


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def _windows(words: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers at which windows begin, the text of each, and its minimizer."""
    count = np.maximum(np.diff(words.of) - window + 1, 0)
    begin = spans(words.of[:-1], count)
    least = _least(rolling(h, gram), window - gram + 1)
    return begin, np.repeat(np.arange(len(count)), count), least[begin] if len(begin) else np.zeros(0, dtype=np.uint64)


def _salted(h: np.ndarray) -> np.ndarray:
    return mixed(h ^ np.uint64(0xA0761D6478BD642F))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def minimizers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """key, whole, doc_id: the minimizers of each text (whole: 0), and a row for the text itself (key and whole: its hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                data, at = flat_bytes(part.column("text"))
                words = split_words(data, at)
                _, text, least = _windows(words, words.hashes(), window, gram)
                new = np.ones(len(text), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
                text, least = text[new], least[new]
                full = np.flatnonzero(np.diff(words.of) >= window)
                own = np.array([xxhash.xxh3_64_intdigest(data[at[i] : at[i + 1]]) for i in full], dtype=np.uint64)
                doc = part.column("doc_id").take(pa.array(np.r_[text, full]))
                whole = pa.concat_arrays([pa.array(np.zeros(len(text), dtype=np.int64)), part.column("h").take(pa.array(full)).cast(pa.int64())])
                yield pa.RecordBatch.from_pydict({"key": _long(np.r_[least, own]), "whole": whole, "doc_id": doc})

    return docs.mapInArrow(run, "key long, whole long, doc_id long")


def window_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """whash, doc_id, h, start: the windows of the texts whose minimizer is among ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                words = split_words(*flat_bytes(part.column("text")))
                h = words.hashes()
                begin, text, least = _windows(words, h, window, gram)
                keys = part.column("keys")
                may = np.zeros(len(begin), dtype=bool)
                edge = np.searchsorted(text, np.arange(part.num_rows + 1))
                flat, key_at = keys.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(keys.value_lengths().fill_null(0).to_numpy())]
                for i in range(part.num_rows):
                    own = slice(edge[i], edge[i + 1])
                    may[own] = np.isin(least[own], flat[key_at[i] : key_at[i + 1]])
                at = np.flatnonzero(may)
                if len(at):
                    rows = pa.array(text[at])
                    hashed = rolling(_salted(h), window)[begin[at]]
                    yield pa.RecordBatch.from_pydict({"whash": _long(hashed), "doc_id": part.column("doc_id").take(rows), "h": part.column("h").take(rows), "start": pa.array((begin[at] - words.of[text[at]]).astype(np.int32))})

    return docs.mapInArrow(run, "whash long, doc_id long, h long, start int")


def repeated_windows(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """What is to be removed: doc_id, found = list of (h, whole, starts), for rows of ``docs`` (doc_id, text, h)."""
    known = docs.where("doc_id IS NOT NULL")
    grams = space.cut(minimizers(known, window, gram), "minimizers")
    shared = space.cut(grams.groupBy("key", "whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "whole", "least"), "shared")
    met = grams.join(shared, ["key", "whole"])
    lists = met.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("whole") == 0, F.col("key"))).alias("keys"),
        F.collect_set(F.when((F.col("whole") != 0) & (F.col("doc_id") > F.col("least")), F.col("whole"))).alias("copies"),
    )
    lists = space.cut(lists, "lists")
    open_ = known.join(lists, "doc_id").where((F.size("keys") > 0) & ~F.array_contains("copies", F.col("h")))
    rows = space.cut(window_rows(open_.select("doc_id", "text", "h", "keys"), window, gram), "windows")
    firsts = space.cut(rows.groupBy("whash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("whash", "least"), "firsts")
    again = rows.join(firsts, "whash").where("doc_id > least").groupBy("doc_id", "h").agg(F.collect_list("start").alias("starts"))
    copies = lists.select("doc_id", F.explode("copies").alias("h")).select("doc_id", "h", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts"))
    found = again.select("doc_id", "h", F.lit(False).alias("whole"), "starts").unionByName(copies)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("h", "whole", "starts")).alias("found"))


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows that begin at ``starts`` cover: repeated windows merge into maximal intervals."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove from every text the words covered by a ``window`` of words that also starts in a document with a smaller doc_id.

    Takes doc_id and text; other columns are ignored, but for ``with_text``. Returns for each row doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space) and intervals (array of [begin, end) in words); with
    ``with_text`` instead the columns of ``docs``, in their order and whatever their names, with the removed intervals cut out of ``text``, white space elsewhere
    unchanged. A null or empty text has no words. A row with a null doc_id neither loses words nor counts as a smaller
    document; of rows that share a doc_id none is the smaller. Copies of a text, however many, cost a row each.
    """
    own = space.documents(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    found = space.cut(repeated_windows(own, window=window, gram=gram), "repeats")
    # The other columns travel as one struct, so that none of their names can clash.
    kept = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")] if with_text else []
    rest = [F.struct(*[_named(f.name) for f in kept]).alias("rest")] if kept else []
    rows = space.documents(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), *rest)
    joined = rows.join(found, "doc_id", "left").select("doc_id", "text", "h", "found", *(["rest"] if kept else []))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<array<int>>"
    if with_text:
        schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *([StructField("rest", StructType(kept))] if kept else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                data, at = flat_bytes(part.column("text"))
                words = split_words(data, at)
                length = np.diff(words.at)
                n_words = np.diff(words.of)
                gone = np.zeros(len(length), dtype=bool)
                listed, h = part.column("found"), part.column("h").to_numpy()
                for i in np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False)):
                    for x in listed[int(i)].as_py():
                        if x["h"] == h[i]:
                            own = slice(words.of[i], words.of[i + 1])
                            gone[own] = True if x["whole"] else covered(int(n_words[i]), np.array(x["starts"], dtype=np.int64), window)
                n_removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.of[:-1]) * (n_words > 0) if part.num_rows else n_words
                if with_text:
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": _cut_out(data, at, words, gone, n_removed)} | ({"rest": part.column("rest")} if kept else {}))
                    continue
                keep = ~gone
                size = length[keep]
                letters = words.letters[np.repeat(keep, length)]
                out = np.full(len(letters) + len(size), 0x20, dtype=np.uint8)
                out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
                end = np.r_[0, np.cumsum(size + 1)][np.r_[0, np.cumsum(n_words - n_removed)]]
                shas = [hashlib.sha256(out[a : max(a, b - 1)]).hexdigest() for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
                edges = [np.flatnonzero(np.diff(np.r_[False, gone[words.of[i] : words.of[i + 1]], False])).reshape(-1, 2).tolist() if n_removed[i] else [] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": _long(n_words), "n_removed": _long(n_removed), "kept_sha256": pa.array(shas, pa.string()), "intervals": pa.array(edges, pa.list_(pa.list_(pa.int32())))})

    done = joined.mapInArrow(run, schema)
    if not with_text:
        return done
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _cut_out(data: np.ndarray, at: np.ndarray, words: Words, gone: np.ndarray, n_removed: np.ndarray) -> pa.Array:
    """The texts without the removed intervals; of the white space around an interval, that after it goes with it."""
    raw, out = data.tobytes(), []
    for i, n in enumerate(n_removed.tolist()):
        text = raw[at[i] : at[i + 1]]
        if n:
            first, parts, done = words.of[i], [], 0
            starts = words.start[words.of[i] : words.of[i + 1]] - at[i]
            for a, b in np.flatnonzero(np.diff(np.r_[False, gone[first : words.of[i + 1]], False])).reshape(-1, 2).tolist():
                parts.append(text[done : starts[a]])
                done = starts[b] if b < len(starts) else len(text)
            text = b"".join([*parts, text[done:]])
        out.append(text.decode())
    return pa.array(out, pa.string())


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(space.table(spark, sf_dir, "documents")).drop("intervals")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM m WHERE m < doc_id),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
g AS (SELECT e.doc_id, string_agg(e.w[e.j], ' ' ORDER BY e.j) FILTER (WHERE r.j IS NULL) AS kept, count(r.j) AS n
      FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.j = r.j GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
