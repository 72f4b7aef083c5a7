"""Operator 5: quality rules by distribution divergence.

A document's histograms, over classes of characters and over the common words of a language, are compared with references
of each language by Jensen-Shannon distance. References are sums over all documents: pooled counts of character classes,
and counts of the COMMON most frequent words with one bin for all others. Documents shorter than the guards aren't judged
by a histogram that so few counts can't fill: one of characters needs GUARD_CHARACTERS of them, one of words GUARD words.

A text is judged by the nearest of its own language's reference and those of the large languages, for labels can be wrong.
References of small languages judge texts of their own only, so that a few odd documents excuse no others, and texts without
a language, which are judged by all. A text whose language gives no reference is judged by the base rules alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import space
from .words import Words, chunks, flat_bytes, mixed, only, rolling, spans, split_words

#: Words with a bin of their own, in each language.
COMMON = 40
#: Words a document has at least, to be kept, and percent of its words in repeated 3-word windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Languages that have a reference, those with most documents; texts of others count as texts without a language.
MOST_LANGUAGES = 1000
#: Share of all documents at which a language's reference counts half where it judges texts of other languages.
HALF_SHARE = 0.001
#: Documents at which a language's reference counts half for its own texts: what few texts have in common says little.
HALF_DOCUMENTS = 0.5
#: Words from which a document is judged by its words, and by them more strictly; characters from which it is by those.
GUARD, GUARD_STRICT, GUARD_CHARACTERS = 60, 100, 300
#: Jensen-Shannon distance (the root of the divergence, to base 2) of the characters from the nearest reference at most.
MOST_CHARACTERS = 0.26
#: Distance of the words at most, as a share of that which a text without any common word has: how much of a language its
#: common words make up, and so how far a text can be from it, differs between languages and corpora.
MOST_WORDS, MOST_WORDS_STRICT = 0.97, 0.9
#: Parts of a language's words of which the most frequent are found one by one.
PARTS = 64
#: Classes: a-z, A-Z, digits, white space, marks of sentences, symbols, other ASCII, all beyond ASCII.
CLASSES = 8

_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[0xC0:] = 7
_CONTINUED = slice(0x80, 0xC0)
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of counts ``p`` from the counts ``q``; 1 where a row has no counts."""
    total = p.sum(axis=1, keepdims=True)
    a, b = p / np.maximum(total, 1), np.broadcast_to(q / q.sum(), p.shape)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(a > 0, a * np.log2(a / m), 0) + np.where(b > 0, b * np.log2(b / m), 0)).sum(axis=1) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(d, 0, 1)), 1.0)


def class_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    lead = (data & 0xC0) != 0x80
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(text[lead] * CLASSES + _CLASS[data[lead]], minlength=(len(at) - 1) * CLASSES).reshape(-1, CLASSES)


def per_text(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many are true among of[i]:of[i + 1], for each i."""
    return np.diff(np.r_[0, np.cumsum(mask)][of])


def base_counts(data: np.ndarray, at: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text; ``words`` are its words, unchanged."""
    n_words = np.diff(words.of)
    points = np.r_[0, np.cumsum((words.letters & 0xC0) != 0x80)][words.at]
    windows = np.maximum(n_words - 2, 0)
    begin = spans(words.of[:-1], windows)
    text = np.repeat(np.arange(len(n_words)), windows)
    key = mixed(rolling(words.hashes(), 3)[begin] ^ mixed(text.astype(np.uint64) + np.uint64(1))) if len(begin) else np.zeros(0, dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words.at) - 1, dtype=bool)
    for k in range(3):
        covered[begin[twice] + k] = True
    return {"n_words": n_words, "word_chars": np.diff(points[words.of]), "n_symbols": per_text(_SYMBOL[data], at), "n_dup_lines": _dup_lines(data, at, words), "n_repeat_words": per_text(covered, words.of)}


def _dup_lines(data: np.ndarray, at: np.ndarray, words: Words) -> np.ndarray:
    n = len(at) - 1
    # Each text gets a line feed at its end, so that all lines end alike.
    out = np.full(len(data) + n, 0x0A, dtype=np.uint8)
    shift = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(data)) + shift] = data
    end = np.flatnonzero(out == 0x0A) + 1
    offsets = np.r_[0, end].astype(np.int64)
    if not len(end):
        return np.zeros(n, dtype=np.int64)
    text = np.searchsorted(at[1:] + np.arange(1, n + 1), end)
    start = words.start + np.repeat(np.arange(n), np.diff(words.of))
    filled = np.diff(np.searchsorted(start, offsets)) > 0
    code = pa.Array.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).dictionary_encode().indices.to_numpy()
    pairs = np.unique(text[filled].astype(np.int64) << 32 | code[filled])
    return np.bincount(text[filled], minlength=n) - np.bincount(pairs >> 32, minlength=n)


# --- references ---------------------------------------------------------------------------------------------------


@dataclass
class Reference:
    """What a language is compared by. Its size doesn't depend on the corpus."""

    lang: str
    weight: float  # what it counts for texts of other languages
    sure: float  # what it counts for its own
    classes: np.ndarray
    words: list[bytes]
    counts: np.ndarray  # of the words, then of all others


def _corpus_counts(docs: DataFrame) -> DataFrame:
    """lang, word (null: a class of characters), class, n: counts over batches, for Spark to add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                langs = part.column("lang").dictionary_encode()
                names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
                data, at = flat_bytes(part.column("text"))
                words = split_words(data, at, lower=True)
                code, distinct = words.coded()
                owner = np.repeat(lang, np.diff(words.of)).astype(np.int64)
                pairs, n = np.unique(owner * max(1, len(distinct)) + code, return_counts=True)
                classes = class_counts(data, at)
                pooled = np.zeros((len(names), CLASSES), dtype=np.int64)
                np.add.at(pooled, lang, classes)
                rows_lang = [names[k] for k in (pairs // max(1, len(distinct))).tolist()] + [x for x in names for _ in range(CLASSES + 1)]
                # Words are only compared as bytes; hexadecimal keeps them whole in a string column.
                text = pa.concat_arrays([distinct.take(pa.array(pairs % max(1, len(distinct)))).cast(pa.binary()), pa.nulls(len(names) * (CLASSES + 1), pa.binary())])
                kind = np.r_[np.full(len(pairs), -1), np.tile(np.arange(CLASSES + 1), len(names))]
                number = np.r_[n, np.c_[pooled, np.bincount(lang, minlength=len(names))].ravel()]
                yield pa.RecordBatch.from_pydict({"lang": pa.array(rows_lang, pa.string()), "word": text, "class": pa.array(kind, pa.int32()), "n": pa.array(number, pa.int64())})

    return docs.mapInArrow(run, "lang string, word binary, class int, n long")


def references(docs: DataFrame, *, common: int = COMMON) -> list[Reference]:
    """References of all languages in ``docs`` (lang, text). Rows without a language, or without text, add to none.

    All documents are counted. What comes to the driver is ``common`` words and a few sums for each of MOST_LANGUAGES.
    """
    rows = _corpus_counts(docs.where("lang IS NOT NULL AND text <> ''").select("lang", "text"))
    counts = space.cut(rows.groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "counts")
    sizes = counts.where(F.col("class") == CLASSES).select("lang", "n")
    large = sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang", F.col("n").alias("documents"))
    sums = {r["lang"]: r["documents"] for r in large.collect()}
    if not sums:
        return []
    documents = sizes.agg(F.sum("n")).first()[0]
    words = counts.where(F.col("class") == -1).select("lang", "word", "n")
    # The best of each part of a language's words first, so that no task sees a whole language.
    part, order = F.pmod(F.xxhash64("word"), F.lit(PARTS)), (F.desc("n"), "word")
    some = words.withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("k") <= common)
    top = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= common).join(large, "lang").select("lang", "word", "n", "k").collect()
    total = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).join(large, "lang").select("lang", "n").collect()}
    pooled = {(r["lang"], r["class"]): r["n"] for r in counts.where(F.col("class").between(0, CLASSES - 1)).join(large, "lang").select("lang", "class", "n").collect()}
    best = {}
    for r in sorted(top, key=lambda r: r["k"]):
        best.setdefault(r["lang"], []).append(r)
    out = []
    for lang in sorted(sums):
        n = [r["n"] for r in best.get(lang, [])]
        share = sums[lang] / documents
        out.append(Reference(lang, share / (share + HALF_SHARE), sums[lang] / (sums[lang] + HALF_DOCUMENTS), np.array([pooled.get((lang, c), 0) for c in range(CLASSES)], dtype=float), [bytes(r["word"]) for r in best.get(lang, [])], np.array([*n, total.get(lang, 0) - sum(n)], dtype=float)))
    return out


def _distances(ref: Reference, rows: np.ndarray, classes: np.ndarray, text: np.ndarray, code: np.ndarray, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the texts ``rows`` from a reference: of characters, and of words as a share of the farthest."""
    of_classes = js_distance(classes[rows], ref.classes)
    if not ref.counts.sum():
        return of_classes, np.ones(len(rows))
    new = np.full(len(classes), -1)
    new[rows] = np.arange(len(rows))
    owner = new[text]
    bin_ = np.full(max(1, len(place)), len(ref.words), dtype=np.int64)
    for k, w in enumerate(ref.words):
        if w in place:
            bin_[place[w]] = k
    width = len(ref.words) + 1
    counts = np.bincount(owner[owner >= 0] * width + bin_[code[owner >= 0]], minlength=len(rows) * width).reshape(len(rows), width)
    alien = np.zeros((1, width))
    alien[0, -1] = 1
    return of_classes, js_distance(counts, ref.counts) / max(1e-9, js_distance(alien, ref.counts)[0])


def nearest(refs: list[Reference], data: np.ndarray, at: np.ndarray, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distance from a reference, of its characters, and of its words as a share of the farthest.

    ``langs`` are the texts' languages. A text is judged by its own language's reference, whose distances count the less the fewer
    documents it comes from. If that finds it too far (its label
    may be wrong), or it has none, the nearest of all counts, where another language's nearness, 1 - distance, counts by its
    weight: that rises with the language's share of all documents, without a step.
    """
    n = len(at) - 1
    classes = class_counts(data, at)
    words = split_words(data, at, lower=True)
    code, distinct = words.coded()
    text = np.repeat(np.arange(n), np.diff(words.of))
    place = {w: k for k, w in enumerate(distinct.to_pylist())}
    of_classes, of_words = np.ones(n), np.ones(n)
    number = {r.lang: k for k, r in enumerate(refs)}
    own = np.array([-1 if x is None else number.get(x, -1) for x in langs]) if n else np.zeros(0, dtype=np.int64)
    for k in np.unique(own[own >= 0]).tolist():
        rows = np.flatnonzero(own == k)
        of_classes[rows], of_words[rows] = (refs[k].sure * x for x in _distances(refs[k], rows, classes, text, code, place))
    far = (of_classes > MOST_CHARACTERS) | (of_words > min(MOST_WORDS, MOST_WORDS_STRICT))
    for k, ref in enumerate(refs):
        rows = np.flatnonzero(far & (own != k))
        if len(rows):
            for known, found in zip((of_classes, of_words), _distances(ref, rows, classes, text, code, place), strict=True):
                known[rows] = np.minimum(known[rows], 1 - ref.weight * (1 - found))
    return of_classes, of_words


def _verdicts(text: pa.Array, langs: list[str | None], refs: list[Reference]) -> dict[str, pa.Array]:
    data, at = flat_bytes(text)
    own = base_counts(data, at, split_words(data, at))
    n_words = own["n_words"]
    failed = (n_words < LEAST_WORDS) | (100 * own["n_repeat_words"] > MOST_REPEATED * n_words)
    of_classes, of_words = nearest(refs, data, at, langs) if refs else (np.zeros(len(n_words)), np.zeros(len(n_words)))
    characters = per_text((data & 0xC0) != 0x80, at)
    odd = (characters >= GUARD_CHARACTERS) & (of_classes > MOST_CHARACTERS)
    odd |= (n_words >= GUARD) & (of_words > np.where(n_words >= GUARD_STRICT, MOST_WORDS_STRICT, MOST_WORDS))
    counts = {k: pa.array(v, pa.int64()) for k, v in own.items()}
    return counts | {"base_failed": pa.array(failed), "kept": pa.array(~failed & ~odd), "js_characters": pa.array(of_classes), "js_words": pa.array(of_words)}


def judge(docs: DataFrame, refs: list[Reference]) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and both distances for each row of ``docs`` (doc_id, text, lang).

    A null or empty text has no words and fails. Where no reference judges, only the base rules do. Rows that share a doc_id, or have none, are each judged alone; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | _verdicts(part.column("text"), part.column("lang").to_pylist(), refs))

    return space.documents(docs, "lang").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_characters double, js_words double")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps, by references from all of ``docs``."""
    refs = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(_verdicts(part.column("text"), part.column("lang").to_pylist(), refs)["kept"])

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame) -> DataFrame:
    """``judge`` with references from the same documents."""
    return judge(docs, references(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(space.table(spark, sf_dir, "documents"))
