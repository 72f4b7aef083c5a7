"""Operator 11: alignment of two tokenizers' tokens of one text.

A is a byte-level BPE, B a SentencePiece model; both get the text with a space in front, and their tokens tile its bytes. B's
tokens are a static index of intervals: sorted starts and ends. A stabbing query by bisection gives the B tokens that each A
token overlaps; the gap after an A token is a group boundary if none of them spans it.

Neither tokenizer joins anything over a space that follows a visible character (see ``cuts``), so a text's alignment is that
of its units one after another. Each distinct unit is aligned once and remembered; a text is the sum of its units.

Texts are encoded once, and written with their distinct id pairs. Corpus-wide counts of pairs are one aggregate of that table;
they are a statistic of the two vocabularies, and mostly few: up to MOST_PAIRS of them are broadcast, more are joined.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import space
from .pieces import PieceModel
from .words import chunks, flat_bytes, loaded, only, spans

#: Pairs of ids that are broadcast at most (17 bytes each); beyond that they are joined.
MOST_PAIRS = 4_000_000
#: Units that a process remembers at most; beyond that it starts anew. Units that are encoded as one text.
MOST_KNOWN, TOGETHER = 300_000, 1000
#: Bytes of texts at a time.
PART_BYTES = 1 << 20


def _visible(unit: bytes) -> bool:
    """Whether a unit ends in a character after which ``cuts`` cuts; of those with several bytes, only two-byte ones are looked for."""
    return 0x20 < unit[-1] < 0x7F or (unit[-1] >= 0x80 and 0xC3 <= unit[-2] < 0xE0)


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin in the texts data[at[i]:at[i + 1]]: at spaces and line feeds after a visible character, and at each text's first byte.

    A's pattern ends a token before white space after a visible character; no piece of B goes on past a space that follows a
    letter, nor has one a line feed (both are checked when the model is loaded). Of characters with several bytes only those
    count whose first byte no white space has.
    """
    n = len(data)
    begin = np.zeros(n + 1, dtype=bool)
    p1, p2, p3 = (np.r_[np.zeros(k, dtype=np.uint8), data[: n - k]] if n > k else np.zeros(n, dtype=np.uint8) for k in (1, 2, 3))
    two = (p1 >= 0x80) & (p2 >= 0xC3) & (p2 < 0xE0)
    three = (p1 >= 0x80) & (p2 >= 0x80) & (p2 < 0xC0) & ((p3 >= 0xE4) | (p3 == 0xE0))
    begin[:n] = ((data == 0x20) | (data == 0x0A)) & (((p1 > 0x20) & (p1 < 0x7F)) | two | three)
    begin[at] = True
    return np.flatnonzero(begin[:n])


class Aligner:
    """Two tokenizers, and the units whose tokens have been aligned."""

    def __init__(self, a_path: str, b_path: str, overlaps: bool) -> None:
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = PieceModel(b_path)
        if b"\n" in self.b.shown[: self.b.shown_at[-1]][np.repeat(~self.b.is_byte, np.diff(self.b.shown_at))].tobytes():
            raise ValueError("a piece has a line feed: units are not independent in this model")
        self.overlaps = overlaps
        # The byte-level alphabet: visible Latin-1 characters stand for themselves, the others follow from U+0100 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in own} | {chr(0x100 + i): x for i, x in enumerate(sorted(set(range(256)) - set(own)))}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        added = self.a.get_added_tokens_decoder()
        raw = [n.encode() if i in added else bytes(byte[c] for c in n) for i, n in enumerate(names)]
        self.a_shown, self.a_at = np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
        self.forget()

    def forget(self) -> None:
        """Start with no known units."""
        self.known: dict[bytes, int] = {}
        self.shown: list[bytes | None] = []  # groups as text; None: the tokens' bytes aren't the unit's
        self.sizes = np.zeros((0, 3), dtype=np.int64)  # A tokens, B tokens, groups
        self.pairs, self.pairs_at = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def encoded(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and B: the ids of all texts, the bytes of each id, and the n + 1 offsets of the texts. Texts begin with a space."""
        shown = [t.decode() for t in texts]
        found = [x.ids for x in self.a.encode_batch_fast(shown, add_special_tokens=False)]
        a = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64)
        b, b_of = self.b.encode(pa.array([t[1:] for t in shown], pa.large_string()), add_ids=False)
        b = b.astype(np.int64)
        return [(a, self.a_at[a + 1] - self.a_at[a], np.r_[0, np.cumsum([len(x) for x in found])]), (b, self.b.shown_at[b + 1] - self.b.shown_at[b], b_of)]

    def learn(self, units: list[bytes]) -> None:
        """Align units that aren't known yet. Many are encoded as one text each time: a space parts them."""
        # A unit that ends a text may end in white space; what follows would change it, so it is encoded alone.
        joined = [u for u in units if _visible(u)]
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)] + [[u] for u in units if not _visible(u)]
        while groups:
            texts = [b" x" + b"".join(g) for g in groups]
            sides = self.encoded(texts)
            good = np.ones(len(texts), dtype=bool)
            size = np.array([len(t) for t in texts])
            for (ids, width, of), shown, at in zip(sides, (self.a_shown, self.b.shown), (self.a_at, self.b.shown_at), strict=True):
                total = np.r_[0, np.cumsum(width)]
                good &= total[of[1:]] - total[of[:-1]] == size
                for i in np.flatnonzero(good).tolist():
                    own = ids[of[i] : of[i + 1]]
                    good[i] = shown[spans(at[own], width[of[i] : of[i + 1]])].tobytes() == texts[i]
            live = [np.repeat(good, np.diff(of)) for _, _, of in sides]
            if good.any():
                (a, a_width, _), (b, b_width, _) = sides
                self._add([g for g, ok in zip(groups, good.tolist(), strict=True) if ok], a[live[0]], np.cumsum(a_width[live[0]]), b[live[1]], np.cumsum(b_width[live[1]]))
            failed = [g for g, ok in zip(groups, good.tolist(), strict=True) if not ok]
            if lost := [g[0] for g in failed if len(g) == 1]:
                self._keep(lost, [None] * len(lost), np.zeros((len(lost), 3), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(lost), dtype=np.int64))
            groups = [half for g in failed if len(g) > 1 for half in (g[: len(g) // 2], g[len(g) // 2 :])]
        self.b.forget()
        if self._parts:
            self.sizes = np.concatenate([self.sizes, *[p[0] for p in self._parts]])
            self.pairs = np.concatenate([self.pairs, *[p[1] for p in self._parts]])
            self.pairs_at = np.r_[self.pairs_at, self.pairs_at[-1] + np.cumsum(np.concatenate([p[2] for p in self._parts]))]
            self._parts = []

    def _keep(self, units: list[bytes], shown: list[bytes | None], sizes: np.ndarray, pairs: np.ndarray, n_pairs: np.ndarray) -> None:
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.shown += shown
        self._parts.append((sizes, pairs, n_pairs))

    def _add(self, groups: list[list[bytes]], a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> None:
        """Align the tokens of all texts, " x" and the units of a group each, one after another, and keep those of the units."""
        first, last, bound = stabbed(a_end, b_end)
        a_to, b_to = np.flatnonzero(bound) + 1, last[bound] + 1  # groups of tokens end before these
        ends = a_end[bound]
        marks = np.cumsum([x for g in groups for x in (2, *map(len, g))])  # " x" and each unit end here
        stop = np.searchsorted(ends, marks)
        if not (stop < len(ends)).all() or not (ends[stop] == marks).all():
            raise ValueError("a token spans a space after a visible character: units are not independent in these tokenizers")
        unit = np.ones(len(marks), dtype=bool)
        unit[np.r_[0, np.cumsum([len(g) + 1 for g in groups])[:-1]]] = False
        to = np.flatnonzero(unit)
        begin, stop = stop[to - 1] + 1, stop[to] + 1  # a unit's groups of tokens
        if self.overlaps:
            count = last - first + 1
            code, total = np.repeat(a, count) << 32 | b[spans(first, count)], np.r_[0, np.cumsum(count)]
        else:
            code, total = (a << 32 | b[last])[bound], np.r_[0, np.cumsum(bound)]
        a_from, b_from = np.r_[0, a_to], np.r_[0, b_to]
        lo, hi = total[a_from[begin]], total[a_from[stop]]
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_at, b_at = a_from.tolist(), b_from.tolist()
        group = [(a_text[i] if j == i + 1 else ",".join(a_text[i:j])) + "|" + (b_text[k] if m == k + 1 else ",".join(b_text[k:m])) for i, j, k, m in zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:], strict=True)]
        shown: list[bytes | None] = [";".join(group[i:j]).encode() for i, j in zip(begin.tolist(), stop.tolist(), strict=True)]
        sizes = np.stack([a_from[stop] - a_from[begin], b_from[stop] - b_from[begin], stop - begin], axis=1)
        self._keep([u for g in groups for u in g], shown, sizes, code[spans(lo, hi - lo)], hi - lo)

    def units_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The known units of all texts, flat, and the n + 1 offsets of the texts in them. An empty text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        blank = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
        data, at = flat_bytes(pc.binary_join_element_wise(blank, texts, pa.scalar("", pa.large_string())))
        if not len(data):
            return np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        start = cuts(data, at)
        code = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(data)].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        names = code.dictionary.to_pylist()
        if len(self.known) + len(names) > MOST_KNOWN:
            self.forget()
        row = list(map(self.known.get, names))
        if fresh := [u for u, k in zip(names, row, strict=True) if k is None]:
            self.learn(fresh)
            row = list(map(self.known.get, names))
        return np.array(row, dtype=np.int64)[code.indices.to_numpy()], np.searchsorted(start, at)

    def usable(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts that have tokens: not empty, and both tokenizers give their bytes."""
        bad = np.r_[0, np.cumsum(self.sizes[row, 0] == 0)]
        return (at[1:] > at[:-1]) & (bad[at[1:]] == bad[at[:-1]])


def stabbed(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each A token the first and the last B token that it overlaps, and whether no B token spans the gap after it."""
    a_start, b_start = np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]
    first = np.searchsorted(b_end, a_start, side="right")
    last = np.searchsorted(b_start, a_end, side="left") - 1
    return first, last, b_end[last] == a_end


def aligner(a_path: str, b_path: str, overlaps: bool) -> Aligner:
    """The tokenizers at these paths, loaded once in each process."""
    known, name = loaded("aligners"), f"{a_path}:{b_path}:{overlaps}"
    if name not in known:
        known[name] = Aligner(a_path, b_path, overlaps)
    return known[name]


def _counted(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of each text (texts rise), and how often each occurs in it."""
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])]) if len(code) else np.zeros(0, dtype=np.int64)
    return text[first], code[first], np.diff(np.r_[first, len(code)]).astype(np.int64)


def _aligned(docs: DataFrame, a_path: str, b_path: str, overlaps: bool, with_groups: bool) -> DataFrame:
    """A row for each text: what it gives by itself, and its distinct pairs with how often it links them. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("aligners")
        own = aligner(a_path, b_path, overlaps)
        for batch in batches:
            for part in chunks(batch, most=PART_BYTES):
                row, at = own.units_of(part.column("text"))
                ok = own.usable(row, at)
                sums = np.concatenate([np.zeros((1, 3), dtype=np.int64), np.cumsum(own.sizes[row], axis=0)])
                n_a, n_b, n_groups = (np.where(ok[:, None], sums[at[1:]] - sums[at[:-1]], 0)).T
                shown = list(map(own.shown.__getitem__, row.tolist()))
                texts = [b";".join(shown[i:j]) if good else None for i, j, good in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist(), strict=True)]
                live = np.repeat(ok, np.diff(at))
                text = np.repeat(np.arange(len(ok)), np.diff(at))[live]
                links = (own.pairs_at[1:] - own.pairs_at[:-1])[row[live]]
                text, code, times = _counted(np.repeat(text, links), own.pairs[spans(own.pairs_at[row[live]], links)])
                ends = np.searchsorted(text, np.arange(len(ok) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (code, times)]
                columns = {"row": part.column("row"), "doc_id": part.column("doc_id"), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups)}
                columns["n_links"] = pa.array(np.add.reduceat(np.r_[times, 0], ends[:-1]) * (np.diff(ends) > 0) if len(ok) else times)
                columns["groups_sha256"] = pa.array(["" if t is None else hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                if with_groups:
                    columns["groups"] = pa.array(["" if t is None else t.decode() for t in texts], pa.string())
                yield pa.RecordBatch.from_pydict(columns | {"pairs": lists[0], "times": lists[1]})

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + ("groups string, " if with_groups else "") + "pairs array<long>, times array<long>"
    return space.cut(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema), "aligned")


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair (A's id << 32 | B's id), n, best (n is the most of all pairs of that B id): links of all texts. Written once."""
    counted = texts.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counted = space.cut(counted, "pair-counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return space.cut(counted.withColumn("b", b).join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs", done=(counted,))


def align(docs: DataFrame, a_path: str, b_path: str, *, overlaps: bool = False, with_groups: bool = False, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups) for each row of ``docs`` (doc_id, text).

    ``a_path`` is a byte-level tokenizer's file, ``b_path`` a SentencePiece model. A group is ``a1,a2|b1``, groups are joined by
    ``;``. Links are pairs of an A and a B token that end at the same byte, or, with ``overlaps``, that share bytes. n_best
    counts links whose id pair no other pair of the B id exceeds in the corpus, count_sum adds up the counts of the links' pairs.

    A null or empty text, or one whose tokens don't give its bytes (U+2581 reads as a space), has no tokens: zeros and ''; it
    doesn't count in the corpus either. Each row gives a row, whatever doc_id it has or lacks. Other columns are ignored, and an
    empty table gives none. Up to ``most_pairs`` distinct id pairs are broadcast; more are joined.
    """
    texts = _aligned(space.documents(docs), a_path, b_path, overlaps, with_groups)
    pairs = pair_counts(texts)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    if pairs.count() > most_pairs:  # read from the files' footers
        links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
        sums = links.join(pairs, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        return texts.drop("pairs", "times").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(names)
    table = pairs.toArrow().sort_by("pair")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    space.drop(pairs)
    kept = [c for c in names if c not in ("n_best", "count_sum")]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        code, n, best = sent.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            size = lists.value_lengths().to_numpy()
            found, of = np.searchsorted(code, lists.flatten().to_numpy()), np.r_[0, np.cumsum(size)]
            columns = {c: batch.column(c) for c in kept}
            for name, values in (("n_best", best), ("count_sum", n)):
                total = np.r_[0, np.cumsum(values[found] * times)] if len(found) else np.zeros(1, dtype=np.int64)
                columns[name] = pa.array(total[of[1:]] - total[of[:-1]])
            yield pa.RecordBatch.from_pydict(columns)

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    return texts.drop("row").mapInArrow(looked_up, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_best long, count_sum long").select(names)


def op11_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(space.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
