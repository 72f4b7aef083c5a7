"""Operator 7: packing of tokenized documents into sequences, best fit first, then by swap-based local search.

Documents are tokenized, only those longer than a sequence are cut, and the pieces are dealt into shards of bounded size.
In a shard, pieces go by decreasing length to the fullest sequence that has room. Local search then exchanges pieces
between the sequences with room left: it moves one, swaps one for one, or two for one, always so that the sum of squared
fills rises, which empties the least full sequences. It looks at all of them, until no step is left or their room together
is less than a sequence, so that none can be emptied. Sequences that a shard leaves at most half full give their pieces to
a second packing, over all shards.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import space
from .words import chunks, flat_bytes, loaded, only, spans, split_words

#: Tokens of a sequence.
CAPACITY = 4096
#: The id after each document.
END_ID = 1
#: Tokens in a shard on average; with pieces of 100 tokens that is 40,000 pieces.
SHARD_TOKENS = 4_000_000
#: What a piece counts for in the size of a shard, besides its tokens: so that many small pieces are no burden either.
PIECE_COST = 50
#: Words that a process remembers at most; beyond that it starts anew.
_MOST_KNOWN = 500_000
#: Bytes of text that are tokenized at once: a word that occurs in several texts of a part is looked up once.
PART_BYTES = 2 << 20
_PLAIN = re.compile(rb"(?:[a-zA-Z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
#: 1: ASCII letter, 2: other ASCII, 0: what must stay with its neighbours (white space is cut in any case).
_KIND = np.array([1 if chr(i).isalpha() else 0 if chr(i) == "'" else 2 for i in range(128)] + [0] * 128, dtype=np.uint8)


class WordEncoder:
    """Ids by the tokenizers library, computed once for each distinct word.

    The tokenizer's rules never join text over white space, so a text's ids are those of its words one after another. This
    is checked when it is loaded: its normalizer and pre-tokenizer must be of the known kinds, and no added token may hold
    white space.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.by_word = set(normal) <= {"NFC", "Replace", "Lowercase"} and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the n + 1 offsets of the texts in them."""
        if not self.by_word:
            found = [x.ids for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=np.uint32), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
        data, offsets = flat_bytes(texts)
        raw = data.tobytes()
        if any(x in raw for x in self.added):
            words = split_words(data, offsets)
        else:
            # Runs of ASCII letters are tokens of the pre-tokenizer, whatever mark is beside them, but for an apostrophe.
            # A letter before a byte of another alphabet may make one character with it and stays as it is.
            kind = _KIND[data]
            cut = np.zeros(len(data), dtype=bool)
            cut[1:] = (kind[1:] ^ kind[:-1]) == 3
            capital = (data - 65 < 26) & (np.r_[kind[1:], 0] != 0)
            words = split_words(np.where(capital, data | 32, data), offsets, also=cut)
        code, distinct = words.coded()
        if len(self.known) + len(distinct) > _MOST_KNOWN:
            self.forget()
        names = distinct.to_pylist()
        row = list(map(self.known.get, names))
        fresh = [w for w, k in zip(names, row, strict=True) if k is None]
        if fresh:
            # Words of Latin letters only are one token of the pre-tokenizer each, so many of them can be encoded as one text.
            plain = [w for w in fresh if w.isalpha() or _PLAIN.fullmatch(w)]
            single = set(plain)
            other = [w for w in fresh if w not in single]
            texts = [b" ".join(plain[i : i + 1000]).decode() for i in range(0, len(plain), 1000)] + [w.decode() for w in other]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            count = [len(x) for x in ids[len(ids) - len(other) :]] if other else []
            flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32)
            last = np.flatnonzero(self.ends[flat[: len(flat) - sum(count)]])
            if len(last) != len(plain):
                raise ValueError("a word of letters gave more than one end of word")
            n = len(self.known)
            self.known.update(zip(plain + other, range(n, n + len(fresh)), strict=True))
            self.at = np.r_[self.at, self.at[-1] + np.cumsum(np.r_[np.diff(last, prepend=-1), np.array(count, dtype=np.int64)])]
            self.ids = np.r_[self.ids, flat]
            row = list(map(self.known.get, names))
        row = np.array(row, dtype=np.int64)[code]
        lengths = self.at[row + 1] - self.at[row]
        return self.ids[spans(self.at[row], lengths)], np.r_[0, np.cumsum(lengths)][words.of]


def encoder(path: str) -> WordEncoder:
    """The tokenizer at ``path``, built once in each process."""
    known = loaded("words")
    if path not in known:
        known[path] = WordEncoder(path)
    return known[path]


def tokenize_pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, row_hash (tells apart texts that share a doc_id), piece, start, length, ids_crc32.

    A null or empty text gives one piece, which holds END_ID only.
    """
    schema = "doc_id long, row_hash long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        own = encoder(path)
        for batch in batches:
            for part in chunks(batch, most=PART_BYTES):
                ids, at = own.encode(part.column("text"))
                n = len(at) - 1
                out = np.full(len(ids) + n, END_ID, dtype="<u4")
                begin = at + np.arange(n + 1)
                body = np.ones(len(out), dtype=bool)
                body[begin[1:] - 1] = False
                out[body] = ids
                count = -(-np.diff(begin) // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = spans(np.zeros(n, dtype=np.int64), count)
                lo = begin[doc] + piece * capacity
                hi = np.minimum(lo + capacity, begin[doc + 1])
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(doc)),
                    "row_hash": part.column("row_hash").take(pa.array(doc)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(piece * capacity),
                    "length": pa.array(hi - lo),
                    "ids_crc32": pa.array([zlib.crc32(out[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([out[a:b].astype(np.int32) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return space.documents(docs, F.xxhash64("text").alias("row_hash")).mapInArrow(run, schema)


# --- one shard ----------------------------------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: by decreasing length, each into the fullest bin with room."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # the distinct rooms that some bin has, sorted
    by_room: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if (left := room - size) > 0:
            if left not in by_room:
                insort(rooms, left)
                by_room[left] = []
            by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    Each underfull bin, the least full first, gives to those that are as full as it or fuller: of all steps the one that fills
    most, a move before an exchange before two for one. Passes go on until none finds a step, or until the room in all bins
    together is less than one bin's: then none can be emptied. The fuller of two bins gets fuller still by one token at
    least, so the search ends; bins that have been emptied are left out of the result.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    room = sum(capacity - f for f in fill)
    changed = True
    while changed and room >= capacity:
        changed = False
        for give in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: fill[b]):
            takers = None
            while bins[give] and room >= capacity:
                if takers is None:
                    takers = _Takers([b for b in range(len(bins)) if b != give and bins[b] and fill[give] <= fill[b] < capacity], bins, fill, size, capacity)
                step = takers.best(bins[give], size)
                if step is None:
                    break
                take, out, back = step
                moved = sum(size[i] for i in out) - sum(size[i] for i in back)
                bins[give] = [i for i in bins[give] if i not in out] + list(back)
                bins[take] = [i for i in bins[take] if i not in back] + list(out)
                fill[give] -= moved
                fill[take] += moved
                changed = True
                takers.changed(take, bins, fill, size)
            if not bins[give]:
                room -= capacity
    return [b for b in bins if b]


class _Takers:
    """Bins that may take pieces from one that gives, their rooms and pieces as flat arrays."""

    def __init__(self, chosen: list[int], bins: list[list[int]], fill: list[int], size: list[int], capacity: int) -> None:
        self.capacity = capacity
        self.bins = np.array(chosen, dtype=np.int64)
        self.room = np.array([capacity - fill[b] for b in chosen], dtype=np.int64)
        self.items = np.array([i for b in chosen for i in bins[b]], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(chosen)), [len(bins[b]) for b in chosen])
        self.sizes = np.array([size[i] for i in self.items.tolist()], dtype=np.int64)
        self.order()

    def order(self) -> None:
        """Pieces by bin, then size: one sorted array of keys for all bins."""
        self.key = self.owner * (self.capacity + 1) + self.sizes
        by = np.argsort(self.key, kind="stable")
        self.key, self.items, self.owner, self.sizes = self.key[by], self.items[by], self.owner[by], self.sizes[by]

    def changed(self, bin_: int, bins: list[list[int]], fill: list[int], size: list[int]) -> None:
        k = int(np.flatnonzero(self.bins == bin_)[0])
        self.room[k] = self.capacity - fill[bin_]
        other = self.owner != k
        own = np.array(bins[bin_], dtype=np.int64)
        self.items, self.owner = np.r_[self.items[other], own], np.r_[self.owner[other], np.full(len(own), k)]
        self.sizes = np.r_[self.sizes[other], [size[i] for i in own.tolist()]]
        self.order()

    def best(self, give: list[int], size: list[int]) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The bin that takes, what goes to it and what comes back; a kind of step is looked at if those before it have none."""
        if not len(self.bins):
            return None
        of_size = {}
        for i in sorted(give):
            of_size.setdefault(size[i], []).append(i)
        own = sorted(of_size)
        # A move: the largest piece that fits somewhere, to where the least room is left.
        fits = np.array(own)[np.array(own) <= self.room.max()]
        if len(fits):
            piece = int(fits[-1])
            k = int(np.where(self.room >= piece, self.room, self.capacity + 1).argmin())
            return int(self.bins[k]), (of_size[piece][0],), ()
        if (step := self._exchange(np.array(own))) is not None:
            gone, k, back = step
            return int(self.bins[k]), (of_size[gone][0],), (back,)
        pairs = {a + b: (a, b) for x, a in enumerate(own) for b in own[: x + 1] if a != b or len(of_size[a]) > 1}
        if pairs and (step := self._exchange(np.array(sorted(pairs)))) is not None:
            gone, k, back = step
            a, b = pairs[gone]
            return int(self.bins[k]), (of_size[a][0], of_size[b][-1]), (back,)
        return None

    def _exchange(self, totals: np.ndarray) -> tuple[int, int, int] | None:
        """Of the totals that may go: total, bin and piece that comes back, so that most of the bin's room is filled."""
        most = (0, 0, 0, 0)
        for a in range(0, len(totals), max(1, (1 << 20) // len(self.bins))):
            total = totals[a : a + max(1, (1 << 20) // len(self.bins))]
            # In each bin the least piece that makes room enough; it must be less than what comes.
            least = np.maximum(total[:, None] - self.room[None, :], 0)
            at = np.searchsorted(self.key, np.arange(len(self.bins))[None, :] * (self.capacity + 1) + np.minimum(least, self.capacity))
            inside = np.minimum(at, len(self.key) - 1)
            good = (at < len(self.key)) & (self.owner[inside] == np.arange(len(self.bins))[None, :])
            gain = np.where(good, total[:, None] - self.sizes[inside], 0)
            gain[gain > self.room[None, :]] = 0
            flat = int(gain.argmax())
            if (value := int(gain.ravel()[flat])) > most[0]:
                t, k = divmod(flat, len(self.bins))
                most = (value, int(total[t]), k, int(self.items[inside[t, k]]))
        return most[1:] if most[0] > 0 else None


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each item."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in sorted(items):
            where[i], offset[i] = b, at
            at += int(lengths[i])
    return where, offset


def _dealt(pieces: DataFrame, shard_tokens: int) -> tuple[DataFrame, int]:
    """``pieces`` with a column shard, and the number of shards: as many as tokens and pieces need."""
    total = pieces.agg(F.coalesce(F.sum(F.col("length") + PIECE_COST), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    return pieces.withColumn("shard", F.pmod("deal", F.lit(shards))), shards


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, a written table (it is read more than once) with a column ``deal`` of random numbers.

    Pieces are dealt by ``deal`` into as many shards as the total needs; so a shard holds about ``shard_tokens``, however many
    rows are alike. Sequences that a shard leaves at most half full give their pieces to a second packing, which deals them in
    the same way; its sequence_ids are negative.
    """
    known = pieces.columns
    columns = [c for c in known if c != "deal"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, fill long"

    def packed(rows: DataFrame, sign: int) -> DataFrame:
        dealt, shards = _dealt(rows, shard_tokens)

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "piece", "row_hash"], kind="stable", ignore_index=True)
            where, offset = pack_lengths(rows["length"].to_numpy(), capacity)
            fill = np.bincount(where, weights=rows["length"]).astype(np.int64)[where] if len(rows) else where
            number = where * shards + int(key[0])
            return rows[known].assign(sequence_id=number if sign > 0 else -1 - number, offset=offset, fill=fill)

        return dealt.groupBy("shard").applyInPandas(run, schema)

    first = space.cut(packed(pieces, 1), "packed", done=(pieces,))
    sparse = first.where(2 * F.col("fill") <= capacity)
    again = packed(sparse.select(known), -1)
    return first.where(2 * F.col("fill") > capacity).unionByName(again).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text; other columns are ignored): a row for each piece.

    The order within rows that share a doc_id is that of their texts' hashes. An empty table gives no rows.
    """
    pieces = tokenize_pieces(docs, path, capacity=capacity, with_ids=with_ids)
    return pack(space.cut(pieces.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "pieces"), capacity=capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(space.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("row_hash")
