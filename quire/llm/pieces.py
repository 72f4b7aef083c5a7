"""Operator 1: SentencePiece encoding and decoding, in vectorised merge rounds.

The symbols of all distinct units of a batch lie in one flat array. A unit is a run of spaces with the letters after it:
no piece of the model goes on past a space that follows a letter (checked when the model is loaded), so units are
independent. In each round, the rank of every neighbouring pair is looked up, the minimum in every unit is found by a
segmented reduction, and the leftmost pairs with that rank are merged in all units at once; the array is compacted, and
finished units leave it, until no pair remains. Symbols outside the vocabulary become byte pieces.

A round costs the length of what is unfinished, so rounds over one very long unit (a page of letters or of spaces without a
break) would take the square of its length. Units of more than LONG symbols are merged pair by pair from a heap instead.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import space
from .words import chunks, flat_bytes, loaded, only, spans

_BAR = "▁"
#: Units that a process remembers at most; beyond that it starts anew.
MOST_KNOWN = 200_000
#: Symbols of a unit from which on a heap of pairs takes the place of rounds.
LONG = 2000
_NONE = np.iinfo(np.int32).max


class PieceModel:
    """A BPE model with byte fallback, as tables for numpy."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.size = sp.bos_id(), sp.eos_id(), n
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        own = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any(_BAR in p.lstrip(_BAR) for p in own):
            raise ValueError("a piece goes past a space that follows a letter: units are not independent in this model")
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        # Characters that occur in pieces without being one get ids from n on: they merge, and fall back to bytes alone.
        extra = {c: n + k for k, c in enumerate(sorted({c for p in own for c in p} - own.keys()))}
        symbols = own | extra
        self.extra = np.array([ord(c) for c in extra], dtype=np.uint32)
        self.extra_bytes = np.frombuffer("".join(extra).encode(), dtype=np.uint8)
        self.extra_width = np.array([len(c.encode()) for c in extra], dtype=np.int64)
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        score = {i: sp.get_score(i) for i in own.values()}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: place[s] for i, s in score.items()}
        keys, ranks, made, unsafe = [], [], [], np.zeros(n + len(extra), dtype=bool)
        for p, i in own.items():
            for k in range(1, len(p)):
                if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank[i])
                    made.append(i)
                    # A merge into a or b may open a pair that comes before the pairs still to be merged.
                    for part in (a, b):
                        unsafe[part] |= part in rank and rank[i] <= rank[part]
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.ranks, self.made = (np.array(x)[order] for x in (np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32), np.array(made, dtype=np.int32)))
        self.unsafe = unsafe
        self.first = np.zeros(n + len(extra) + 1, dtype=np.int64)  # keys of left symbol a: first[a]:first[a + 1]
        np.cumsum(np.bincount(self.keys >> 32, minlength=n + len(extra)), out=self.first[1:])
        self.table = self._hashed()
        self.pairs: dict[int, tuple[int, int]] | None = None
        self.forget()
        shown = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(_BAR, " ").encode() for i, p in enumerate(pieces)]
        self.shown_at = np.zeros(n + 1, dtype=np.int64)
        np.cumsum([len(x) for x in shown], out=self.shown_at[1:])
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.is_control = np.array([sp.is_control(i) for i in range(n)])

    def forget(self) -> None:
        """Start with no known units."""
        self.known: dict[bytes, int] = {}
        self.known_ids, self.known_at = [np.zeros(0, dtype=np.uint32)], [np.zeros(1, dtype=np.int64)]

    def _hashed(self) -> tuple[np.ndarray, int]:
        """An open-addressing table from pair keys to their place, probed for whole arrays at once."""
        bits = max(4, (4 * len(self.keys)).bit_length())
        slots = np.full(1 << bits, -1, dtype=np.int32)
        todo, at = np.arange(len(self.keys)), self._slot(self.keys, bits)
        while len(todo):
            free = slots[at] < 0
            slots[at[free][::-1]] = todo[free][::-1]
            lost = slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << bits) - 1)
        return slots, bits

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table of pairs, or -1."""
        slots, bits = self.table
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys, bits)
        found = slots[at]
        todo = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
            found[todo] = slots[at[todo]]
            again = found[todo]
            todo = todo[(again >= 0) & (self.keys[again] != keys[todo])]
        return found

    def merged(self, symbols: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of n units (``unit`` rises) until no pair remains."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.bincount(unit, minlength=n)
        if (size > LONG).any():
            for k in np.flatnonzero(size > LONG).tolist():
                own = self.merged_one(symbols[np.searchsorted(unit, k) : np.searchsorted(unit, k + 1)])
                done.append((np.full(len(own), k, dtype=unit.dtype), own))
            short = size[unit] <= LONG
            symbols, unit = symbols[short], unit[short]
        pair = np.full(len(symbols), -1, dtype=np.int32)
        fresh = np.flatnonzero((unit[:-1] == unit[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)) if len(symbols) else np.zeros(0, dtype=np.int64)
        while len(symbols):
            pair[fresh] = self.find(symbols[fresh], symbols[fresh + 1])
            rank = np.where(pair >= 0, self.ranks[pair], _NONE)
            begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.r_[begin, len(unit)])
            if (over := least == _NONE).any():
                ended = np.repeat(over, size)
                done.append((unit[ended], symbols[ended]))
                live = ~ended
                symbols, unit, pair, rank = symbols[live], unit[live], pair[live], rank[live]
                size, least = size[~over], least[~over]
                if not len(symbols):
                    break
            best = rank == np.repeat(least, size)
            at = np.flatnonzero(best)
            # Of overlapping equal pairs every other one, from the left; where the result is unsafe only the leftmost in its unit.
            run = np.r_[True, (np.diff(at) > 1) | (unit[at[1:]] != unit[at[:-1]])]
            step = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            into = self.made[pair[at]]
            leftmost = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
            once = np.repeat(np.logical_or.reduceat(self.unsafe[into], np.flatnonzero(leftmost)), np.diff(np.r_[np.flatnonzero(leftmost), len(at)]))
            take = np.where(once, leftmost, step % 2 == 0)
            at, into = at[take], into[take]
            symbols[at] = into
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, unit, pair = symbols[keep], unit[keep], pair[keep]
            at = place[at]
            near = np.zeros(len(symbols), dtype=bool)
            near[at] = near[at[at > 0] - 1] = True
            pair[near] = -1
            touched = np.flatnonzero(near[:-1])
            fresh = touched[(unit[touched] == unit[touched + 1]) & (symbols[touched] >= 0) & (symbols[touched + 1] >= 0)]
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        units = np.concatenate([u for u, _ in done])
        order = np.argsort(units, kind="stable")
        return units[order], np.concatenate([s for _, s in done])[order]

    def merged_one(self, symbols: np.ndarray) -> np.ndarray:
        """Merge the symbols of one long unit: of all pairs that of the least rank, of equal ones the leftmost, until none remains."""
        n = len(symbols)
        fresh = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        found = np.full(n, -1, dtype=np.int64)
        found[fresh] = self.find(symbols[fresh], symbols[fresh + 1])
        at = np.flatnonzero(found >= 0)
        heap = ((self.ranks[found[at]].astype(np.int64) << 32) | at).tolist()
        heapq.heapify(heap)
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        pairs, now, ranks = self.pairs, symbols.tolist(), np.where(found >= 0, self.ranks[found], -1).tolist()
        made = np.where(found >= 0, self.made[found], -1).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            if ranks[i] != entry >> 32:
                continue  # the pair has gone since
            j = after[i]
            now[i], k = made[i], after[j]
            now[j], ranks[j], after[i] = None, -1, k
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0:
                    ranks[a] = -1
                    if b < n and now[a] >= 0 and now[b] >= 0 and (new := pairs.get(now[a] << 32 | now[b])):
                        ranks[a], made[a] = new
                        heapq.heappush(heap, new[0] << 32 | a)
        return np.array([x for x in now if x is not None], dtype=np.int64)

    def encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units (UTF-8), flat, and how many each has."""
        n = len(units)
        data, at = flat_bytes(units.cast(pa.large_binary()).view(pa.large_string()) if units.type != pa.large_string() else units)
        lead = (data & 0xC0) != 0x80
        begin = np.flatnonzero(lead)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        unit = np.searchsorted(at, begin, side="right") - 1
        symbols = self.chars[np.where(points == 0x20, 0x2581, points)]
        # Unknown characters carry their place as a negative number.
        symbols = np.where(symbols < 0, -1 - np.arange(len(points)), symbols).astype(np.int64)
        out_unit, out = self.merged(symbols, unit.astype(np.int64), n)
        if (odd := np.flatnonzero((out < 0) | (out >= self.size))).size:
            if (out >= self.size).any():  # merging has left some characters alone that pieces have, but that aren't one
                points, begin = np.r_[points, self.extra], np.r_[begin, len(data) + np.r_[0, np.cumsum(self.extra_width)]]
                data = np.r_[data, self.extra_bytes]
                place = np.where(out < 0, -1 - out, len(points) - len(self.extra) + out - self.size)[odd]
            else:
                begin, place = np.r_[begin, len(data)], -1 - out[odd]
            width = np.ones(len(out), dtype=np.int64)
            width[odd] = begin[place + 1] - begin[place]
            raw = self.byte_ids[data[spans(begin[place], width[odd])]]
            out_unit, is_raw = np.repeat(out_unit, width), np.zeros(len(out), dtype=bool)
            is_raw[odd] = True
            is_raw, out = np.repeat(is_raw, width), np.repeat(out, width)
            out[is_raw] = raw
        return out.astype(np.uint32), np.bincount(out_unit, minlength=n).astype(np.int64)

    def _looked_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, flat, and the n + 1 offsets. Units that earlier calls have met aren't encoded again."""
        if len(self.known) + len(units) > MOST_KNOWN:
            self.forget()
        names, known = units.to_pylist(), self.known
        fresh = [i for i, name in enumerate(names) if name not in known]
        if fresh:
            ids, count = self.encode_units(units.take(pa.array(fresh)))
            offset = self.known_at[-1][-1]
            self.known_ids.append(ids)
            self.known_at.append(offset + np.cumsum(count))
            known.update(zip([names[i] for i in fresh], range(len(known), len(known) + len(fresh)), strict=True))
            self.known_ids, self.known_at = [np.concatenate(self.known_ids)], [np.concatenate(self.known_at)]
        at, ids = self.known_at[0], self.known_ids[0]
        row = np.fromiter((known[name] for name in names), dtype=np.int64, count=len(names))
        lengths = at[row + 1] - at[row]
        return ids[spans(at[row], lengths)], np.r_[0, np.cumsum(lengths)]

    def encode(self, texts: pa.Array, add_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the n + 1 offsets of the texts in them. A text that isn't empty gets a space in front."""
        texts = texts.cast(pa.large_string()).fill_null("")
        filled = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string()), texts, pa.scalar("", pa.large_string()))
        data, at = flat_bytes(filled)
        if _BAR.encode() in data.tobytes():
            data, at = flat_bytes(pc.replace_substring(filled, _BAR, " "))
        n = len(texts)
        empty, bounds = at[1:] == at[:-1], np.zeros(len(data) + 1, dtype=bool)
        blank = data == 0x20
        bounds[0 if len(data) else slice(0)] = True
        bounds[1:-1] = blank[1:] & ~blank[:-1]
        bounds[at] = True
        start = np.flatnonzero(bounds[:-1])
        first = np.searchsorted(start, at)  # a text's units: first[i]:first[i + 1]
        if len(start):
            offsets = np.r_[start, len(data)].astype(np.int64)
            units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            ids, ids_at = self._looked_up(units.dictionary)
            code = units.indices.to_numpy()
            lengths = np.diff(ids_at)[code]
            flat = ids[spans(ids_at[code], lengths)]
            total = np.r_[0, np.cumsum(lengths)][first]
        else:
            flat, total = np.zeros(0, dtype=np.uint32), np.zeros(n + 1, dtype=np.int64)
        if not add_ids:
            return flat, total
        out = np.empty(len(flat) + 2 * n, dtype=np.uint32)
        offsets = total + 2 * np.arange(n + 1)
        body = np.ones(len(out), dtype=bool)
        body[offsets[:-1]] = body[offsets[1:] - 1] = False
        out[offsets[:-1]], out[offsets[1:] - 1] = self.bos, self.eos
        out[body] = flat
        return out, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts with ids[offsets[i]:offsets[i + 1]], flat, and their n + 1 offsets.

        Control ids vanish, one space at the front goes, and byte pieces that aren't UTF-8 become U+FFFD each.
        """
        n = len(offsets) - 1
        width = self.shown_at[1:] - self.shown_at[:-1]
        lengths = width[ids]
        data = self.shown[spans(self.shown_at[ids], lengths)]
        at = np.r_[0, np.cumsum(lengths)]
        text_at = at[offsets]
        drop = np.zeros(len(data) + 1, dtype=bool)
        head = np.flatnonzero(~self.is_control[ids])  # the first piece that shows something, in each text
        first = np.searchsorted(head, offsets[:-1])
        real = (first < len(head)) & (head[np.minimum(first, max(len(head) - 1, 0))] < offsets[1:]) if len(head) else np.zeros(n, dtype=bool)
        begin = at[head[first[real]]]
        # A byte piece for a space isn't the space that encoding puts in front.
        drop[begin[(data[np.minimum(begin, len(data) - 1)] == 0x20) & ~self.is_byte[ids[head[first[real]]]]]] = True
        keep = ~drop[:-1]
        kept = np.r_[0, np.cumsum(keep)]
        return self._repaired(data[keep], kept[text_at], ids, offsets, kept[at])

    def _repaired(self, data: np.ndarray, text_at: np.ndarray, ids: np.ndarray, offsets: np.ndarray, piece_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        try:
            raw.decode("utf-8")
            whole = not len(data) or bool(((data[np.minimum(text_at, len(data) - 1)] & 0xC0) != 0x80).all())
        except UnicodeDecodeError:
            whole = False
        if whole:
            return data, text_at
        out = []
        for i in range(len(offsets) - 1):
            part = bytearray()
            run = bytearray()
            for j in range(offsets[i], offsets[i + 1]):
                piece = raw[piece_at[j] : piece_at[j + 1]]
                if self.is_byte[ids[j]]:
                    run += piece
                    continue
                part += _valid(bytes(run)) + piece
                run.clear()
            out.append(bytes(part + _valid(bytes(run))))
        return np.frombuffer(b"".join(out), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int64)


def _valid(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[i : i + size].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if i + size <= len(raw):
                out += raw[i : i + size]
                i += size
                break
        else:
            out += "�".encode()
            i += 1
    return bytes(out)


def model(path: str) -> PieceModel:
    """The model at ``path``, built once in each process."""
    known = loaded("pieces")
    if path not in known:
        known[path] = PieceModel(path)
    return known[path]


def encode_documents(docs: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns for each row doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids and the decoded text if ``with_ids``.
    A null or empty text has the begin and end ids only. Rows with one doc_id, or a null one, each give a row; an empty
    table gives none. Memory is bounded by about 1 MB of text at a time, or one text if that is longer.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pieces")
        own = model(path)
        for batch in batches:
            for part in chunks(batch):
                ids, at = own.encode(part.column("text"))
                shown, shown_at = own.decode(ids, at)
                ids = np.ascontiguousarray(ids, dtype="<u4")
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array(np.diff(at)),
                    "ids_sha256": pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
                    "decoded_sha256": pa.array([hashlib.sha256(shown[a:b]).hexdigest() for a, b in zip(shown_at[:-1].tolist(), shown_at[1:].tolist(), strict=True)]),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int64()))
                    columns["decoded"] = pa.array([shown[a:b].tobytes().decode("utf-8") for a, b in zip(shown_at[:-1], shown_at[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return space.documents(docs).mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(space.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
