"""Operator 4: n-gram Jaccard join, by T-occurrence search with DivideSkip.

Each document is the set of the 64-bit hashes of its shingles of ``size`` words. Documents with equal sets are one node. To
link two sets, at least T = percent of the n shingles of either must be in both, so:

1. Routing. Of each set, the n - T + k least hashes; two linked sets share k of these. Counting them in Spark gives how
   common each is; the commonest k / 2 are passed over, and linked sets still share the other half of k. Hashes that only
   one set has link nothing. Texts that share no passage go out here, and common passages are the last to be looked at.
2. Sets that share enough of the kept hashes, or one that many have, form a family. A family is cut into blocks of bounded
   size, by rising size of the sets. A block meets only those blocks whose least set is not too large for a link with its
   own greatest; each such pair of blocks is a task of its own, so a family with a large share of all rows is spread over many.
   A family of more than LARGE_FAMILY sets is first divided: it is routed once more by its sets' rarest hashes in place of their
   least ones. Texts that a common passage alone brought together go out there, so no more pairs of blocks than links ask for.
3. Search. A task builds inverted lists over one block and searches them with each set of the other: short lists are
   merged, sets found often enough are looked up in the long lists by binary search (DivideSkip), and those that reach the
   required overlap are links. A pair that links already join isn't searched again: its class can't change. What leaves a
   task is a spanning forest of its links, at most one row a set.

Classes are the connected components of all forests. Nothing here depends on chance but for hashes: a link between two
different sets of shingles is missed or made up only if 64-bit hashes collide within a pair. Only texts of sets in a family
are read again; Spark filters the others before the shuffle with a Bloom filter of bounded size, which loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import space
from .graph import components
from .words import chunks, flat_bytes, mixed, only, rolling, spans, split_words

#: Words of a shingle; percent of the union that near copies have in common.
SHINGLE, PERCENT = 5, 80
#: The same of the query ``op4_jaccard``.
QUERY_SHINGLE, QUERY_PERCENT = 3, 90
#: Column that tells the rows of a table apart while this module works on it.
_KEY = "__quire_row"
#: Sets and hashes of a block at most, on average.
BLOCK_SETS, BLOCK_HASHES = 512, 1_000_000
#: Sets of a family from which on it is routed once more, by its rarest hashes.
LARGE_FAMILY = 2 * BLOCK_SETS
#: Cells in which the hashes of large families are counted; a power of two.
CELLS = 1 << 20
#: Tokens that linked sets share in the routing, at least, if they have as many; sets in a list that is counted by pairs.
LEAST_SAMPLE, SHORT_LIST = 6, 32


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words are lower-cased in A-Z."""
    words = split_words(*flat_bytes(texts), lower=True)
    h = words.hashes()
    rolled = rolling(h, size)
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:  # the whole sequence as one, apart from all shingles of the full size
            yield mixed(rolling(h[a:b], b - a) ^ np.uint64(0xD6E8FEB86659FD93 + b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def signature(own: np.ndarray) -> bytes:
    """128 bits by which sets are told apart."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _needed(n: int, percent: int) -> int:
    """Of n shingles, so many are in any linked set."""
    return -(-percent * n // 100)


def _sample(n: int) -> int:
    """k of the routing, for sets of n shingles; it doesn't fall as n rises."""
    return min(n, max(n // 20, LEAST_SAMPLE))


def _row_key() -> Column:
    """128 bits of doc_id and text. Rows that share them are equal in all that counts here."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))))


def routing_tokens(own: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a set, of which linked sets share some."""
    n = len(own)
    return own[: n - _needed(n, percent) + _sample(n)] if n else own


def _described(docs: DataFrame, size: int, percent: int, tokens_of: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """key, doc_id, n, sig, tokens for rows (doc_id, text, key): the set's size, its signature and what the routing takes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                counts, sigs, tokens = [], [], []
                for own in shingle_sets(part.column("text"), size):
                    n = len(own)
                    counts.append(n)
                    sigs.append(signature(own))
                    tokens.append(tokens_of(own, percent))
                ends = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)
                flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "doc_id": part.column("doc_id"), "n": pa.array(counts, pa.int64()), "sig": pa.array(sigs, pa.binary()), "tokens": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))})

    return docs.mapInArrow(run, "key binary, doc_id long, n long, sig binary, tokens array<long>")


def _families(sets: DataFrame, percent: int, ranked: bool = False) -> DataFrame:
    """set, family of the sets (set, n, tokens) that may have links. ``ranked``: tokens stand in one order of rarity already.

    Two linked sets share ``spare`` of their tokens. The commonest spare - asked of those that other sets have (if ranked: the
    last spare - asked) are passed over in each; linked sets still share ``asked``. Lists of few sets are counted by pairs; sets that share a token whose
    list is long go into one family at once, through its first set.
    """
    least = f"((n * {percent} + 99) div 100)"  # as _needed and _sample of the smallest set that can be linked
    if ranked:
        met = sets.select("set", "n", F.transform("tokens", lambda x: F.struct(x.alias("token"))).alias("t"))
    else:
        posts = sets.select("set", F.explode("tokens").alias("token"))
        common = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        met = posts.join(common, "token").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        met = met.join(sets.select("set", "n"), "set")
    met = met.withColumn("spare", F.expr(f"greatest(1, least({least}, greatest({least} div 20, {LEAST_SAMPLE})))")).withColumn("asked", F.expr("(spare + 1) div 2"))
    kept = met.withColumn("k", F.expr("size(t) - (spare - asked)")).where("k >= asked")
    lists = space.cut_large(kept.select("set", "n", "asked", F.explode(F.expr("slice(t, 1, cast(k as int))")).alias("x")).select("set", "n", "asked", F.col("x.token").alias("token")), "lists")
    sizes = space.cut_large(lists.groupBy("token").agg(F.min("set").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"), "list-sizes")
    short = lists.join(sizes.where(F.col("m") <= SHORT_LIST).select("token"), "token").groupBy("token").agg(F.collect_list(F.struct("set", "n", "asked")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: (a["set"] < b["set"]) & (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"]))), lambda b: F.struct(a["set"].alias("a"), b["set"].alias("b"), F.greatest(a["asked"], b["asked"]).alias("asked")))))
    counted = short.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("c"), F.max("p.asked").alias("asked")).where("c >= asked").select("a", "b")
    starred = lists.select("token", "set").join(sizes.where(F.col("m") > SHORT_LIST).select("token", "hub"), "token").select(F.col("hub").alias("a"), F.col("set").alias("b"))
    edges = space.cut_large(counted.unionByName(starred).distinct(), "family-links", done=(lists, sizes))
    return components(edges).select(F.col("node").alias("set"), F.col("label").alias("family"))


def rare_tokens(own: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Of a set's hashes the rarest, of which linked sets share some, rarest first; ``counts`` are those of the cells.

    A hash that is alone in its cell is in no other set. The T that linked sets share at least are among the others.
    """
    n, often = len(own), counts[own & np.uint64(len(counts) - 1)]
    own, often = own[often > 1], often[often > 1]
    return own[np.lexsort((own, often))][: max(0, len(own) - _needed(n, percent) + _sample(n))]


def _rarest(hashes: DataFrame, percent: int) -> DataFrame:
    """set, n, tokens: the ``rare_tokens`` of the sets ``hashes`` (set, n, tokens).

    A cell counts all hashes that fall into it, so the order is one of rarity up to chance, and the same for all sets. The
    table of counts has a fixed size, however many sets there are.
    """
    cells = hashes.select(F.explode("tokens").alias("x")).groupBy(F.col("x").bitwiseAND(CELLS - 1).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    found = cells.toArrow()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[found.column("cell").to_numpy()] = found.column("c").to_numpy()
    shared = hashes.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            column = batch.column("tokens")
            flat, ends = column.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
            tokens = [rare_tokens(flat[a:b], shared.value, percent).view(np.int64) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"set": batch.column("set"), "n": batch.column("n"), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    return hashes.mapInArrow(run, "set long, n long, tokens array<long>")


def _divided(own: DataFrame, members: DataFrame, size: int, percent: int, n_sets: int) -> DataFrame:
    """``members`` (set, family, n, sig, key), in which families of more than LARGE_FAMILY sets are divided; sets without links may go.

    Linked sets share k of their n - T + k first hashes in any order that all sets have in common. Here it is that of rarity
    among the sets of large families, whose texts (``own``: key, text) are read for it: with it a set that has little more than
    common passages with others meets none of them. Rarity is counted in CELLS cells of hashes; of a set only its first hashes
    are joined with those of others.
    """
    large = space.cut_large(members.groupBy("family").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LARGE_FAMILY).select("family"), "large-families", rows=n_sets)
    if large.isEmpty():
        return members
    again = space.cut_large(members.join(large, "family", "left_semi"), "large-members", rows=n_sets)
    with _filtered_joins(own.sparkSession):
        texts = own.select("key", "text").join(again.where("n > 0"), "key").dropDuplicates(["key"])
        hashes = space.cut_large(_hashes_of(texts.select("text", "sig", "set", "n"), size), "large-sets")
    families = _families(_rarest(hashes, percent), percent, ranked=True)
    columns = members.columns
    parted = members.join(large, "family", "left_anti").select(columns).unionByName(again.drop("family").join(families, "set").select(columns))
    return space.cut_large(parted, "members", done=(members, again, large, hashes, families), rows=n_sets)


def _placed(members: DataFrame, percent: int, n_sets: int) -> DataFrame:
    """family, block, first, last of the sets ``members`` (set, n, family, ...): where a set lies and the blocks that its own meets.

    Blocks take the sets of a family by rising size; a size with more sets than a block holds is dealt by hash. So the blocks
    that a block meets follow each other: from ``first``, the least whose greatest set isn't too small, to ``last``, the
    greatest whose least set isn't too large. Both are looked up in one window over the distinct sizes of a family, not over
    its sets; no pair of blocks is formed that sizes rule out.
    """
    order = Window.partitionBy("family").orderBy("n")
    sizes = members.groupBy("family", "n").agg(F.count(F.lit(1)).alias("c")).withColumn("w", F.greatest(F.col("c") / BLOCK_SETS, F.col("c") * F.col("n") / BLOCK_HASHES))
    sizes = sizes.withColumn("end", F.sum("w").over(order)).withColumn("low", F.floor(F.round(F.col("end") - F.col("w"), 9)).cast("int"))
    sizes = space.cut_large(sizes.withColumn("high", F.greatest("low", (F.ceil(F.round("end", 9)) - 1).cast("int"))).select("family", "n", "low", "high"), "sizes", rows=n_sets)
    # Sizes n are met from ceil(n * percent / 100) to floor(n * 100 / percent).
    least, most = F.expr(f"(n * {percent} + 99) div 100"), F.expr(f"(n * 100) div {percent}")
    down, up = Window.partitionBy("family").orderBy("n").rangeBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy("family").orderBy("n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    empty = F.lit(None).cast("int")
    asked = sizes.select("family", "n", "low", "high", empty.alias("from"), empty.alias("to"))
    asked = asked.unionByName(sizes.select("family", least.alias("n"), empty.alias("low"), empty.alias("high"), F.col("low").alias("from"), F.col("high").alias("to")))
    asked = asked.unionByName(sizes.select("family", most.alias("n"), empty.alias("low"), empty.alias("high"), (-1 - F.col("low")).alias("from"), F.col("high").alias("to")))
    found = asked.withColumn("below", F.min("low").over(down)).withColumn("above", F.max("high").over(up)).where("to IS NOT NULL")
    # A block has one row for each of its sizes: the widest reach of all of them counts.
    reach = found.select("family", F.explode(F.sequence(F.expr("if(from < 0, -1 - from, from)"), "to")).alias("block"), F.when(F.col("from") >= 0, F.col("below")).alias("first"), F.when(F.col("from") < 0, F.col("above")).alias("last"))
    reach = space.cut_large(reach.groupBy("family", "block").agg(F.min("first").alias("first"), F.max("last").alias("last")), "reach", rows=n_sets)
    dealt = members.join(sizes, ["family", "n"]).withColumn("block", F.col("low") + F.pmod(F.xxhash64("set"), F.col("high") - F.col("low") + 1).cast("int"))
    return space.cut_large(dealt.join(reach, ["family", "block"]).drop("low", "high"), "placed", done=(sizes, reach), rows=n_sets)


def block_pairs(items: DataFrame) -> DataFrame:
    """``items`` (family, block, first, last, set, items) once for each pair of blocks (i, j), i <= j, that its block is in."""
    later = F.transform(F.sequence("block", "last"), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    earlier = F.when(F.col("first") < F.col("block"), F.transform(F.sequence("first", F.col("block") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    return items.select("family", "block", "set", "items", F.explode(F.concat(later, earlier)).alias("p")).select("family", "p.i", "p.j", "block", "set", "items")


def _checked_sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sets of the texts, which must have the signatures that they had before."""
    own = list(shingle_sets(part.column("text"), size))
    if any(signature(s) != want for s, want in zip(own, part.column("sig").to_pylist(), strict=True)):
        raise ValueError("the table of documents has changed while it was read")
    return own


def _hashes_of(rows: DataFrame, size: int) -> DataFrame:
    """set, n, tokens (all hashes), for rows (text, sig, set, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                own = _checked_sets(part, size)
                ends = np.r_[0, np.cumsum([len(s) for s in own])].astype(np.int32)
                flat = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_pydict({"set": part.column("set"), "n": part.column("n"), "tokens": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))})

    return rows.mapInArrow(run, "set long, n long, tokens array<long>")


def _sets_of(rows: DataFrame, size: int) -> DataFrame:
    """family, block, first, last, set, items (bytes of the sorted hashes), for rows (text, sig, and the others)."""
    names = ("family", "block", "first", "last", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in chunks(batch):
                own = _checked_sets(part, size)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in names} | {"items": pa.array([s.tobytes() for s in own], pa.binary())})

    return rows.mapInArrow(run, "family long, block int, first int, last int, set long, items binary")


class Index:
    """Inverted lists over sets: for each hash, the sorted numbers of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.hashes, first = np.unique(flat[order], return_index=True)
        self.at = np.r_[first, len(flat)]
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)

    def search(self, own: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the sets, of those in the mask ``wanted``, that are linked with ``own``."""
        n, place = len(own), np.searchsorted(self.hashes, own)
        # A hash that the index lacks gets the place of the next larger one, which is no hit.
        inside = place < len(self.hashes)
        place = place[inside]
        place = place[self.hashes[place] == own[inside]]
        least = _needed(n, percent)
        if len(place) < least:
            return place[:0]
        length = self.at[place + 1] - self.at[place]
        place = place[np.argsort(length, kind="stable")]
        long_ = least - max(1, least // 8)  # lists that are probed; the overlap needs at least least - long_ of the others
        merged = place[: len(place) - long_]
        found, count = self._merge(merged, least - long_)
        # |a & b| >= p |a | b| for the sizes that are known now.
        need = -(-percent * (n + self.sizes[found]) // (100 + percent))
        live = wanted[found] & (np.minimum(n, self.sizes[found]) >= need)
        found, count, need = found[live], count[live], need[live]
        for left, k in zip(range(long_, 0, -1), place[len(place) - long_ :], strict=True):
            live = count + left >= need
            if not live.all():
                found, count, need = found[live], count[live], need[live]
            if not len(found):
                return found
            own_list = self.owner[self.at[k] : self.at[k + 1]]
            at = np.searchsorted(own_list, found)
            count = count + (own_list[np.minimum(at, len(own_list) - 1)] == found)
        return found[count >= need]

    def _merge(self, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that ``least`` of the lists or more have, and how many of them do.

        The lists are sorted runs, one after another; a stable sort merges runs (what a heap does entry by entry), and
        equal neighbours are counted.
        """
        merged = np.sort(self.owner[spans(self.at[lists], self.at[lists + 1] - self.at[lists])], kind="stable")
        first = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]]) if len(merged) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.r_[first, len(merged)])
        often = count >= least
        return merged[first[often]], count[often]


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` (None: within ``left``), as pairs (i, j).

    Sets are numbered left first. A pair that the forest joins already isn't searched.
    """
    index = Index(left if right is None else right)
    base = 0 if right is None else len(left)
    label = np.arange(len(left) + (0 if right is None else len(right)))
    out = []
    for i in np.argsort([len(s) for s in left], kind="stable").tolist():
        wanted = label[base : base + len(index.sizes)] != label[i]
        if not wanted.any() or not len(left[i]):
            continue
        for j in index.search(left[i], percent, wanted).tolist():
            if label[base + j] != label[i]:
                out.append((i, base + j))
                label[label == label[base + j]] = label[i]
    return out


@contextmanager
def _filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Let Spark filter the large side of a join with a Bloom filter of the other's keys, for the jobs that run inside.

    The filter has 2 MB at most; where more keys make it less selective, more rows are shuffled, and the result is the same.
    Spark makes none where it takes the small side for one to broadcast, though these joins sort both sides: then all rows of
    the large side, with their texts, would be shuffled. So nothing counts as small here.
    """
    names = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {names + k: v for k, v in {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1TB", "expectedNumItems": "2000000", "numBits": "16777216"}.items()}
    wanted["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@dataclass(frozen=True)
class Method:
    """How candidates are found: what the routing takes of a set, the families by it, and the links between two blocks of sets."""

    tokens: Callable[[np.ndarray, int], np.ndarray] = routing_tokens
    families: Callable[[DataFrame, int], DataFrame] = _families
    forest: Callable[[list[np.ndarray], list[np.ndarray] | None, int], list[tuple[int, int]]] = forest


def _classes(docs: DataFrame, size: int, percent: int, nulls: bool, method: Method = Method()) -> tuple[DataFrame, DataFrame]:
    """Rows (key, doc_id, n, sig) of ``docs``, and best = (lost, doc_id, key) of the class of each sig that takes part.

    ``best`` is the row of the class with the least doc_id; ``lost`` is true if it has none. ``nulls``: rows without a doc_id
    take part.
    """
    linked = method.forest
    own = space.documents(docs, _row_key().alias("key"))
    described = space.cut_large(_described(own, size, percent, method.tokens), "described")
    takes_part = F.col("n") > 0 if nulls else (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key")).alias("rep")
    sets = described.where(takes_part).groupBy("sig").agg(rep, F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = space.cut_large(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    n_sets = sets.count()
    families = method.families(sets.select("set", "n", "tokens"), percent)
    members = space.cut_large(families.join(sets.select("set", "n", "sig", F.col("rep.key").alias("key")), "set"), "members", done=(families,), rows=n_sets)
    members = _divided(own, members, size, percent, n_sets)
    placed = _placed(members, percent, n_sets)
    with _filtered_joins(docs.sparkSession):
        # Equal rows have equal keys and meet in the join: one of them is enough.
        texts = own.select("key", "text").join(placed.where("n > 0"), "key").dropDuplicates(["key"])
        paired = block_pairs(_sets_of(texts.select("text", "sig", "family", "block", "first", "last", "set"), size))

        def search(key: tuple, table: pa.Table) -> pa.Table:
            only()
            table = table.combine_chunks().sort_by("set")
            block, first = table.column("block").to_numpy(), key[1].as_py()
            sets = table.column("set").to_numpy()
            own = [np.frombuffer(x, dtype=np.uint64) for x in table.column("items").to_pylist()]
            if first == key[2].as_py():
                order, found = np.arange(len(own)), linked(own, None, percent)
            else:
                lo, hi = np.flatnonzero(block == first), np.flatnonzero(block != first)
                order, found = np.r_[lo, hi], linked([own[i] for i in lo.tolist()], [own[i] for i in hi.tolist()], percent)
            ends = np.array(found, dtype=np.int64).reshape(-1, 2)
            return pa.table({"a": pa.array(sets[order[ends[:, 0]]], pa.int64()), "b": pa.array(sets[order[ends[:, 1]]], pa.int64())})

        links = space.cut_large(paired.groupBy("family", "i", "j").applyInArrow(search, "a long, b long"), "links", done=(members, placed))
    labels = components(links).select(F.col("node").alias("set"), "label")
    joined = space.cut_large(sets.select("set", "sig", "rep").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set")), "labelled", done=(sets, links), rows=n_sets)
    smallest = space.cut_large(joined.groupBy("label").agg(F.min("rep").alias("best")), "smallest", rows=n_sets)
    return described.drop("tokens"), space.cut_large(joined.join(smallest, "label").select("sig", "best"), "classes", done=(joined, smallest), rows=n_sets)


def jaccard_classes(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, method: Method = Method()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links reach. A null or empty text, or one without words, has no shingles and
    its own doc_id. A row without a doc_id takes no part and has a null component_id. Rows with equal sets are linked,
    also those that share a doc_id.
    """
    described, classes = _classes(docs, size, percent, nulls=False, method=method)
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    found = classes.select("sig", F.col("best.doc_id").alias("component_id"))
    return described.join(found, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id, of those that of the text with the least hash.

    Rows are decided one by one, whatever doc_ids they share: of two texts under one doc_id that nothing links, both stay.
    A row without a doc_id counts as the last of its class. Of rows that are equal in doc_id and text, one stays, and which
    of their other columns' values that is isn't defined. Rows without words are linked with nothing: all of them stay.
    """
    described, classes = _classes(docs, size, percent, nulls=True)
    judged = described.where("n > 0").join(classes.select("sig", F.col("best.key").alias("best")), "sig")
    marks = judged.groupBy("key").agg(F.first(F.expr("key = best")).alias("stays"), F.count(F.lit(1)).alias("copies")).where("NOT stays OR copies > 1")
    marks = space.cut_large(marks.withColumnRenamed("key", _KEY), "marks", done=(described, classes), rows=described.count())
    rows = docs.withColumn(_KEY, _row_key())
    with _filtered_joins(docs.sparkSession):
        first = space.cut_large(rows.join(marks.where("stays AND copies > 1").select(_KEY), _KEY, "left_semi").dropDuplicates([_KEY]), "firsts")
    # By a sort on both sides at every size: what is marked grows with the documents.
    alone = rows.join(marks.select(_KEY).hint("merge"), _KEY, "left_anti")
    return alone.unionByName(first).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(space.table(spark, sf_dir, "documents"), size=QUERY_SHINGLE, percent=QUERY_PERCENT)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * m >= 90 * (x.n + y.n - m)),
c(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.reached) AS component_id
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
