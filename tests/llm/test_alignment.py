"""Cross-tokenizer alignment, HyperMinHash and centroid clustering against libraries and brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import centroids, crosstoken, hyperminhash, jaccard, registry
from test_llm import brute_classes, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


def brute_alignment(rows, overlaps=False):
    """The columns of ``align`` from whole texts, by the libraries and by comparing all tokens that may touch."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in own} | {chr(0x100 + i): x for i, x in enumerate(sorted(set(range(256)) - set(own)))}
    found, counts = [], Counter()
    for d, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_raw = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            found.append((d, None))
            continue
        a_end, b_end = list(itertools.accumulate(map(len, a_raw))), list(itertools.accumulate(map(len, b_raw)))
        both = sorted(set(a_end) & set(b_end))
        groups = [",".join(str(i) for i, e in zip(a, a_end) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, b_end) if lo < e <= hi) for lo, hi in zip([0, *both[:-1]], both)]
        if overlaps:
            links = [(x, y) for x, e, w in zip(a, a_end, a_raw) for y, f, v in zip(b, b_end, b_raw) if e - len(w) < f and f - len(v) < e]
        else:
            links = [(a[a_end.index(e)], b[b_end.index(e)]) for e in both]
        counts.update(links)
        found.append((d, (len(a), len(b), groups, links)))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = Counter()
    for d, x in found:
        n_a, n_b, groups, links = x or (0, 0, [], [])
        text = ";".join(groups)
        out[d, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if x else ""] += 1
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "foo  "), (6, "a▁b"), (7, "x   y \n\nfoo  — bar é è 's <|endoftext|> <s> </s> ok"),
    (8, "日本語 テスト 　 かな"), (9, "\x00 a\x01b \t\n x"), (10, "a" * 500), (11, " " * 300), (12, "don't we'll I'm\n\n\n  ok 123 4567"),
    (None, "foo bar"), (7, "foo bar"), (7, "foo bar"), (13, "▁"), (14, "🙂 🙂🙂 a"), (15, "বাংলা লেখা এখানে । "), (16, "né  \n  x y"),
]


@pytest.mark.parametrize("overlaps", [False, True])
@pytest.mark.parametrize("most_pairs", [10**6, 0])
def test_alignment_of_odd_texts(spark, overlaps, most_pairs):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_a", F.lit("x")).withColumn("pair", F.lit(1)).repartition(3)
    got = crosstoken.align(df, A, B, overlaps=overlaps, most_pairs=most_pairs)
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment(ODD, overlaps)
    assert crosstoken.align(df.limit(0), A, B, most_pairs=most_pairs).count() == 0


def test_alignment_gives_its_groups(spark):
    (row,) = crosstoken.align(spark.createDataFrame([(1, "strawberries und Straßenbahn")], "doc_id long, text string"), A, B, with_groups=True).collect()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["groups"].count(";") + 1 == row["n_groups"]
    assert sum(len(g.split("|")[0].split(",")) for g in row["groups"].split(";")) == row["n_a"]


def test_alignment_forgets_units(spark, monkeypatch):
    monkeypatch.setattr(crosstoken, "MOST_KNOWN", 40)
    texts = [" ".join(f"w{i * 7 + k}é" for k in range(30)) + "\n" for i in range(9)]
    small = crosstoken.Aligner(A, B, False)
    for t in texts:
        row, at = small.units_of(pa.array([t]))
        assert len(small.known) <= 40 and b";".join(small.shown[k] for k in row.tolist()).decode().count(";") + 1 == small.sizes[row, 2].sum()


def test_op11_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in registry.QUERIES["op11_crosstoken"](spark, DATA).collect()) == brute_alignment(rows)


# HyperMinHash


def near_texts(families, copies, seed):
    r = random.Random(seed)
    out = []
    for family in range(families):
        base = prose(r.choice((6, 9, 15, 40, 120, 400)), seed * 100 + family, vocabulary=10**6).split()
        for _ in range(copies):
            copy = list(base)
            for k in r.sample(range(len(copy)), min(len(copy), r.choice((0, 0, 1, 1, 2, 4, 9)))):
                copy[k] = f"new{r.randrange(10**6)}"
            out.append(" ".join(copy + [f"end{r.randrange(10**6)}"] * r.randrange(2)))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_hyperminhash_equals_brute_force(spark, size, percent):
    texts = [None, "", " \n", "one", "One", "one two", "ONE  two", "a b c", *near_texts(25, 9, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("set", F.lit(2))
    got = {tuple(r)[:3] for r in hyperminhash.near_copies(df, size=size, percent=percent).collect()}
    assert got == brute_classes(list(enumerate(texts)), size=size, percent=percent)


def test_hyperminhash_over_several_blocks_and_long_bands(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(hyperminhash, "SHORT_LIST", 4)
    texts = near_texts(6, 60, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r)[:3] for r in hyperminhash.near_copies(df, size=3, percent=85).collect()}
    assert got == brute_classes(list(enumerate(texts)), percent=85)


def test_hyperminhash_of_repeated_and_missing_ids(spark):
    base = prose(50, 2)
    df = spark.createDataFrame([(4, base), (4, base), (None, base), (4, "other words of another text"), (2, base + " x"), (9, "")], "doc_id long, text string")
    got = Counter(tuple(r) for r in hyperminhash.near_copies(df, size=3, percent=85).collect())
    n = len({tuple(base.split()[i : i + 3]) for i in range(48)})
    assert got == Counter({(4, n, 2, False): 2, (None, n, None, None): 1, (4, 3, 4, True): 1, (2, n + 1, 2, True): 1, (9, 0, 9, True): 1})
    assert hyperminhash.near_copies(df.limit(0)).count() == 0


def test_registers_hold_zeros_and_mantissa():
    value = np.array([1 << 63, (1 << 63) | (1 << 53), 1 << 62, (1 << 64) - 1], dtype=np.uint64)
    assert hyperminhash.compressed(value).tolist() == [1 << 10, (1 << 10) + 1, 2 << 10, (1 << 10) + 1023]
    assert (hyperminhash.compressed(np.array([0, 1], dtype=np.uint64)) >> 10 == 63).all()
    r = np.random.default_rng(1)
    value = r.integers(0, 1 << 63, 1000, dtype=np.uint64) >> r.integers(0, 40, 1000).astype(np.uint64)
    got = hyperminhash.compressed(value)
    for v, x in zip(value.tolist(), got.tolist(), strict=True):
        lead = 64 - v.bit_length()
        assert x == ((lead + 1) << 10) | ((v << (lead + 1) & (1 << 64) - 1) >> 54)


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9])
def test_estimates_are_unbiased(share):
    r = np.random.default_rng(7)
    n, found = 2000, []
    for _ in range(60):
        both = int(n * share)
        h = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = h[:n], h[n - both :]
        met = hyperminhash._met(np.array([n]))
        found.append(hyperminhash.estimate(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None], hyperminhash.chance(met, met))[0][0])
    truth = both / (2 * n - both)
    assert abs(np.mean(found) - truth) < 4 * math.sqrt(truth * (1 - truth) / hyperminhash.REGISTERS / 60)


def test_chance_agreement_is_what_compression_makes(monkeypatch):
    monkeypatch.setattr(hyperminhash, "MANTISSA", 2)  # coarse registers, so that chance shows
    r = np.random.default_rng(9)
    n, agree = 3000, []
    for _ in range(200):
        a, b = (hyperminhash.registers(r.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
        agree.append(int((a == b).sum()))
    met = hyperminhash._met(np.array([n]))
    assert abs(np.mean(agree) / hyperminhash.chance(met, met)[0] - 1) < 0.15


# Centroids


def brute_lloyd(rows, clusters, rounds, size):
    """Plain Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    now = [v for _, v in start]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now))

    for _ in range(rounds):
        own = [[] for _ in now]
        for _, v in kept:
            own[assign(v)[1]].append(v)
        now = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(own, now)]
    found = [(i, *assign(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, now[k])).encode()).hexdigest()) for i, d, k in found)


@pytest.mark.parametrize("n", [0, 1, 9, 400])
def test_centroids_equal_plain_python(spark, n):
    r = random.Random(n)
    rows = [(i, [r.uniform(-2, 2) for _ in range(5)]) for i in range(n)]
    rows += [(7, None), (8, [1.0] * 4), (9, [1.0, None, 0.0, 0.0, 0.0]), (10, [math.nan] * 5), (11, [math.inf] * 5)]
    if n:
        rows += [(3, [0.5] * 5)] * 40 + [(None, [-0.25] * 5)] + [(5, [0.1 * k] * 5) for k in range(3)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, cluster int, n int").repartition(4)
    got = Counter(tuple(x) for x in centroids.clustered(df, size=5, clusters=6).collect())
    assert got == brute_lloyd(rows, 6, 3, 5)


def test_vectors_too_large_to_be_exact_take_no_part(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 2.0]), (3, [2.0**21 - 1, -(2.0**21) + 1])], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in centroids.clustered(df, size=2).collect()} == {2, 3}


def test_an_empty_centroid_stays(spark):
    seen = []
    df = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (2, [4.0])], "vec_id long, embedding array<double>")
    found, last = centroids.lloyd(df, size=1, clusters=3, watch=lambda c: seen.append(c.tolist()))
    assert len(seen) == 3 and sorted(x for [x] in last.tolist()) == [0, 0, 256]
    assert sorted(r["distance"] for r in found.collect()) == [0, 0, 0]
