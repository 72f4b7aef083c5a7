"""The queries themselves, over the whole of the smallest tables: against SQL, libraries or brute force."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import licenses, pseudonyms, quality, registry, secrets

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows_of(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want)


def test_op1_equals_the_library(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in rows_of(spark, "op1_sentencepiece")}
    assert got.keys() == texts.keys()
    for k, r in got.items():
        ids = library.encode(texts[k] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op3_finds_most_neighbours(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    asked = np.flatnonzero(ids % 20 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    got = {}
    for r in rows_of(spark, "op3_neighbours"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == set(ids[asked].tolist())
    at, found = {v: i for i, v in enumerate(ids.tolist())}, 0
    for k, q in enumerate(asked.tolist()):
        own = sorted(got[int(ids[q])])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(s == pytest.approx((x[q] * x[at[v]]).sum(), abs=1e-12) for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        found += len({v for _, v, _ in own} & set(ids[np.lexsort((ids, -near[k]))[:20]].tolist()))
    assert found >= 0.9 * 20 * len(asked)


def distance(p, q):
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return np.sqrt(max(0.0, sum((a * np.log2(a / b)) for a, b in zip(np.r_[p, q], np.r_[m, m], strict=True) if a > 0) / 2))


def test_op5_verdicts_equal_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>" else 7 if ord(c) > 127 else 6
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    classes = {r["doc_id"]: np.bincount([kind(c) for c in r["text"]], minlength=8).astype(float) if r["text"] else np.zeros(8) for r in rows}
    words = {r["doc_id"]: Counter(WORD.findall(lower(r["text"] or ""))) for r in rows}
    refs = {}
    for lang in {r["lang"] for r in rows if r["lang"]}:
        own = [r["doc_id"] for r in rows if r["lang"] == lang and r["text"]]
        total = sum((words[k] for k in own), Counter())
        top = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]]
        refs[lang] = (sum(classes[k] for k in own), top, np.array([*[total[w] for w in top], sum(total.values()) - sum(total[w] for w in top)], dtype=float))
    share = {lang: sum(r["lang"] == lang and bool(r["text"]) for r in rows) / sum(bool(r["text"] and r["lang"]) for r in rows) for lang in refs}

    def far(k, n, lang):
        _, top, counts = refs[lang]
        return distance(classes[k], refs[lang][0]), distance(np.array([*[words[k][w] for w in top], n - sum(words[k][w] for w in top)], dtype=float), counts) / distance(np.r_[np.zeros(len(top)), 1.0], counts)

    got = {r["doc_id"]: r for r in rows_of(spark, "op5_quality")}
    for r in rows:
        k, w = r["doc_id"], WORD.findall(r["text"] or "")
        n, seen = len(w), Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {j for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = n < 50 or 100 * len(repeated) > 50 * n
        assert got[k]["base_failed"] == failed
        if not failed:
            own = sum(x["lang"] == r["lang"] and bool(x["text"]) for x in rows)
            of_classes, of_words = (x * own / (own + quality.HALF_DOCUMENTS) for x in far(k, n, r["lang"])) if r["lang"] in refs else (1, 1)
            if of_classes > quality.MOST_CHARACTERS or of_words > quality.MOST_WORDS_STRICT:
                for lang in refs.keys() - {r["lang"]}:
                    a, b = (1 - share[lang] / (share[lang] + quality.HALF_SHARE) * (1 - x) for x in far(k, n, lang))
                    of_classes, of_words = min(of_classes, a), min(of_words, b)
            odd = classes[k].sum() >= quality.GUARD_CHARACTERS and of_classes > quality.MOST_CHARACTERS
            odd = odd or (n >= quality.GUARD and of_words > (quality.MOST_WORDS_STRICT if n >= quality.GUARD_STRICT else quality.MOST_WORDS))
            assert got[k]["kept"] == (not odd)
        else:
            assert not got[k]["kept"]
    assert 0 < sum(r["kept"] for r in got.values()) < len(rows)


def test_op6_equals_brute_force(spark, texts):
    words = secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in rows_of(spark, "op6_secrets"):
        text, spans = texts[r["doc_id"]] or "", []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
            spans += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in spans) for k in range(3)]
        # Token spans: every run of key characters, long enough, of few characters a token, and neither digest nor name.
        tokens = set()
        for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
            if len(m[0]) >= 20 and len(m[0]) / len(words.encoding.encode_ordinary(m[0])) < 2 and not secrets.known_or_name(m[0], words):
                tokens.add(f"token:{m.start()}:{m.end()}")
        assert {x for x in r["spans"].split(",") if x.startswith("token")} == tokens and [x for x in r["spans"].split(",") if x and not x.startswith("token")] == [x for x in base.split(",") if x]


def test_op7_packs_all_tokens(spark, texts):
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in rows_of(spark, "op7_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
    bins, total = {}, 0
    assert pieces.keys() == texts.keys()
    for k, own in pieces.items():
        ids = np.array([*library.encode(texts[k] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(i, a, min(4096, len(ids) - a)) for i, a in enumerate(range(0, len(ids), 4096))]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
        total += len(ids)
        for r in own:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == np.r_[0, np.cumsum([n for _, n in own])[:-1]].tolist() and sum(n for _, n in own) <= 4096
    assert len(bins) <= -(-total // 4096) + 1


def test_op8_reports_what_the_texts_hold(spark, texts):
    """Exact notices, as words, are all found, and what is reported holds so much of its template in order."""
    bare = lambda s: [w for w in (re.sub(r"[^a-z0-9\x80-\U0010ffff]+", "", x) for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s))) if w]
    templates = {k: bare(v) for k, v in licenses.TEMPLATES.items()}
    for r in rows_of(spark, "op8_licenses"):
        text = texts[r["doc_id"]] or ""
        joined = " " + " ".join(bare(text)) + " "
        exact = Counter()
        for k, w in templates.items():
            exact[k] = joined.count(" " + " ".join(w) + " ")
        names = Counter(x["license"] for x in r["found"])
        longer = [k for k in names if any(set(templates[x]) < set(templates[k]) for x in exact if exact[x])]
        assert longer or all(names[k] >= n for k, n in exact.items())
        for x in r["found"]:
            part, want = bare(text[x["start"] : x["end"]]), templates[x["license"]]
            row = [0] * (len(part) + 1)
            for t in want:
                new = [0]
                for j, w in enumerate(part):
                    new.append(row[j] + 1 if t == w else max(row[j + 1], new[-1]))
                row = new
            assert row[-1] >= round(x["coverage"] * len(want)) >= 0.75 * len(want)


def test_op10_counts_spans_and_texts_agree(spark, texts):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}", "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "card": r"[0-9](?:[ -]?[0-9]){12,18}"}
    new_of, seen = {}, Counter()
    for r in rows_of(spark, "op10_pseudonyms"):
        text = texts[r["doc_id"]] or ""
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert Counter(k for k, _, _ in spans) == {k: r[f"n_{k}"] for k in pseudonyms.KINDS if r[f"n_{k}"]}
        at, shift = 0, 0
        for k, a, b in spans:
            old = text[a:b]
            assert re.fullmatch(kinds[k], old) and a >= at
            assert r["text"][at + shift : a + shift] == text[at:a]
            new = r["text"][a + shift : b + shift]
            if k == "ip":  # the only kind whose length may change
                new = re.match(kinds["ip"], r["text"][a + shift :])[0]
            assert re.fullmatch(kinds[k], new)
            assert new_of.setdefault((k, old.lower()), new.lower()) == new.lower()
            shift += len(new) - len(old)
            at = b
            seen[k] += 1
        assert r["text"][at + shift :] == text[at:]
    assert len(set(new_of.values())) == len(new_of) and seen


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline_equals_brute_force(spark, tmp_path):
    """corpus_pipeline.run on documents with repeated and missing ids: each stage against plain Python on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.where("doc_id % 10 = 0").withColumn("doc_id", F.when(F.col("doc_id") % 20 == 0, F.col("doc_id") + 1))  # taken ids, and none
    whole = docs.unionByName(odd).unionByName(docs.where("doc_id % 30 = 0"))
    for c in ("h", "found", "sig", "family", "row_hash", "key", "rest"):
        whole = whole.withColumn(c, F.lit(c))
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after = now.collect()
        if k < 4:
            assert now.columns == whole.columns and all(r["h"] == "h" and r["sig"] == "sig" for r in after)
        if name == "n-gram Jaccard join":
            rows = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in before})
            sets = [shingles(x[2]) for x in rows]
            where = {}
            for i, s in enumerate(sets):
                for x in s:
                    where.setdefault(x, set()).add(i)
            label = list(range(len(rows)))
            for i, s in enumerate(sets):
                for j, both in Counter(j for x in s for j in where[x] if j < i).items():
                    if 10 * both >= 8 * (len(s) + len(sets[j]) - both) and label[i] != label[j]:
                        lo, hi = sorted((label[i], label[j]))
                        label = [lo if x == hi else x for x in label]
            kept, want = Counter((r["doc_id"], r["text"]) for r in after), set()
            ids = {}
            for i, x in enumerate(label):
                ids.setdefault(x, []).append(rows[i][:2])
            assert sum(kept.values()) == len(ids)
            assert Counter((None if min(v)[0] else min(v)[1]) for v in ids.values()) == Counter(d for d, _ in kept.elements())
            assert not want
        elif name == "substring dedup":
            first = {}
            for r in before:
                w = WORD.findall(r["text"])
                for i in range(len(w) - 49):
                    if r["doc_id"] is not None:
                        first[tuple(w[i : i + 50])] = min(r["doc_id"], first.get(tuple(w[i : i + 50]), r["doc_id"]))
            want = Counter()
            for r in before:
                w, gone = WORD.findall(r["text"]), set()
                for i in range(len(w) - 49):
                    if r["doc_id"] is not None and first[tuple(w[i : i + 50])] < r["doc_id"]:
                        gone |= set(range(i, i + 50))
                if len(gone) < len(w):
                    want[(r["doc_id"], " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
            assert Counter((r["doc_id"], " ".join(WORD.findall(r["text"]))) for r in after) == want
        elif name == "secret scans":
            assert len(after) == len(before) and not any(regex.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r["text"]) for r in after)
        elif name == "best-fit packing":
            assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(r["doc_id"] for r in after)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_nulls_and_empty_tables(spark, k, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, found int, sig string"
    rows = [(None, None, None, None, None, "h", 1, "s"), (1, "", None, "s", 0, None, None, None), (1, " \n", "en", "s", 2, "h", 1, "s"), (2, "one two", "en", None, 7, "h", 1, "s")]
    stage = corpus_pipeline.STAGES[k][1]
    for data in (rows, []):
        df = spark.createDataFrame(data, schema)
        got = stage(spark, df, str(tmp_path))
        assert got.count() <= max(4, len(data)) and (k == 4 or got.columns == df.columns)
