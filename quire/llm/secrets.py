"""Operator 6: secrets in texts, by patterns and by token efficiency.

The patterns give the base spans (kinds assign, access and hex). The method adds spans of kind token: strings that a
byte-level vocabulary needs many tokens for. Words and identifiers of natural text and code are covered by long pieces;
random strings are not, so few characters per token expose them. Known digests (bare hexadecimal of the usual lengths,
UUIDs) and identifiers (words joined by marks, and numbers) are excluded before the test. A run of letters counts as a word
only if the vocabulary covers it well: random letters, in one case or both, don't pass for a name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import space
from .words import chunks, loaded, only

#: Base kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ with 20 characters or more: a shorter match hides no longer one
HEX = re.compile(r"[0-9a-f]{24,}")  # likewise for [0-9a-f]+
ASSIGN_LEAST = 6

#: Candidates of the token test: so many characters of a key's alphabet at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A candidate with fewer characters a token than this is reported.
MOST_CHARS_PER_TOKEN = 2.0
#: A run of letters of a name has so many characters a token at least, unless it is as short as an abbreviation.
WORD_CHARS_PER_TOKEN, ABBREVIATION = 2.5, 5
#: Hexadecimal digits in MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
# Parts between marks that a name is made of: a word in one case or with a capital first, or a number, or a word with a number after it.
_NAME_PART = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[A-Z][a-z]+)*[0-9]{0,4}|[0-9]+")
_MARKS = re.compile(r"[+/_=-]+")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Vocabulary:
    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def known_or_name(found: str, words: Vocabulary) -> bool:
    """Whether a candidate is a digest or an identifier, and so no secret."""
    if _ALL_HEX.fullmatch(found) and len(found) in DIGEST_LENGTHS or _UUID.fullmatch(found):
        return True
    if not all(_NAME_PART.fullmatch(x) for x in _MARKS.split(found) if x):
        return False
    return all(len(x) <= ABBREVIATION or len(x) >= WORD_CHARS_PER_TOKEN * words.tokens(x) for x in _LETTERS.findall(found))


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary at ``path``, built once in each process."""
    known = loaded("vocabularies")
    if path not in known:
        known[path] = Vocabulary(path, pattern)
    return known[path]


def secret_spans(text: str, words: Vocabulary) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all spans in ``text``, sorted; places are code points, ends exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        found = m.group()
        if len(found) < MOST_CHARS_PER_TOKEN * words.tokens(found) and not known_or_name(found, words):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_secrets(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Spans of secrets in every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns a row for each row: doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans. A null or empty text has no
    spans; base_sha256 is then that of the empty string. Rows that share a doc_id, or have none, are each judged alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vocabularies")
        words = vocabulary(path, pattern)
        for batch in batches:
            for part in chunks(batch):
                found = [secret_spans(t, words) for t in part.column("text").to_pylist()]
                base = [[x for x in f if x[1] < 3] for f in found]
                columns = {"doc_id": part.column("doc_id")}
                columns |= {f"n_{kind}": pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k, kind in enumerate(KINDS)}
                columns["base_sha256"] = pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string())
                columns["spans"] = pa.array([_joined(f) for f in found], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return space.documents(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def redacted_rows(docs: DataFrame, path: str, pattern: str, mark: str) -> DataFrame:
    """``docs`` with ``mark`` in place of every span in ``text``; null texts and all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vocabularies")
        words = vocabulary(path, pattern)
        for batch in batches:
            for part in chunks(batch):
                new = [t if t is None else redacted(t, secret_spans(t, words), mark) for t in part.column("text").to_pylist()]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """The text with ``mark`` in place of each run of overlapping spans."""
    out, end = [], 0
    for a, _, b in found:
        if a < end:
            end = max(end, b)
        else:
            out += [text[end:a], mark]
            end = b
    return "".join([*out, text[end:]])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return find_secrets(space.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
