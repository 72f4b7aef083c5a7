"""Readers for pasted script batches: JSON, delimited tables, labelled sections or a single script."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("title", "script", "description", "hashtags", "tags")
# Names of fields in JSON and tables; labels of lines; what people and assistants write around scripts.
ALIASES = {
    "title": ("title", "name", "headline", "heading"),
    "script": ("script", "text", "narration", "voiceover", "content", "body"),
    "description": ("description", "desc", "caption", "summary"),
    "hashtags": ("hashtags", "hashtag", "hash tags"),
    "tags": ("tags", "keywords", "tag"),
}
LABELS = {
    "title": ("title", "video title", "short title", "headline", "শিরোনাম", "টাইটেল"),
    "script": (
        "script", "full script", "voiceover", "voice over", "voice-over", "vo", "narration", "spoken text", "spoken script", "স্ক্রিপ্ট", "বর্ণনা",
        "hook", "intro", "opening", "body", "main content", "cta", "call to action", "outro", "ending", "closing", "conclusion",
    ),
    "description": ("description", "desc", "youtube description", "caption", "বিবরণ"),
    "hashtags": ("hashtags", "hash tags", "হ্যাশট্যাগ"),
    "tags": ("tags", "youtube tags", "seo tags", "keywords", "ট্যাগ"),
    "skip": (
        "visual", "visuals", "visual idea", "on-screen text", "on screen text", "text overlay", "b-roll", "broll", "scene", "shot", "camera", "music",
        "sfx", "sound effects", "thumbnail", "thumbnail text", "duration", "length", "runtime", "word count", "estimated time", "notes", "note", "angle",
        "format", "editing", "background",
    ),
}
PREAMBLE = re.compile(r"^\s*(?:sure|okay|ok|absolutely|certainly|of course|great|here (?:are|is)|here's|below (?:are|is))\b", re.IGNORECASE)
CHATTER = re.compile(r"^\s*(?:let me know if|i hope (?:this|these)|hope (?:this|these) help|feel free to|would you like me|do you want me|want me to|need more (?:scripts|ideas)|happy (?:creating|posting|filming)|if you(?:'d| would) like(?:,)? i|i can also|shall i)\b", re.IGNORECASE)
# End of the fixed values.
_FIELD_OF = {alias: field for field, names in ALIASES.items() for alias in names}
_LABEL_OF = {label: field for field, names in LABELS.items() for label in names} | {k: v for k, v in _FIELD_OF.items() if v != "script" or k in ("script", "text")}
_LABEL = re.compile(r"^\s*(?:[*_#>\s]*)([^\W\d_][^:：*()]{0,24}?)\s*(?:\([^)]{0,30}\))?(?:[*_]*)\s*[:：]\s*(?:[*_]*)\s*(.*)$")
_HEADING = re.compile(r"^\s*(?:#{1,4}\s+|\*\*)?(?:short|video|script|part)\s*#?\s*\d{1,3}\b[\s.:)\-–—*]*(.*?)\**\s*$", re.IGNORECASE)
#: Begins the line that holds a section's heading; a title in the section goes before it.
_HEAD = "\x00"
_RULE = re.compile(r"^\s*([-*_=])\1{2,}\s*$")


def _field(name: str) -> str | None:
    return _FIELD_OF.get(re.sub(r"[\s_\-]+", " ", name.strip().lower()))


def _listed(value: object) -> list[str]:
    parts = value if isinstance(value, list) else re.split(r"[,\n;]+|\s+(?=#)", str(value))
    return [x for x in (str(p).strip().lstrip("#").strip() for p in parts) if x]


def _item(found: dict[str, object]) -> dict[str, object] | None:
    script = str(found.get("script") or "").strip()
    if not script:
        return None
    title = re.sub(r"\s+", " ", str(found.get("title") or found.get("heading") or "")).strip().strip("\"'“”*# ")
    first = re.split(r"(?<=[.!?।])\s", script, maxsplit=1)[0]
    return {"title": title or " ".join(first.split()[:10]).rstrip(".!?"), "script": script, "description": str(found.get("description") or "").strip(), "hashtags": _listed(found.get("hashtags") or []), "tags": _listed(found.get("tags") or [])}


def _from_json(raw: str) -> list[dict] | None:
    begin = min((i for i in (raw.find("["), raw.find("{")) if i >= 0), default=-1)
    if begin < 0 or begin > 200:  # a short lead-in may stand before it
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(raw[begin:])
    except ValueError:
        return None
    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list) and v and isinstance(v[0], dict)), [value])
    rows = [{f: v for k, v in x.items() if (f := _field(str(k)))} for x in value if isinstance(x, dict)] if isinstance(value, list) else []
    return [i for x in rows if (i := _item(x))] or None


def _from_table(raw: str) -> list[dict] | None:
    text = raw.lstrip("﻿").strip()
    head = text.split("\n", 1)[0]
    sep = max("\t,;", key=head.count)
    if not head.count(sep):
        return None
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
    fields = [_field(c) for c in rows[0]]
    if "script" not in fields:
        return None
    found = [{f: v for f, v in zip(fields, row, strict=False) if f} for row in rows[1:]]
    return [i for x in found if (i := _item(x))]


def _sections(raw: str) -> Iterator[list[str]]:
    now: list[str] = []
    for line in raw.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if _RULE.match(line) or _HEADING.match(line):
            if any(x.strip() for x in now):
                yield now
            m = _HEADING.match(line)
            now = [_HEAD + m[1]] if m and m[1] else []
        else:
            now.append(line)
    if any(x.strip() for x in now):
        yield now


def _label(line: str) -> tuple[str, str] | None:
    """The field that a line's label names, and what follows the label."""
    m = _LABEL.match(line)
    field = _LABEL_OF.get(re.sub(r"[\s_]+", " ", m[1].strip().lower())) if m else None
    return (field, m[2]) if field else None


def _labelled(lines: list[str]) -> dict[str, object]:
    found: dict[str, list[str]] = {}
    field = "script"
    for line in lines:
        if line.startswith(_HEAD):
            found["heading"] = [line[1:]]
            continue
        own = _label(line)
        if own:
            field = own[0]
            found.setdefault(field, []).append(own[1])
        else:
            found.setdefault(field, []).append(line)
            if field in ("title", "skip") and line.strip() == "":
                field = "script"  # a blank line ends them
    return {k: "\n".join(v).strip() for k, v in found.items()}


def _without_chatter(sections: list[list[str]], headed: bool) -> list[list[str]]:
    """Sections without what is said before the first script and after the last."""
    if len(sections) > 1 and not any(_label(x) for x in sections[0]):
        lines = [x for x in sections[0] if x.strip()]
        brief = len(" ".join(lines).split()) <= 60
        if headed or (brief and (PREAMBLE.match(lines[0]) or lines[-1].rstrip().endswith(":"))):
            sections = sections[1:]
    last = list(sections[-1]) if sections else []
    while last:
        while last and not last[-1].strip():
            last.pop()
        begin = len(last)
        while begin and last[begin - 1].strip():
            begin -= 1
        if not (0 < begin < len(last) and CHATTER.match(last[begin])):
            break
        del last[begin:]
    return [*sections[:-1], last] if last else sections


def parse_batch(raw: str) -> tuple[str, list[dict]]:
    """The format (json, table, sections, single, or empty) of a pasted text, and its items."""
    if not raw.strip():
        return "empty", []
    if items := _from_json(raw):
        return "json", items
    if items := _from_table(raw):
        return "table", items
    headed = any(_HEADING.match(x) for x in raw.splitlines()) and not _HEADING.match(next(x for x in raw.splitlines() if x.strip()))
    items = [i for s in _without_chatter(list(_sections(raw)), headed) if (i := _item(_labelled(s)))]
    return ("sections" if len(items) > 1 else "single"), items


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
#: An object, not a string: workers import this module without a session that could parse one.
BATCH = T.StructType([T.StructField("format", _TEXT), T.StructField("items", T.ArrayType(T.StructType([T.StructField(c, _TEXTS if c in ("hashtags", "tags") else _TEXT) for c in FIELDS])))])


@F.pandas_udf(BATCH)
def read_script_batch(raw: pd.Series) -> pd.DataFrame:
    parsed = [parse_batch(t or "") for t in raw]
    return pd.DataFrame({"format": [f for f, _ in parsed], "items": [i for _, i in parsed]})
