"""Chat records of any known layout to one marked-up text with a loss mask.

A record is a JSON object. Its layout is known by a fingerprint: the SHA-256 of its
sorted nested field paths with their kinds, e.g. ``messages[].role:text``. The
fingerprint selects a declarative mapping to canonical (role, text) turns; adding a
layout means adding an entry to :data:`LAYOUTS`, not code.

A turn is written ``### role``, newline, text, newline, ``</turn>``, newline. In
texts a backslash goes before each backslash and each control string, in roles also
before a newline, so reading back is exact. The loss mask is a list of code-point
spans that hold just the assistant texts.

Cases: null texts and roles are empty. Turns with equal numbers are ordered by role
and text; null numbers come first. Rows without a conv_id are each a conversation of
one turn, with a null id. Records that are no JSON object or have an unknown
fingerprint get the layout ``unknown`` and no turns. Empty tables give no rows. Other
input columns are ignored. A conversation has to fit into a row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE_CONTROL = re.compile(r"\\|\n|### |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEADER = re.compile(r"### ((?:\\.|[^\\\n])*)\n", re.S)

ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

#: name: required paths, optional paths, and how turns follow. "fields" lists (role, paths whose texts are joined
#: by an empty line); "each" names a list, and the paths of the role and the text within an element.
LAYOUTS: dict[str, dict[str, Any]] = {
    "messages": {"needs": ["messages[].role", "messages[].content"], "each": ("messages", "role", "content")},
    "conversations": {"needs": ["conversations[].from", "conversations[].value"], "may": ["system"], "fields": [("system", ["system"])], "each": ("conversations", "from", "value")},
    "authored": {"needs": ["turns[].author.role", "turns[].content.text"], "each": ("turns", "author.role", "content.text")},
    "instruction": {"needs": ["instruction", "output"], "may": ["input", "system"], "fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "prompt": {"needs": ["prompt", "completion"], "may": ["system"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "question": {"needs": ["question", "answer"], "may": ["context"], "fields": [("user", ["context", "question"]), ("assistant", ["answer"])]},
}


def field_paths(value: Any, at: str = "") -> set[str]:
    """Nested paths that hold a value; nulls and numbers count as text, an empty list has its own path alone."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {f"{at}:object"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {f"{at}[]:empty"}
    return {f"{at}:text"}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()


def _mappings() -> dict[str, str]:
    out = {}
    for name, layout in LAYOUTS.items():
        may = layout.get("may", [])
        for n in range(len(may) + 1):
            for extra in combinations(may, n):
                out[fingerprint({f"{p}:text" for p in (*layout["needs"], *extra)})] = name
                if "each" in layout:
                    out[fingerprint({f"{layout['each'][0]}[]:empty", *(f"{p}:text" for p in extra)})] = name
    return out


MAPPINGS = _mappings()


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


def _reach(value: Any, path: str) -> Any:
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def canonical_turns(record: str | None) -> tuple[str, list[tuple[str, str]]]:
    """The layout's name and the turns of a record."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        value = None
    name = MAPPINGS.get(fingerprint(field_paths(value))) if isinstance(value, dict) else None
    if name is None:
        return "unknown", []
    layout, turns = LAYOUTS[name], []
    for role, paths in layout.get("fields", []):
        if any(p in value for p in paths):
            turns.append((role, "\n\n".join(_text(value[p]) for p in paths if p in value)))
    if "each" in layout:
        items, role, text = layout["each"]
        for x in value[items]:
            r = _text(_reach(x, role))
            turns.append((ROLE_NAMES.get(r, r) if name != "messages" else r, _text(_reach(x, text))))
    return name, turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The marked-up text and the spans of assistant texts in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = OPEN + _ROLE_CONTROL.sub(r"\\\g<0>", role) + "\n"
        body = _CONTROL.sub(r"\\\g<0>", text)
        out += [head, body, f"\n{CLOSE}\n"]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE) + 2
    return "".join(out), spans


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a marked-up text."""
    turns, at, end = [], 0, f"\n{CLOSE}\n"
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        stop = formatted.find(end, head.end()) if head else -1
        if stop < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(head[1]), unescape(formatted[head.end() : stop])))
        at = stop + len(end)
    return turns


def format_records(records: DataFrame) -> DataFrame:
    """From (conv_id long, record string) to conv_id, layout, formatted, loss_spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv_id, record in zip(batch["conv_id"].astype("Int64"), batch["record"], strict=True):
                name, turns = canonical_turns(record)
                text, spans = render(turns)
                rows.append((conv_id, name, text, [{"start": a, "end": b} for a, b in spans]))
            out = pd.DataFrame(rows, columns=["conv_id", "layout", "formatted", "loss_spans"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return records.select("conv_id", "record").mapInPandas(run, "conv_id long, layout string, formatted string, loss_spans array<struct<start:long,end:long>>")


def records_from_turns(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) to a JSON record for each conversation.

    A system, user, assistant or user, assistant conversation becomes a prompt record,
    others by turns of messages, authored or, where no role is renamed by it, conversations records.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), own.alias("_own"), F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    g = t.groupBy("conv_id", "_own").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    roles = F.transform("ts", lambda x: x["role"])
    named = lambda *names: F.array(*map(F.lit, names))
    said = lambda k: F.col("ts")[k]["text"]
    record = (
        F.when(roles == named("user", "assistant"), F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("completion"))))
        .when(roles == named("system", "user", "assistant"), F.to_json(F.struct(said(0).alias("system"), said(1).alias("prompt"), said(2).alias("completion"))))
        .when((F.col("conv_id") % 3 == 1) & ~F.arrays_overlap(roles, named(*ROLE_NAMES)), F.to_json(F.struct(F.transform("ts", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .when((F.col("conv_id") % 3 == 2) & ~F.arrays_overlap(roles, named(*ROLE_NAMES)), F.to_json(F.struct(F.transform("ts", lambda x: F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(x["text"].alias("text")).alias("content"))).alias("turns"))))
        .otherwise(F.to_json(F.struct(F.transform("ts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return g.select("conv_id", record.alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted texts and their masks hold, by parsing them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = lambda s: s.encode("utf-8", "surrogatepass")
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(batch["conv_id"].astype("Int64"), batch["formatted"], batch["loss_spans"], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
                whole = hashlib.sha256(raw("".join(f"{r}\n{t}\n" for r, t in turns))).hexdigest()
                rows.append((conv_id, len(turns), whole, len(loss), hashlib.sha256(raw(loss)).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: DuckDB SQL for the digests of all conversations and conversation -7.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '### ', ''))) // 4
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS text_chars,
    length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, chr(10), '')))
    + (length(role) - length(replace(role, '### ', ''))) // 4 + (length(role) - length(replace(role, '</turn>', ''))) // 7 AS role_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + role_chars + 1 + text_chars + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
