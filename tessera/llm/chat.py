"""Chat formatting with a grammar round trip.

The template's grammar, in which `text` has no unescaped control string:

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

The deterministic parser reads this grammar and nothing else. A conversation is
first rendered as it is and parsed again; where the recovered turns differ from
the source, the roles or texts that conflict are escaped (a marker goes into
each control string, and into each string that already has such markers), until
the recovered turns are identical. Escaping is reversible, so what the loss
mask covers can be read back as it was written.

Turns are in order of turn, then role, then text, so ties and repeated rows have
one order. Null texts and roles are empty; rows with a null conv_id are a
conversation of their own. An empty table gives no rows. A conversation is one
row of output and is held whole by one task, as it has to be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"

_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

Turn = tuple[str, str]


def escape(text: str) -> str:
    """One backslash more after the bar of each control string, so that none is left as it is."""
    return _CONTROL.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end of the text) of each turn as written; None if the text isn't of the grammar."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None or START in m[1] or END in m[1] or START in m[2]:
            return None
        turns.append((m[1], m[2], m.start(2), m.end(2)))
        at = m.end()
    return turns


def _write(turns: list[Turn]) -> str:
    return "".join(f"{START}{role}\n{text}{END}\n" for role, text in turns)


def render(turns: list[Turn]) -> tuple[str, list[bool]]:
    """The rendered conversation, and for each turn whether it is escaped.

    A turn that comes back otherwise when it stands alone conflicts and is escaped, as is one that has an escape's
    look; then the whole is parsed again, and all turns are escaped if it should differ still.
    """
    marked = []
    for role, text in turns:
        alone = parse(_write([(role, text)]))
        same = alone is not None and [(unescape_turn(r, t)) for r, t, _, _ in alone] == [(role, text)]
        marked.append(not same)
    written = [(_escape_role(r), escape(t)) if m else (r, t) for (r, t), m in zip(turns, marked, strict=True)]
    out = _write(written)
    again = parse(out)
    if again is None or [unescape_turn(r, t) for r, t, _, _ in again] != turns:
        marked = [True] * len(turns)
        out = _write([(_escape_role(r), escape(t)) for r, t in turns])
        again = parse(out)
        if again is None or [unescape_turn(r, t) for r, t, _, _ in again] != turns:
            raise ValueError("a conversation doesn't survive its rendering")
    return out, marked


def unescape_turn(role: str, text: str) -> Turn:
    """The source of a turn as written. Nothing in it says whether it was escaped: an unescaped turn has nothing that unescaping changes."""
    return _unescape_role(role) if "\\" in role else role, unescape(text)


def read_back(rendered: str) -> list[tuple[str, str, bool]]:
    """(role, text, whether the loss mask covers the text) of each turn of a rendered conversation, unescaped."""
    turns = parse(rendered)
    if turns is None:
        raise ValueError("not of the grammar")
    return [(*(x := unescape_turn(r, t)), x[0] == LEARNT) for r, t, _, _ in turns]


def format(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, mask (spans [start, end) of formatted that the loss covers, as written), a row for each conversation."""
    rows = _spark.columns(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, masks = [], []
            for turns in batch.column("turns"):
                text, _ = render([(t["role"], t["text"]) for t in turns.as_py()])
                out.append(text)
                masks.append([{"start": s, "end": e} for r, _, s, e in parse(text) if _unescape_role(r) == LEARNT])
            mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, pa.string()), pa.array(masks, mask)], names=["conv_id", "formatted", "mask"])

    return whole.mapInArrow(_spark.freed(rendered), f"conv_id {whole.schema[0].dataType.simpleString()}, formatted string, mask array<struct<start:long,end:long>>")


def recover(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), learnt (the unescaped texts under the mask), parsed from `formatted` and cut out by `mask`."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, learnt = [], []
            for text, mask in zip(batch.column("formatted"), batch.column("mask"), strict=True):
                text = text.as_py()
                turns.append([{"role": r, "text": t} for r, t, _ in read_back(text)])
                learnt.append([unescape(text[m["start"] : m["end"]]) for m in mask.as_py()])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("formatted"), pa.array(turns, kind), pa.array(learnt, pa.list_(pa.string()))], names=["conv_id", "formatted", "turns", "learnt"])

    source = formatted.select("conv_id", "formatted", "mask")
    return source.mapInArrow(_spark.freed(parsed), f"conv_id {source.schema[0].dataType.simpleString()}, formatted string, turns array<struct<role:string,text:string>>, learnt array<string>")
