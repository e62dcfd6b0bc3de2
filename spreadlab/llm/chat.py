r"""Chat formatting with a grammar round trip.

    conversation := "<s>" turn*
    turn         := "[SYS] " body " [/SYS]" | "[INST] " body " [/INST]" | " " body "</s>"
                  | "[ROLE " name-as-JSON "] " body " [/ROLE]"

for system, user, assistant and any other role. Every control string in a body, conflicting or not,
gets one more backslash after its first character, so that no raw one is ever inside a text; the
parser takes one away, so texts that already hold escaped control strings survive too, and an end
mark never starts inside a body. Each rendered turn is parsed again and must give the same role and
text: since both steps invert each other, one round of escaping is enough for any text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
_OTHER = ("[ROLE ", "] ", " [/ROLE]")
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|SYS\]|ROLE))")
SEGMENT_CHARS = 1 << 20

_SEGMENTS = "segment long, text string, loss array<struct<start:long,end:long>>"
_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(body: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", body)


def unescape(body: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", body)


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn from ``at`` on; ValueError if malformed."""
    while at < len(text):
        for role, (opens, closes) in MARKS.items():
            if text.startswith(opens, at):
                start = at + len(opens)
                break
        else:
            if not text.startswith(_OTHER[0], at):
                raise ValueError(f"no turn starts at {at}")
            role, start = json.JSONDecoder().raw_decode(text, at + len(_OTHER[0]))
            if not text.startswith(_OTHER[1], start):
                raise ValueError(f"no role ends at {start}")
            start, closes = start + len(_OTHER[1]), _OTHER[2]
        end = text.index(closes, start)
        yield role, unescape(text[start:end]), start, end
        at = end + len(closes)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its body starts and ends in it."""
    opens, closes = MARKS.get(role) or (_OTHER[0] + json.dumps(role) + _OTHER[1], _OTHER[2])
    body = escape(text)
    turn = opens + body + closes
    if [x[:2] for x in parse(turn)] != [(role, text)]:
        raise ValueError("a turn does not survive its own grammar")
    return turn, len(opens), len(opens) + len(body)


def _format(segment_chars: int, id_type: pa.DataType, id_name: str):
    kinds = [id_type, pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        conv, segment, parts, size, loss, begun = None, 0, [], 0, [], False
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or c != conv or size >= segment_chars:
                    if begun:
                        rows.append((conv, segment, "".join(parts), loss))
                    segment = segment + 1 if begun and c == conv else 0
                    conv, begun, loss = c, True, []
                    parts = [] if segment else [BEGIN]
                    size = sum(map(len, parts))
                turn, start, end = render(role or "", text or "")
                if role == "assistant":
                    loss.append({"start": size + start, "end": size + end})
                parts.append(turn)
                size += len(turn)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_name, "segment", "text", "loss"])
                rows = []
        if begun:
            rows.append((conv, segment, "".join(parts), loss))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_name, "segment", "text", "loss"])

    return run


def _read(id_type: pa.DataType, id_name: str):
    names = [id_name, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        now = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def done() -> None:
            rows.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"]))

        for batch in batches:
            for conv, segment, text, loss in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or segment == 0:
                    if now is not None:
                        done()
                    now = {"id": conv, "n": 0, "chars": 0, "all": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, body, _, _ in parse(text, 0 if segment else len(BEGIN)):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    now["chars"] += len(body)
                    now["loss"].update(body.encode())
                now["all"] += len(text)
            if rows:
                yield out()
                rows = []
        if now is not None:
            done()
            yield out()

    return run


def _id_field(df: DataFrame) -> tuple[str, pa.DataType, str]:
    from pyspark.sql.pandas.types import to_arrow_type

    field = df.schema[0]
    return field.name, to_arrow_type(field.dataType), f"`{field.name}` {field.dataType.simpleString()}"


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row (id, segment, text, loss) per segment of a conversation, each with whole turns; the
    conversation is the segments' texts joined. ``loss``: spans (code points) of assistant bodies.

    Turns are in order of turn, then role, then text; null turns first. Null texts and roles are
    empty; repeated rows are turns of their own; null ids are one conversation. A conversation of any length passes through as a stream: only a segment is in
    memory. An empty table gives an empty one; columns with other names don't matter."""
    rows = rows.select(F.col(id_col), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    name, kind, ddl = _id_field(rows)
    ordered = rows.repartition(F.col(name)).sortWithinPartitions(F.col(name), "turn", "role", "text")
    return ordered.select(F.col(name), "role", "text").mapInArrow(_format(segment_chars, kind, name), f"{ddl}, {_SEGMENTS}")


def read_conversations(segments: DataFrame) -> DataFrame:
    """Parses what :func:`format_conversations` returned, or the same rows read from a table that
    were brought into order by id and segment within partitions. One row per conversation: n_turns, digests of
    all turns and of the text under the loss mask, and sizes, in code points."""
    name, kind, ddl = _id_field(segments)
    return segments.select(F.col(name), "segment", "text", "loss").mapInArrow(_read(kind, name), f"{ddl}, {_READ}")
