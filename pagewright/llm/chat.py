"""Chat formatting with typed content parts, and reading formatted chats back."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<turn ", "\n</turn>\n"
PART = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = "formatted string, loss_start long, loss_end long, attachments array<struct<slot:int,kind:string,ref:string,tokens:long>>, attachment_tokens long"


def escaped(text: str) -> str:
    """No angle bracket is left, so no mark of the template is in it; unescaped() undoes it."""
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    pieces = text.split("\\\\")
    return "\\".join(p.replace("\\l", "<").replace("\\g", ">") for p in pieces)


class Visitor:
    """Flattens the parts of a turn: texts as they are, others as numbered placeholders."""

    PATCH, MERGE = 14, 2  # pixels of an image patch's side; patches merged along a side
    AUDIO_RATE, PAGE_TOKENS = 25, 256  # tokens a second; tokens a document page

    def __init__(self):
        self.out: list[str] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escaped(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = self.PATCH * self.MERGE
        self.attach(part, max(1, math.ceil((part.get("width") or 0) / side) * math.ceil((part.get("height") or 0) / side)))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, math.ceil((part.get("seconds") or 0) * self.AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(1, part.get("pages") or 0) * self.PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        self.attach(part | {"kind": "unknown"}, 1)

    def attach(self, part: dict, tokens: int) -> None:
        slot = len(self.attachments) + 1
        self.attachments.append((slot, part["kind"], part.get("ref"), tokens))
        self.out.append(f"<{part['kind']} {slot}>")


def format_turn(role: str, parts: list[dict], learn: bool) -> tuple:
    """(formatted, loss_start, loss_end, attachments, tokens); the loss mask is a span of code points in formatted."""
    visitor = Visitor()
    for p in parts:
        visitor.visit(p)
    head, body = f"{OPEN}{escaped(role)}>\n", "".join(visitor.out)
    span = (len(head), len(head) + len(body)) if learn else (None, None)
    return (head + body + CLOSE, *span, visitor.attachments, sum(a[3] for a in visitor.attachments))


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, body as formatted) of a formatted turn."""
    at = formatted.index(">\n")
    if not formatted.startswith(OPEN) or not formatted.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    return unescaped(formatted[len(OPEN) : at]), formatted[at + 2 : -len(CLOSE)]


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end, attachments, attachment_tokens) per row of turns.

    turns has conv_id, turn, role and text, or parts of type PART in place of text. A null role or text is
    an empty one; null ids and turns stay null. A conversation is its rows' formatted texts in order of
    turn (nulls first, then by formatted text), so a chat of any length needs one turn's memory. Repeated rows are
    formatted each; no rows give no rows; columns beyond those named go. No shuffle.
    """
    kinds = dict(turns.dtypes)
    typed = "parts" in kinds
    content = F.col("parts").cast(PART) if typed else F.col("text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for role, content in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                parts = (content or []) if typed else [{"kind": "text", "text": content}]
                out.append(format_turn(role, [p for p in parts if p], role in learn))
            made = list(zip(*out)) if out else [[]] * 5
            attachment = pa.list_(pa.struct([("slot", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            slots = [[dict(zip(("slot", "kind", "ref", "tokens"), a)) for a in row] for row in made[3]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(made[0], pa.string()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.int64()), pa.array(slots, attachment), pa.array(made[4], pa.int64())],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "attachment_tokens"],
            )

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {FORMATTED}")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from formatted turns alone.

    A conversation's rows meet in order in one task and pass through running digests, one turn at a time. Rows
    without conv_id are one conversation; a null turn comes first; repeated rows count each; no rows give no rows.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_start", "loss_end")

    def run(batches):
        import pyarrow as pa

        at, state, done = object(), None, []

        def end():
            if state:
                done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            cols = list(zip(*done)) if done else [[]] * 6
            done.clear()
            kinds = (b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for conv, text, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != at:
                    end()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{unescaped(body)}\n".encode())
                if start is not None:
                    lost = unescaped(text[start:stop])
                    state[2] += len(lost)
                    state[3].update(lost.encode())
                state[4] += len(text)
            if done:
                yield flush()
        end()
        if done:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_chats(format_chats(rows.union(more)))


OP8_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (
  SELECT *, '<turn ' || replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g') || '>' || chr(10)
            || replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g') || chr(10) || '</turn>' || chr(10) AS formatted
  FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
