"""Chat formatting from an event log.

A log row is one event of a message: ``open`` names the role, ``delta`` adds streamed text, ``edit``
replaces the text, ``regenerate`` begins it anew, ``delete`` takes the message out. The log is
partitioned by conversation and stretch of turns, sorted by sequence and folded row by row, so a
task holds one message and the part it writes, however long the conversation is. Parts are rendered
with control strings that texts cannot contain unescaped, and can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import text_of

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of this and other common templates; a text's own are escaped.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<|endofprompt|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
ANY = "|".join(map(re.escape, (ESCAPE, *CONTROLS)))
PLAIN = re.compile(ANY)
ESCAPED = re.compile(rf"\\({ANY})")
TOKEN = re.compile(rf"\\(?:{ANY})|{re.escape(START)}|{re.escape(SEP)}|{re.escape(END)}")
#: Turns of one part, characters of one delta.
PART_TURNS = 64
DELTA_CHARS = 4096
EVENTS = "conv_id, turn, message, seq, kind, role, text"


def escaped(text: str) -> str:
    return PLAIN.sub(lambda m: ESCAPE + m[0], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def rendered(role: str, text: str) -> str:
    return f"{START}{escaped(role)}{SEP}{escaped(text)}{END}\n"


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered part."""
    begin = body = 0
    role = ""
    for m in TOKEN.finditer(text):
        if m[0] == START:
            begin = m.end()
        elif m[0] == SEP:
            role, body = unescaped(text[begin:m.start()]), m.end()
        elif m[0] == END:
            yield role, unescaped(text[body:m.start()])


def turn_log(turns: DataFrame) -> DataFrame:
    """The log of finished turns (conv_id, turn, role, text): each is opened and streamed.

    Null roles and texts count as empty. Turns of one number stand in the order of role and text;
    repeated rows are messages of their own.
    """
    role, text = text_of("role"), text_of("text")
    message = F.concat_ws("|", role, F.hex(F.xxhash64(text)), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    named = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), message.alias("message"))  # before the rows multiply
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), 0),
                         lambda part, i: F.struct((i + 1).alias("seq"), F.lit("delta").alias("kind"), part.alias("text")))
    opened = F.struct(F.lit(0).alias("seq"), F.lit("open").alias("kind"), F.lit("").alias("text"))
    events = named.select("conv_id", "turn", "message", "role", F.explode(F.concat(F.array(opened), deltas)).alias("e"))
    return events.select("conv_id", "turn", "message", "e.seq", "e.kind", F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.text")


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows ``conv_id``, ``part``, ``n_turns``, ``formatted``, ``loss`` (array of start, end in code points).

    Events of a message are folded by ``seq``; messages stand by turn, then message key. A message
    that is never opened has an empty role. Unknown kinds are an error. Columns beyond the
    log's are not looked at. An empty log gives no rows. Parts in order make up the conversation.
    """
    log = events.selectExpr(*EVENTS.split(", ")).withColumn("part", F.floor(F.col("turn") / PART_TURNS).cast("long"))
    sorted_log = log.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "message", "seq")
    conv_type = events.schema["conv_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        place = message = None
        role, text, deleted = "", [], False
        out, spans, length, turns = [], [], 0, 0
        rows: list[tuple] = []

        def close_message() -> None:
            nonlocal length, turns
            if message is None or deleted:
                return
            body = escaped("".join(text))
            head = f"{START}{escaped(role)}{SEP}"
            if role in loss_roles:
                spans.append({"start": length + len(head), "end": length + len(head) + len(body)})
            out.append(head + body + END + "\n")
            length += len(out[-1])
            turns += 1

        def close_part() -> None:
            nonlocal out, spans, length, turns
            if place is not None:
                rows.append((*place, turns, "".join(out), spans))
            out, spans, length, turns = [], [], 0, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "part", "n_turns", "formatted", "loss"])

        for batch in batches:
            schema = batch.schema
            for conv, part, turn, key, kind, who, piece in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "message", "kind", "role", "text")]):
                if (turn, key) != message or (conv, part) != place:
                    close_message()
                    if (conv, part) != place:
                        close_part()
                        place = (conv, part)
                    message, role, text, deleted = (turn, key), "", [], False
                if kind == "open":
                    role = who or ""
                elif kind == "delta":
                    text.append(piece or "")
                elif kind == "edit":
                    text = [piece or ""]
                elif kind == "regenerate":
                    text, deleted = [], False
                elif kind == "delete":
                    deleted = True
                else:
                    raise ValueError(f"unknown event kind {kind!r}")
            if rows:
                yield batch_of(rows)
                rows = []
        close_message()
        close_part()
        if rows:
            yield batch_of(rows)

    return sorted_log.mapInArrow(fold, f"conv_id {conv_type}, part bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>")


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, parsed out of the formatted parts: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests are taken part by part; no conversation is held as a whole.
    """
    conv_type = parts.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_row, kind = None, False, None
        turns = loss = None
        n_turns = loss_chars = formatted_chars = 0
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            rows = []
            for conv, text, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")]):
                if conv != now or not any_row:
                    if any_row:
                        rows.append((now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted_chars))
                    now, any_row = conv, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = formatted_chars = 0
                for role, body in parsed(text):
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    n_turns += 1
                for span in spans:
                    part = unescaped(text[span["start"]:span["end"]])
                    loss_chars += len(part)
                    loss.update(part.encode("utf-8", "surrogatepass"))
                formatted_chars += len(text)
            if rows:
                yield batch_of(rows)
        if any_row:
            yield batch_of([(now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted_chars)])

    ordered = parts.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(digest, f"conv_id {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
