"""Chat formatting: conversations through a compiled template, with loss masks, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .template import FILTERS, compile_template

#: Turns of other roles stand between [INST] and [/INST], their role on the first line; an assistant's turn ends with </s>.
TEMPLATE = (
    "<s>{% for m in messages %}{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[INST]{{ m.role | line | escape }}\n{{ m.text | escape }}[/INST]{% endif %}{% endfor %}"
)
#: Characters of a fragment, about; only longer conversations have more than one.
FRAGMENT = 1 << 20

_CONTROL = re.compile(r"<(~*)(/?s>)|\[(~*)(/?INST\])")
_ESCAPED = re.compile(r"<~(~*)(/?s>)|\[~(~*)(/?INST\])")


def escape(text: str) -> str:
    """text without control strings: each gets a tilde after its first character, one more than it has."""
    return _CONTROL.sub(lambda m: f"<~{m[1]}{m[2]}" if m[2] else f"[~{m[3]}{m[4]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}{m[2]}" if m[2] else f"[{m[3]}{m[4]}", text)


def _line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def _unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


CHAT_FILTERS = FILTERS | {"escape": escape, "line": _line}


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, fragment: int = FRAGMENT) -> DataFrame:
    """Fragments of formatted conversations, in order: conv_id, fragment, last, text, spans.

    turns has conv_id, turn, role and text; other columns are ignored. Rows go by turn, then role, then text; null turns come
    first, repeated rows follow each other. Null texts and roles are empty; rows with a null conv_id are a conversation of their own.
    spans (start, length, in code points of the fragment's text) is the loss mask. A conversation up to about
    fragment characters is one row. A task holds one fragment and two turns at a time, however long a conversation is. An
    empty table gives no rows.
    """
    compile_template(template, CHAT_FILTERS)  # errors come before any work
    kind = turns.schema["conv_id"].dataType.simpleString()
    id_kind = to_arrow_type(turns.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compile_template(template, CHAT_FILTERS), _turns(batches)
        held: list[tuple] = []
        size, ahead = 0, next(rows, None)

        def messages() -> Iterator[dict]:
            nonlocal ahead
            conv = ahead[0]
            while ahead is not None and ahead[0] == conv:
                yield {"role": ahead[2] or "", "text": ahead[3] or "", "turn": ahead[1]}
                ahead = next(rows, None)

        def batch() -> pa.RecordBatch:
            nonlocal held, size
            ids, number, last, texts, spans = zip(*held)
            held, size = [], 0
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), pa.array(number, pa.int64()), pa.array(last), pa.array(texts), pa.array([[{"start": a, "length": n} for a, n in s] for s in spans], span)], ["conv_id", "fragment", "last", "text", "spans"])

        while ahead is not None:
            conv, number, parts, spans, at = ahead[0], 0, [], [], 0
            for text, counted in render({"messages": messages()}):
                if counted and text:
                    if spans and sum(spans[-1]) == at:
                        spans[-1] = (spans[-1][0], spans[-1][1] + len(text))
                    else:
                        spans.append((at, len(text)))
                parts.append(text)
                at += len(text)
                if at >= fragment:
                    held.append((conv, number, False, "".join(parts), spans))
                    number, parts, spans, at = number + 1, [], [], 0
                    yield batch()
            held.append((conv, number, True, "".join(parts), spans))
            size += at
            if size >= fragment or len(held) >= 5000:
                yield batch()
        if held:
            yield batch()

    ordered = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, fragment long, last boolean, text string, spans array<struct<start: long, length: long>>")


def read_back(fragments: DataFrame, ordered: bool = False) -> DataFrame:
    """Digests of what conversations formatted with TEMPLATE hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ordered: fragments come by conversation and number in each partition, as format_conversations() makes them.
    turns_sha256 is over role, newline, text, newline of each turn; loss_sha256 over what the spans cover, unescaped.
    """
    kind = fragments.schema["conv_id"].dataType.simpleString()
    rows = fragments.select("conv_id", "fragment", "last", "text", "spans")
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "fragment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state: dict = {}
        for b in batches:
            out: list[tuple] = []
            for conv, number, last, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                if number == 0:
                    state.update(turns=hashlib.sha256(), loss=hashlib.sha256(), n=0, loss_chars=0, chars=0, rest="")
                state["chars"] += len(text)
                for span in spans:
                    counted = unescape(text[span["start"] : span["start"] + span["length"]])
                    state["loss"].update(counted.encode())
                    state["loss_chars"] += len(counted)
                whole = state["rest"] + (text.removeprefix("<s>") if number == 0 else text)
                at = 0
                while at < len(whole):
                    asked = whole.startswith("[INST]", at)
                    end = whole.find("[/INST]" if asked else "</s>", at)
                    if end < 0:
                        break
                    body = whole[at + 6 * asked : end]
                    role, _, said = body.partition("\n") if asked else ("assistant", "", body)
                    state["turns"].update(f"{_unline(unescape(role)) if asked else role}\n{unescape(said)}\n".encode())
                    state["n"] += 1
                    at = end + (7 if asked else 4)
                state["rest"] = whole[at:]
                if last:
                    out.append((conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))
            if out:
                kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
