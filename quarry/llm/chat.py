"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole, each turn as ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>``
and a newline, and encoded once with offsets.  The three control strings are added to the
tokenizer, so a turn's text always begins and ends on a token border.  The sorted spans of
the assistants' texts are intersected with the sorted token spans by binary search.

Inside roles and texts ``<``, any number of backslashes and ``|`` gets one backslash more,
so that no control string can occur there; ``unescape`` takes it away again.

Turns come sorted from Spark and stream through a task, so no conversation is held whole: one
of more than ``PART_CHARS`` characters becomes several rows, cut between turns, where a control
string separates the tokens in any case.

Edge cases: a null text or role is empty; turns are ordered by turn (null first), then
role and text; rows with a null conv_id are one conversation; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import vocabulary_path
from .workers import lean

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
FORMATTED = "conv_id long, part int, at long, formatted string, input_ids array<int>, starts array<int>, ends array<int>, mask array<byte>"
#: Characters after which a row ends with its turn, and that are encoded together.
PART_CHARS, TOGETHER = 1 << 20, 1 << 20


def escape(text: str | None) -> str:
    return _ESCAPE.sub(r"<\\\1|", text or "")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and the spans of the texts to be learnt."""
    out, at, begins, ends = [], 0, [], []
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        if role == TRAINED_ROLE:
            begins.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), begins, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        sep = formatted.index(SEP, at)
        end = formatted.index(END, sep)
        turns.append((unescape(formatted[at + len(START): sep]), unescape(formatted[sep + len(SEP): end])))
        at = end + len(END) + 1
    return turns


def token_mask(begins: list[int], ends: list[int], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """1 for each token inside a span: both are sorted, so two binary searches a span do."""
    mask = np.zeros(len(starts), np.int8)
    first = np.searchsorted(starts, np.asarray(begins, np.int64), "left")
    last = np.searchsorted(stops, np.asarray(ends, np.int64), "right")
    for a, b, x, y in zip(first, last, begins, ends):
        if x < y:  # an empty text has no tokens
            mask[a:b] = 1
    return mask


class Formatter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_tokens([AddedToken(x, normalized=False, special=False) for x in (START, SEP, END)])
        self.tokenizer.encode_special_tokens = True

    def __call__(self, conversations: list[list[tuple[str | None, str | None]]]) -> list[dict]:
        rendered = [render(x) for x in conversations]
        found = self.tokenizer.encode_batch([x[0] for x in rendered], add_special_tokens=False)
        out = []
        for (text, begins, ends), x in zip(rendered, found):
            spans = np.array(x.offsets, np.int32).reshape(-1, 2)
            out.append({"formatted": text, "input_ids": x.ids, "starts": spans[:, 0], "ends": spans[:, 1], "mask": token_mask(begins, ends, spans[:, 0], spans[:, 1])})
        return out


_formatters: dict[str, Formatter] = {}


def formatter(path: str) -> Formatter:
    """The formatter of this worker process, kept from task to task."""
    if path not in _formatters:
        _formatters[path] = Formatter(path)
    return _formatters[path]


def format_conversations(conversations: DataFrame, vocabulary: str | None = None, most_chars: int = PART_CHARS) -> DataFrame:
    """The text, token ids, token offsets and loss mask of every conversation: a row each, or
    for a long one several in order of ``part``, ``at`` being the characters of those before;
    offsets count from the row's own start.  A conversation's rows lie together and in order."""
    vocabulary = vocabulary or vocabulary_path()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int | None, int, int, list]] = []
        turns: list[tuple[str | None, str | None]] = []
        now: tuple[int | None] | None = None
        part = at = size = waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if done:
                found = formatter(vocabulary)([x[3] for x in done])
                columns = {"conv_id": pa.array([x[0] for x in done], pa.int64()), "part": pa.array([x[1] for x in done], pa.int32()), "at": pa.array([x[2] for x in done], pa.int64())}
                columns["formatted"] = pa.array([x["formatted"] for x in found], pa.string())
                columns |= {k: pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in ("input_ids", "starts", "ends")}
                columns["mask"] = pa.array([x["mask"] for x in found], pa.list_(pa.int8()))
                yield pa.record_batch(columns)
            done.clear()
            waiting = 0

        def close() -> None:
            nonlocal part, at, size, waiting, turns
            done.append((now[0], part, at, turns))
            part, at, waiting, size, turns = part + 1, at + size, waiting + size, 0, []

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now != (conv,):
                    if turns:
                        close()
                    now, part, at, size = (conv,), 0, 0, 0
                if waiting > TOGETHER or len(done) >= 256:
                    yield from flush()
                turns.append((role, text))
                size += len(escape(role)) + len(escape(text)) + len(START) + len(SEP) + len(END) + 1
                if size > most_chars:
                    close()
        if turns:
            close()
        yield from flush()

    return rows.mapInArrow(lean(run), FORMATTED)


def loss_text(row: dict) -> list[str]:
    """The texts under the mask, one for each run of masked tokens, unescaped."""
    mask = np.asarray(row["mask"], np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    return [unescape(row["formatted"][row["starts"][a]: row["ends"][b - 1]]) for a, b in zip(edge[0::2], edge[1::2])]


def digests(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """What the formatted rows say, read back from them alone.  Unless they are ``ordered``, as
    ``format_conversations`` gives them, the rows of a conversation are brought together first."""
    layout = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now: tuple[int | None] | None = None
        said = loss = None

        def close() -> None:
            out[-1] |= {"turns_sha256": said.hexdigest(), "loss_sha256": loss.hexdigest()}

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if now != (row["conv_id"],):
                    if out:
                        close()
                    if len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, schema=layout)
                        out = []
                    now, said, loss = (row["conv_id"],), hashlib.sha256(), hashlib.sha256()
                    out.append({"conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0})
                for role, text in parse(row["formatted"]):
                    said.update(f"{role}\n{text}\n".encode())
                    out[-1]["n_turns"] += 1
                for text in loss_text(row):
                    loss.update(text.encode())
                    out[-1]["loss_chars"] += len(text)
                out[-1]["formatted_chars"] += len(row["formatted"])
        if out:
            close()
            yield pa.RecordBatch.from_pylist(out, schema=layout)

    return formatted.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
