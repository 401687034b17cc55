"""Chat formatting at the level of tokens.

Each turn is encoded apart: its role, a line feed and its escaped text; ids
beyond the vocabulary mark where a turn starts and ends, so no text can ever
produce a marker.  The loss mask comes from prefix sums over segment lengths.
In the text form the markers are strings; where content holds a control string
(of this template or of others), an escape is put after its first character, so
that none survives, and escapes themselves are doubled: reversible.

Conversations stream through a task in order of turn, one turn in memory at a
time, so even a conversation with a third of all rows needs bounded memory.

Defined cases: null text or role counts as empty; rows of a conversation are
ordered by turn (null first), then role, then text; repeated rows are repeated
turns; a null conversation id is a conversation of its own; an empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|turn|>", "<|end|>"
#: Control strings of this template and of common others. Fixed values.
CONTROLS = (START, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESC = "\\"
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\?)")

TURNS_SCHEMA = "conv_id long, turn long, role string, text string, formatted string, ids array<int>, loss_mask array<int>"


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` gives the text back."""
    text = text.replace(ESC, ESC + ESC)
    while True:  # a control string can begin inside another, so until none is left
        out = _CONTROL.sub(lambda m: m[0][0] + ESC + m[0][1:], text)
        if out == text:
            return out
        text = out


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> str:
    """The text form of one turn."""
    return f"{START}{escape(role.replace(ESC, ESC + ESC).replace(chr(10), ESC + 'n'))}\n{escape(text)}{END}\n"


class Formatter:
    """Encodes turns and reads token sequences back."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.tok.encode_special_tokens = True
        #: Reserved ids beyond the vocabulary: start of a turn, end of a turn.
        self.start, self.end = self.tok.get_vocab_size(), self.tok.get_vocab_size() + 1

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask (1 on an assistant's text) of one turn."""
        return self.turns([role], [text])[0]

    def turns(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        heads = [escape(r.replace(ESC, ESC + ESC).replace("\n", ESC + "n")) + "\n" for r in roles]
        got = self.tok.encode_batch([x for pair in zip(heads, map(escape, texts), strict=True) for x in pair], add_special_tokens=False)
        out = []
        for k, role in enumerate(roles):
            parts = [[self.start], got[2 * k].ids, got[2 * k + 1].ids, [self.end]]
            ids = np.fromiter((i for p in parts for i in p), np.int32)
            # +1 where a masked segment begins, -1 where it ends; their prefix sums are the mask
            edges = np.zeros(len(ids) + 1, np.int32)
            if role == "assistant":
                begin = 1 + len(parts[1])
                edges[begin] += 1
                edges[begin + len(parts[2])] -= 1
            out.append((ids, np.cumsum(edges)[:-1].astype(np.int32)))
        return out

    def read(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str]]:
        """(role, text, text under the mask) of each turn of a token sequence."""
        starts, ends = np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end)
        whole = self.tok.decode_batch([ids[a + 1 : b].tolist() for a, b in zip(starts, ends, strict=True)], skip_special_tokens=False)
        masked = self.tok.decode_batch([ids[a + 1 : b][mask[a + 1 : b] > 0].tolist() for a, b in zip(starts, ends, strict=True)], skip_special_tokens=False)
        out = []
        for text, under in zip(whole, masked, strict=True):
            head, _, body = text.partition("\n")
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
            out.append((role, unescape(body), unescape(under)))
        return out


def _ordered(rows: DataFrame) -> DataFrame:
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each turn with its formatted text, token ids and loss mask; a conversation is their concatenation by turn."""

    def run(batches):
        f = Formatter(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
                done = f.turns(roles, texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), part.column("text"), pa.array([render(r, t) for r, t in zip(roles, texts, strict=True)]), pa.array([x for x, _ in done], pa.list_(pa.int32())), pa.array([x for _, x in done], pa.list_(pa.int32()))],
                    ["conv_id", "turn", "role", "text", "formatted", "ids", "loss_mask"],
                )

    return _ordered(rows).mapInArrow(run, TURNS_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Reads conversations back from ``format_turns``'s tokens: counts and digests of what they say."""

    def run(batches):
        f = Formatter(tokenizer_path)
        names = [x.strip().split(" ")[0] for x in DIGEST_SCHEMA.split(",")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current, state = object(), None

        def row():
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            done = []
            convs, texts = batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()
            for at in range(0, batch.num_rows, 256):
                ids = batch.column("ids").slice(at, 256)
                mask = batch.column("loss_mask").slice(at, 256)
                turns = f.read(ids.flatten().to_numpy(), mask.flatten().to_numpy())
                for k, (role, text, under) in enumerate(turns, at):
                    if state is None or convs[k] != current:
                        if state is not None:
                            done.append(row())
                        current, state = convs[k], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(under)
                    state[3].update(under.encode())
                    state[4] += len(texts[k])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 6, types, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), types, strict=True)], names)

    return formatted.select("conv_id", "formatted", "ids", "loss_mask").mapInArrow(run, DIGEST_SCHEMA)
