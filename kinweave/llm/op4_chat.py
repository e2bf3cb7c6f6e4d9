"""Operator 4: chat formatting by token-level assembly.

Every turn is encoded on its own: reserved ids (beyond the tokenizer's vocabulary) mark the turn, and the encoded
content stands between them, so no text can produce a mark.  Control strings inside a text are escaped reversibly as
well, so that the rendered text parses back too.  Token positions and the loss mask follow from prefix sums over the
segment lengths.  Output rows are turns; a conversation of any length streams through its task turn by turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.registry import query
from kinweave.llm.store import keep, table
from kinweave.llm.words import ragged

#: Marks of the template with their reserved offsets behind the vocabulary.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"]
OPENING = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSING = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
ESCAPE = "\\"
_TO_ESCAPE = re.compile("|".join(re.escape(s) for s in [ESCAPE, *CONTROL]))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(" + "|".join(re.escape(s) for s in [ESCAPE, *CONTROL]) + ")")


def escape(text: str) -> str:
    """Put the escape character before every control string and every escape character."""
    return _TO_ESCAPE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class TurnCodec:
    """Encodes turns to ids and back.  Other roles than the template's are spelled between ``<<ROLE>>`` marks."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.mark = {s: size + k for k, s in enumerate(CONTROL)}
        self.string = {v: s for s, v in self.mark.items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def head(self, role: str) -> tuple[list[int], str]:
        if role in OPENING:
            return [self.mark[OPENING[role]]], OPENING[role]
        inside = escape(role)
        return [self.mark["<<ROLE>>"], *self.encode([inside])[0], self.mark["<</ROLE>>"]], f"<<ROLE>>{inside}<</ROLE>>"

    def tail(self, role: str) -> tuple[int, str]:
        closing = CLOSING.get(role, "<</ROLE>>")
        return self.mark[closing], closing

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def parse(self, ids: list[int]) -> tuple[str, str, str]:
        """Role, unescaped text and rendered text of one turn's ids."""
        opening, closing = self.string[ids[0]], self.string[ids[-1]]
        for role, mark in OPENING.items():
            if opening == mark:
                inside = self.decode(ids[1:-1])
                return role, unescape(inside), opening + inside + closing
        at = ids.index(self.mark["<</ROLE>>"])
        name, inside = self.decode(ids[1:at]), self.decode(ids[at + 1 : -1])
        return unescape(name), unescape(inside), f"{opening}{name}<</ROLE>>{inside}{closing}"


_codecs: dict[str, TurnCodec] = {}


def codec(path: str) -> TurnCodec:
    """One tokenizer per Python worker."""
    if path not in _codecs:
        _codecs[path] = TurnCodec(path)
    return _codecs[path]


def assemble(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """Format rows (conv_id, turn, role, text) as ``conv_id, seq, start, ids, loss_mask``, one row per turn.

    ``seq`` numbers the turns of a conversation by ``turn``, ties by role and text; ``start`` is the position of the first
    id in the conversation; ``loss_mask`` is 1 on the ids of an assistant's text.  Null text and null role are empty,
    a null turn comes first, a null conv_id is a conversation of its own.  Rows that repeat are turns of their own.
    """
    blank = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer_path)
        conv, seq, start = object(), 0, 0
        for batch in batches:
            convs, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            bodies = tool.encode([escape(t) for t in batch.column("text").to_pylist()])
            heads = [tool.head(r)[0] for r in roles]
            segments = np.array([[len(h), len(b), 1] for h, b in zip(heads, bodies)]).reshape(-1, 3)
            lengths = segments.sum(axis=1)
            flat, seqs, starts = [], [], []
            for c, role, head, body, n in zip(convs, roles, heads, bodies, lengths.tolist()):
                if c != conv:
                    conv, seq, start = c, 0, 0
                seqs.append(seq)
                starts.append(start)
                seq, start = seq + 1, start + n
                flat += head
                flat += body
                flat.append(tool.tail(role)[0])
            # mask by prefix sums: +1 where an assistant's text begins, -1 where it ends
            ends = np.cumsum(segments.ravel()).reshape(-1, 3)
            steps = np.zeros(len(flat) + 1, np.int32)
            for_loss = np.array([r == "assistant" for r in roles], dtype=bool)
            np.add.at(steps, ends[for_loss, 0], 1)
            np.add.at(steps, ends[for_loss, 1], -1)
            mask = np.cumsum(steps[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(seqs, pa.int64()), pa.array(starts, pa.int64()),
                    ragged(np.array(flat, np.int32), lengths, pa.int32()), ragged(mask.astype(np.int8), lengths, pa.int8()),
                ],
                names=["conv_id", "seq", "start", "ids", "loss_mask"],
            )

    return ordered.mapInArrow(run, "conv_id long, seq long, start long, ids array<int>, loss_mask array<tinyint>")


def digests(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Read formatted conversations back: one row of counts and digests per conversation."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer_path)
        done: list[tuple] = []
        conv, state = None, None

        def close() -> None:
            if state is not None:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for c, ids, mask in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "ids", "loss_mask")]):
                if state is None or c != conv:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, rendered = tool.parse(ids)
                under_mask = unescape(tool.decode([i for i, m in zip(ids, mask) if m]))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(under_mask)
                state[3].update(under_mask.encode())
                state[4] += len(rendered)
            yield emit()
            done.clear()
        close()
        yield emit()

    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, shape)


_MARKS = "|".join(re.escape(s) for s in [ESCAPE, *CONTROL])

SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v
), m as (
  select *, case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7
    else 17 + length(regexp_replace(role, '({_MARKS})', '\\\\\\1', 'g')) end
    + length(regexp_replace(text, '({_MARKS})', '\\\\\\1', 'g')) as chars from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from m group by conv_id
"""


@query("op4_chat", SQL)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = turns.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    return digests(keep(assemble(turns, str(path)), "chat"), str(path))
