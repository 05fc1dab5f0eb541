"""Rows for supervised training: prompt and response joined, masks of prompts, replies and padding, tokenisation checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED = -100


def thought_aware_row(prompt: Column, response: Column, seq_len: int, thought: int, eos: int, mask_prompt: bool = True) -> Column:
    """(inputs, labels) of encoded texts: the prompt without its end id, the response without its start id; a response that doesn't open a
    thought loses its end id; the opening tag counts as prompt; labels of the prompt are ignored."""
    head, tail = F.slice(prompt, F.lit(1), F.greatest(F.size(prompt) - 1, F.lit(0))), F.slice(response, F.lit(2), F.greatest(F.size(response) - 1, F.lit(0)))
    thinks = F.coalesce(F.get(tail, F.lit(0)) == thought, F.lit(False))
    ends = F.coalesce(F.try_element_at(tail, F.lit(-1)) == eos, F.lit(False))
    tail = F.when(~thinks & ends, F.slice(tail, F.lit(1), F.size(tail) - 1)).otherwise(tail)
    ids = F.slice(F.concat(head, tail), F.lit(1), F.lit(seq_len))
    known = F.least(F.size(head) + thinks.cast("int"), F.when(F.size(head) + F.size(tail) > seq_len, F.lit(seq_len - 1)).otherwise(F.size(head) + 1))
    cut = F.when(F.lit(mask_prompt) & (known > 1), known - 1).otherwise(0)
    inputs, shifted = F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    return F.struct(inputs.alias("inputs"), F.transform(shifted, lambda x, i: F.when(i < cut, F.lit(IGNORED).cast("long")).otherwise(x.cast("long"))).alias("labels"))


def reply_mask(call: int, starts: set[int], structural: set[int], equals: int | None):
    """An Arrow-batched function (inputs, labels) -> labels: the environment's move after each call is ignored, up to the model's next move or a structural token.

    A piece after the sign of a promotion starts no move. One linear walk a row.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def masked(inputs: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _masked(x, y, call, starts, structural, equals) for x, y in zip(inputs, labels, strict=True)])

    return masked


def _masked(inputs, labels, call: int, starts: set[int], structural: set[int], equals: int | None) -> list[int]:
    out = np.array(labels, dtype=np.int64)
    waiting, begun, promoting = False, False, False
    for j, (x, y) in enumerate(zip(inputs, labels, strict=False)):
        if x == call:
            waiting, begun, promoting = True, False, False
        if not waiting:
            continue
        starts_move = y in starts and not promoting
        if y in structural or (starts_move and begun):
            waiting = False
            continue
        begun = begun or starts_move
        promoting = not starts_move and equals is not None and y == equals
        out[j] = IGNORED
    return out.tolist()


def chat_row(prompt: Column, response: Column, most: int, pad: int = 0, cut: str = "right") -> Column:
    """(input_ids, attention_mask, position_ids, loss_mask) of a fixed length. The loss is zero on the prompt but its last token, on the response's last token, and on padding."""
    if cut not in ("left", "right", "error"):
        raise ValueError(f"unknown cut {cut!r}")
    n = F.size(prompt) + F.size(response)
    joined = F.concat(prompt, response)
    if cut == "error":
        joined = F.when(n > most, F.raise_error(F.concat(F.lit("sequence length "), n.cast("string"), F.lit(f" is above {most}"))).cast("array<bigint>")).otherwise(joined)
    kept = F.when(n <= most, joined).otherwise(F.slice(joined, n - most + 1 if cut == "left" else F.lit(1), F.lit(most)))
    size = F.least(n, F.lit(most))
    ids = F.concat(kept, F.array_repeat(F.lit(pad).cast("long"), F.lit(most) - size))
    places = F.sequence(F.lit(0), F.lit(most - 1))
    attention = F.transform(places, lambda i: (i < size).cast("int"))
    # positions count real tokens and stay at the last one over the padding
    positions = F.transform(places, lambda i: F.least(i, F.greatest(size - 1, F.lit(0))))
    head = F.when(F.size(prompt) > 1, F.least(F.size(prompt), F.lit(most)) - 1).otherwise(0)
    last = F.least(n, F.lit(most)) - 1
    loss = F.transform(places, lambda i: F.when((i < head) | (i == last) | (i >= size), 0).otherwise(1))
    return F.struct(ids.alias("input_ids"), attention.alias("attention_mask"), positions.alias("position_ids"), loss.alias("loss_mask"))


def merged_turns(df: DataFrame, conv: str, turn: str, role: str, text: str, tool: str = "tool", roles: tuple[str, ...] = ("system", "user", "assistant", "tool")) -> DataFrame:
    """Turns with consecutive tool messages joined by line ends, numbered anew; an unknown role, or a system message that isn't first, fails the job."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(conv).orderBy(turn)
    wrong = F.when(~F.col(role).isin(*roles), F.concat(F.lit("unknown role "), F.col(role))).when((F.col(role) == "system") & (F.row_number().over(w) > 1), F.lit("a system message must be first"))
    rows = df.withColumn("_wrong", wrong).withColumn("_role", F.when(F.col("_wrong").isNull(), F.col(role)).otherwise(F.raise_error(F.col("_wrong")).cast("string")))
    follows = (F.col("_role") == tool) & F.coalesce(F.lag(role).over(w) == tool, F.lit(False))
    rows = rows.withColumn("_part", F.sum((~follows).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, text))), lambda m: m[text]), "\n")
    return rows.groupBy(conv, (F.col("_part") - 1).cast("int").alias(turn), F.col("_role").alias(role)).agg(joined.alias(text))


def checked_tokens(df: DataFrame, joined: str, whole: str, out: str = "same_tokens") -> DataFrame:
    """Whether the concatenated pieces equal the whole text's tokens; the concatenated form is what later steps use."""
    return df.withColumn(out, F.col(joined).eqNullSafe(F.col(whole)))


def trace_ids(text: Column, vocab: dict[str, int], moves: Column, bos: str = "<bos>", eos: str = "<eos>", unk: str = "<unk>") -> Column:
    """Ids of a text: one that holds a thought or a best mark is split at white space, others go by ``moves``, the tokens of a game."""
    from ..functions.lan_tokens import ids_of

    thought = F.contains(text, F.lit("<T>")) | F.contains(text, F.lit("<best>"))
    plain = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return ids_of(F.when(thought, plain).otherwise(moves), vocab, bos, eos, unk)


def shown_ids(text: Column, ids: Column, words: Column, glued: Column) -> Column:
    """Ids as text: those of a thought joined by blanks, others re-glued into moves."""
    thought = F.exists(F.transform(ids, lambda i: F.get(words, i.cast("int"))), lambda w: w.isin("<T>", "<best>"))
    return F.when(thought, F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(words, i.cast("int")), F.lit("?"))), " ")).otherwise(glued)


def special_ids(vocab: dict[str, int], family: tuple[str, ...], name: str = "family") -> dict[str, int]:
    """Ids of a family of special tokens; one that isn't in the vocabulary means that the family isn't enabled."""
    missing = [t for t in family if t not in vocab]
    if missing:
        raise ValueError(f"{name} tokens are not enabled: {', '.join(missing)}")
    return {t: vocab[t] for t in family}
