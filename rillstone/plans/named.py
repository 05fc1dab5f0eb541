"""What is found by name: reward managers, tokenizers, evaluators, tools."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import final_answers as N
from ..functions import lan_tokens as L
from ..operators import grading as G
from ..operators import rewards as R
from ..operators import tokens as K
from .registry import Registry

#: Reward managers: (output, targets) -> a score per row. A row that can't be scored counts 0 by itself.
REWARDS: Registry[Callable[[Column, Column], Column]] = Registry("reward manager")
REWARDS.register("naive", lambda output, targets: G.safe(G.one_turn(output, targets)["score"]))
REWARDS.register("formatted", lambda output, targets: G.safe(G.one_turn(output, targets, "formatted")["score"]))
REWARDS.register("plain", lambda output, targets: G.safe(G.one_turn(output, targets, "plain")["score"]))
REWARDS.register("batch", lambda output, targets: G.safe(G.several_turns(output, targets)["score"]))
REWARDS.register("answer", lambda output, targets: G.safe(R.exact_answer(output, targets)))
REWARDS.register("boxed", lambda output, targets: G.safe(N.weighted(output, F.get(targets, F.lit(0)))))


class Tokens(ABC):
    """A tokenizer over columns."""

    vocab: dict[str, int]

    @abstractmethod
    def encode(self, text: Column) -> Column: ...

    @abstractmethod
    def decode(self, ids: Column) -> Column: ...

    def batch(self, text: Column, length: int, left: bool = False, cut: str = "right", pad: int = 0) -> Column:
        """(input_ids, attention_mask) of a fixed length."""
        ids = K.truncate(self.encode(text), length, cut)
        real = F.transform(ids, lambda _: F.lit(1))
        return F.struct(K.pad(ids, length, pad, left).alias("input_ids"), K.pad(real, length, 0, left).alias("attention_mask"))

    def id_of(self, token: str) -> int | None:
        return self.vocab.get(token)


class MoveTokens(Tokens):
    """Long notation: moves in their parts, or whitespace words of a thought."""

    def __init__(self, thoughts: bool = False, **options):
        self.vocab, self.thoughts = L.vocabulary(**options), thoughts

    def encode(self, text: Column) -> Column:
        return L.ids_of(L.trace_tokens(text) if self.thoughts else L.move_tokens(text), self.vocab)

    def decode(self, ids: Column) -> Column:
        return L.text_of(ids, self.vocab)


TOKENIZERS: Registry[Callable[..., Tokens]] = Registry("tokenizer")
TOKENIZERS.register("moves", MoveTokens)
TOKENIZERS.register("thoughts", lambda **o: MoveTokens(True, **{"specials": ("<T>", "</T>", "<sep>"), **o}))


class Evaluator(ABC):
    """Hooks around one evaluation: load a table, prepare it, grade it. Predictions are a column of the table, made elsewhere."""

    state, target, predicted, legal = "state", "target", "predicted", "legal"

    @abstractmethod
    def load(self, spark, path: str) -> DataFrame: ...

    def prepare(self, df: DataFrame) -> DataFrame:
        """Rows without a state or target go."""
        return df.na.drop(subset=[self.state, self.target])

    def convert(self, df: DataFrame) -> DataFrame:
        """Predictions in the targets' notation; what doesn't convert becomes an empty string."""
        return df.withColumn(self.predicted, F.coalesce(self.predicted, F.lit("")))

    def evaluate(self, spark, path: str, order: str, most: int | None = None, sink: str | None = None) -> DataFrame:
        """One row of metrics; with a sink, the graded rows are written there."""
        rows = self.convert(self.prepare(self.load(spark, path)))
        rows = rows.orderBy(order).limit(most) if most is not None else rows
        if sink:
            rows.write.parquet(sink)
        return G.evaluation(rows, self.predicted, self.target, self.legal)


EVALUATORS: Registry[type[Evaluator]] = Registry("evaluator")
#: Tools that a dialogue may call: (arguments column) -> answer column.
TOOLS: Registry[Callable[[Column], Column]] = Registry("tool")
