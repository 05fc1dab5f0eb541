"""Moves in generated text, as column expressions: recognising, picking and converting words of long notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CALL, CLOSE, OPEN

#: A complete move, and its parts (piece, from, to, promotion).
MOVE = r"^(?:O-O-O|O-O|[PNBRQK][a-h][1-8]x?[a-h][1-8](?:=[QRBN])?)[+#]*$"
PARTS = r"^[PNBRQK]([a-h][1-8])x?([a-h][1-8])(?:=([QRBN]))?[+#]*$"
#: The parts with a line's end, which $ passes over, so that a replacement takes the whole word.
SQUARES = PARTS.removesuffix("$") + r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\z"
#: What castling becomes where the side isn't known.
SHORT_CASTLE, LONG_CASTLE = "castle_kingside", "castle_queenside"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_move(word: Column) -> Column:
    return F.coalesce(word.rlike(MOVE), F.lit(False))


def moves_in(text: Column) -> Column:
    """All complete moves in order; move numbers and other words are passed over."""
    return F.filter(words(text), is_move)


def first_move(text: Column) -> Column:
    """The first complete move, NULL without one; a blank text gives an empty string."""
    return F.when(F.size(words(text)) == 0, "").otherwise(F.get(moves_in(text), F.lit(0)))


def last_move(text: Column) -> Column:
    return F.try_element_at(moves_in(text), F.lit(-1))


def closing_tags(text: Column) -> Column:
    return F.size(F.split(text, CLOSE)) - 1


def move_after_thought(text: Column, exactly_one: bool = True) -> Column:
    """(move, formatted): the first move after the first closing tag. Graders of one turn want exactly one tag, those of several any."""
    formatted = closing_tags(text) == 1 if exactly_one else closing_tags(text) >= 1
    tail = F.substring(text, F.locate(CLOSE, text) + len(CLOSE), F.length(text))
    return F.struct(F.when(formatted, F.nullif(first_move(tail), F.lit(""))).alias("move"), formatted.alias("formatted"))


def own_moves(text: Column) -> Column:
    """The model's move of each turn that ends in a call: after the thought, else the last move before the call; NULL where there is none."""
    turns = F.split(text, CALL)
    own = F.slice(turns, F.lit(1), F.size(turns) - 1)
    return F.transform(own, lambda t: F.coalesce(move_after_thought(t, False)["move"], last_move(t)))


def to_uci(word: Column, white: bool | Column = True) -> Column:
    """Strict: a complete move as coordinates, castling by side; NULL for anything else."""
    rank = F.when(F.lit(white) if isinstance(white, bool) else white, "1").otherwise("8")
    bare = F.rtrim(word, F.lit("+#"))
    squares = F.lower(F.regexp_replace(word, SQUARES, "$1$2$3"))
    return F.when(bare == "O-O", F.concat(F.lit("e"), rank, F.lit("g"), rank)).when(bare == "O-O-O", F.concat(F.lit("e"), rank, F.lit("c"), rank)).when(word.rlike(PARTS), squares)


def coordinates(word: Column) -> Column:
    """Lenient: decorations and the piece go, a promotion follows in lower case; castling is a sentinel. Nothing is checked."""
    bare = F.translate(F.trim(word), "+#", "")
    plain = F.translate(bare, "x", "")
    at = F.locate("=", plain)
    body, promoted = F.when(at > 0, F.substring(plain, F.lit(1), at - 1)).otherwise(plain), F.when(at > 0, F.lower(F.substring(plain, at + 1, F.length(plain)))).otherwise("")
    body = F.when((F.length(body) >= 5) & F.substring(body, 1, 1).isin(*"PNBRQK"), F.substring(body, F.lit(2), F.length(body))).otherwise(body)
    return F.when(bare.isin("O-O", "0-0"), SHORT_CASTLE).when(bare.isin("O-O-O", "0-0-0"), LONG_CASTLE).otherwise(F.concat(body, promoted))


def with_castling(uci: Column, white: Column) -> Column:
    """Castling sentinels as coordinates of the side to move."""
    return F.when(uci == SHORT_CASTLE, F.when(white, "e1g1").otherwise("e8g8")).when(uci == LONG_CASTLE, F.when(white, "e1c1").otherwise("e8c8")).otherwise(uci)


def normal_move(word: Column) -> Column:
    """For comparison: trimmed, without closing check marks and blanks, in lower case."""
    return F.lower(F.replace(F.regexp_replace(F.trim(word), r"[+#]+$", ""), F.lit(" "), F.lit("")))


def first_listed(text: Column) -> Column:
    """The first entry of a list separated by commas, NULL if all are blank."""
    return F.get(F.filter(F.split(text, ","), lambda w: F.trim(w) != ""), F.lit(0))


def has_both_tags(text: Column) -> Column:
    return F.contains(text, F.lit(OPEN)) & F.contains(text, F.lit(CLOSE))


def boundary(tokens: Column) -> Column:
    """(end, move): the shortest prefix of the tokens whose text holds a complete move; NULLs without one.

    One fold: only the word at the end of the text so far can grow.
    """
    none = F.struct(F.lit("").alias("open"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("move"))

    def step(acc: Column, token: Column) -> Column:
        parts = F.split(F.concat(acc["open"], token), r"\s+")
        hit = F.get(F.filter(parts, is_move), F.lit(0))
        new = acc["end"].isNull() & hit.isNotNull()
        return F.struct(
            F.element_at(parts, -1).alias("open"), (acc["seen"] + 1).alias("seen"),
            F.when(new, acc["seen"] + 1).otherwise(acc["end"]).alias("end"), F.when(new, hit).otherwise(acc["move"]).alias("move"),
        )

    return F.aggregate(tokens, none, step, lambda acc: F.struct(acc["end"].alias("end"), acc["move"].alias("move")))
