"""Parsing and grading of generated text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markup of reasoning traces.
OPEN, CLOSE, SEP, CALL = "<T>", "</T>", "<sep>", "<call_env>"


def reasoning(text: Column) -> Column:
    """What stands before the closing tag; without one, what stands after the opening tag; else nothing."""
    return F.when(text.contains(CLOSE), F.substring_index(text, CLOSE, 1)).when(text.contains(OPEN), F.substring_index(text, OPEN, -1)).otherwise("")


def answer_part(text: Column) -> Column:
    return F.when(text.contains(CLOSE), F.trim(F.substring_index(text, CLOSE, -1)))


def well_formed(text: Column, exactly_one: bool = True) -> Column:
    n = F.size(F.split(text, CLOSE)) - 1
    return n == 1 if exactly_one else n >= 1


def lines_of(text: Column) -> Column:
    """The candidate lines: split at the separator, markup dropped, empty lines dropped."""
    words = lambda s: F.filter(F.split(F.trim(s), r"\s+"), lambda w: ~w.isin(OPEN, CLOSE, SEP, CALL, ""))
    return F.filter(F.transform(F.split(reasoning(text), SEP), words), lambda a: F.size(a) > 0)


def strip_env_pairs(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*<call_env>\s+\S+", ""))


def normal_answer(text: Column) -> Column:
    """Lower case, punctuation and articles removed, white space collapsed."""
    low = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(text: Column, gold: Column) -> Column:
    """Whether the normal forms are equal; gold: an array of answers."""
    return F.exists(gold, lambda g: normal_answer(g) == normal_answer(text))


def contains_match(text: Column, gold: Column) -> Column:
    return F.exists(gold, lambda g: normal_answer(text).contains(normal_answer(g)))


def last_answer(text: Column) -> Column:
    """The body of the last answer tag."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def strict_number(text: Column) -> Column:
    """The number after the last ####, commas removed."""
    return F.regexp_replace(F.try_element_at(F.regexp_extract_all(text, F.lit(r"####\s*(-?[0-9.,]+)"), F.lit(1)), F.lit(-1)), ",", "")


def flexible_number(text: Column) -> Column:
    """The last number anywhere."""
    return F.regexp_replace(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(-?[0-9][0-9.,]*)"), F.lit(1)), F.lit(-1)), "[,]|[.]$", "")


def numbers_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Equal within a relative tolerance, also as percent."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = lambda u, v: F.abs(u - v) <= F.lit(tolerance) * F.greatest(F.abs(v), F.lit(1e-12))
    return F.coalesce(near(x, y) | near(x / 100, y) | near(x * 100, y), F.lit(False))


def position_key(fen: Column) -> Column:
    """The first two fields of a position."""
    return F.concat_ws(" ", F.slice(F.split(fen, " "), 1, 2))


def cp_label(cp: Column) -> Column:
    """Centipawns as a short label: nine levels, symmetric."""
    size = F.abs(cp)
    label = F.when(size > 300, "3").when(size > 150, "2").when(size > 75, "1").when(size > 25, "0.5").otherwise("0")
    return F.when(label == "0", "0").otherwise(F.concat(F.when(cp > 0, "+").otherwise("-"), label))


def model_size_millions(tag: Column) -> Column:
    return F.regexp_extract(tag, r"(\d+)[mM]\b", 1).try_cast("int")


def decode_list(text: Column) -> Column:
    """A list written as JSON, as a Python literal, or separated by commas or blanks."""
    as_json = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    plain = F.filter(F.split(F.regexp_replace(text, r"[\[\]'\",]", " "), r"\s+"), lambda w: w != "")
    return F.when(text.startswith("["), F.coalesce(as_json, plain)).otherwise(plain)


def lan_to_uci(move: Column, white: Column | bool = True, sentinel: bool = False) -> Column:
    """A long algebraic move to coordinates; castling by side; NULL if it isn't a move."""
    rank = F.when(F.lit(white) if isinstance(white, bool) else white, "1").otherwise("8")
    bare = F.regexp_replace(move, "[+#]", "")
    body = F.regexp_extract(bare, r"^[KQRBNP]?([a-h][1-8])x?([a-h][1-8])(?:=?([QRBNqrbn]))?$", 1)
    to = F.regexp_extract(bare, r"^[KQRBNP]?([a-h][1-8])x?([a-h][1-8])(?:=?([QRBNqrbn]))?$", 2)
    promoted = F.lower(F.regexp_extract(bare, r"^[KQRBNP]?([a-h][1-8])x?([a-h][1-8])(?:=?([QRBNqrbn]))?$", 3))
    return (
        F.when(bare == "O-O", F.concat(F.lit("e"), rank, F.lit("g"), rank))
        .when(bare == "O-O-O", F.concat(F.lit("e"), rank, F.lit("c"), rank))
        .when(body != "", F.concat(body, to, promoted))
    )


def split_lan(move: Column) -> Column:
    """The component tokens of a long algebraic move: piece, squares, capture, promotion, check."""
    return F.regexp_extract_all(move, F.lit(r"(O-O-O|O-O|[a-h][1-8]|[KQRBNPx=+#])"), F.lit(1))
