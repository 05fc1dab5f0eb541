"""Tokens of long algebraic notation: vocabulary, splitting, ids and back, as column expressions."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces, promotions, marks, results and the markup of traces, in the order of their ids.
PIECES, PROMOTIONS = "KQRBNP", "QRBN"
MARKS = ("x", "=", "+", "#", "O-O", "O-O-O", ".", "...")
RESULTS = ("*", "0-1", "1-0", "1/2-1/2")
SPECIALS = ("<T>", "</T>", "<sep>")

#: Parts of a vocabulary's table.
DEALS = 128

# a promotion is read only after its sign; what follows a move goes
_MOVE = r"^([KQRBNP])([a-h][1-8])?(x)?([a-h][1-8])?(?:(=)([QRBN])?|[QRBN])?([+#])?[\s\S]*"


def vocabulary(bos: str = "<bos>", eos: str = "<eos>", unk: str = "<unk>", pad: str | None = None, numbers: bool = True, results: bool = False, specials: tuple[str, ...] = ()) -> dict[str, int]:
    """Dense ids in a stated order; a word keeps the first id it gets."""
    squares = [f + r for f in "abcdefgh" for r in "12345678"]
    words = [bos, eos, unk, *([pad] if pad else []), *PIECES, *squares, *PROMOTIONS, *MARKS, *("0123456789" if numbers else ""), *(RESULTS if results else ()), *specials]
    return {w: k for k, w in enumerate(dict.fromkeys(words))}


def word_tokens(word: Column) -> Column:
    """A move's component tokens; castling with its suffix apart; what doesn't start with a piece stays whole."""
    bare = F.rtrim(word, F.lit("+#"))
    castling = F.filter(F.array(bare, F.substring(word, F.length(bare) + 1, F.length(word))), lambda t: t != "")
    parts = F.split(F.regexp_replace(word, _MOVE, "$1 $2 $3 $4 $5 $6 $7"), " ")
    return (
        F.when(bare.isin("O-O", "O-O-O"), castling)
        .when(F.substring(word, 1, 1).isin(*PIECES), F.filter(parts, lambda t: t != ""))
        .otherwise(F.array(word))
    )


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def move_tokens(text: Column) -> Column:
    """The tokens of a text of moves."""
    return F.flatten(F.transform(words(text), word_tokens))


def trace_tokens(text: Column, specials: tuple[str, ...] = SPECIALS) -> Column:
    """The tokens of a trace: markup and results whole, numbers by digit, dots as one, the rest as moves."""

    def split(w: Column) -> Column:
        dots = F.regexp_extract(w, r"(\.*)$", 1)
        digits = F.split(F.regexp_replace(w, r"\.+$", ""), "")
        numbered = F.concat(digits, F.when(dots == "", F.array().cast("array<string>")).otherwise(F.array(F.when(F.length(dots) > 1, "...").otherwise("."))))
        return (
            F.when(w.isin(*specials, *RESULTS), F.array(w))
            .when(w.rlike(r"^[0-9].*\.") | w.rlike("^[0-9]+$"), F.filter(numbered, lambda t: t != ""))
            .otherwise(word_tokens(w))
        )

    return F.flatten(F.transform(words(text), split))


def ids_of(tokens: Column, vocab: dict[str, int], bos: str = "<bos>", eos: str = "<eos>", unk: str = "<unk>") -> Column:
    """Ids between the start and the end id; unknown tokens get the unknown id. The vocabulary is a literal of some hundred words."""
    # a map is searched from its start: words are dealt by checksum into maps of one or two
    deals = [[F.lit(x) for w, k in vocab.items() if zlib.crc32(w.encode()) % DEALS == d for x in (w, k)] for d in range(DEALS)]
    table = F.array(*[F.create_map(*d) if d else F.create_map().cast("map<string,int>") for d in deals])
    one = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(F.get(table, (F.crc32(t) % DEALS).cast("int")), t), F.lit(vocab[unk])))
    return F.concat(F.array(F.lit(vocab[bos])), one, F.array(F.lit(vocab[eos])))


def text_of(ids: Column, vocab: dict[str, int], bos: str = "<bos>", eos: str = "<eos>", unk: str = "<unk>") -> Column:
    """The text of ids: numbers, dots, moves and suffixes are put together again; start and end ids go, ids out of the vocabulary read as unknown."""
    if sorted(vocab.values()) == list(range(len(vocab))):
        table, word = F.array(*[F.lit(w) for w, _ in sorted(vocab.items(), key=lambda x: x[1])]), F.get
    else:
        table, word = F.create_map(*[F.lit(x) for w, k in vocab.items() for x in (k, w)]), F.try_element_at
    shown = F.filter(F.transform(ids, lambda i: F.coalesce(word(table, i), F.lit(unk))), lambda t: ~t.isin(bos, eos))
    text = F.array_join(shown, " ")
    for pattern, by in (
        (r"(?<=(?:^| )[0-9]) (?=[0-9](?: |$))", ""),  # digits
        (r"(?<=(?:^| )[0-9]{1,12}) (?=\.(?:\.\.)?(?: |$))", ""),  # dots
        (r"(?<=(?:^| )(?:O-O|O-O-O)) (?=[+#](?: |$))", ""),  # castling's suffix
        (r"(?<=^| )([KQRBNP])(?: (\S+))?(?: (x)(?= |$))?(?: (\S+))?(?: (=) ([QRBN])(?= |$))?(?: ([+#])(?= |$))?", "$1$2$3$4$5$6$7"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return text
