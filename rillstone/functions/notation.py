"""Notation and legality as Arrow-batched functions: they depend on the board, which no built-in function knows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules


def _try(f):
    def safe(x):
        try:
            return f(x) if x is not None else None
        except (ValueError, IndexError):
            return None

    return safe


@F.pandas_udf(T.ArrayType(T.StringType()))
def legal_moves(fen: pd.Series) -> pd.Series:
    return fen.map(_try(lambda f: sorted(map(rules.uci, rules.Position.parse(f).legal()))))


@F.pandas_udf(T.BooleanType())
def is_legal(fen: pd.Series, move: pd.Series) -> pd.Series:
    """Any notation; an error is false."""
    return pd.Series([bool(f is not None and m is not None and _try(lambda f, m=m: rules.replay([m], f)[0])(f)) for f, m in zip(fen, move, strict=True)])


@F.pandas_udf(T.StringType())
def canonical_line(game: pd.Series) -> pd.Series:
    """The main line in short notation; a game that doesn't replay gives its text without comments, white space folded."""

    def f(text):
        if text is None or not text.strip():
            return ""
        words = rules.movetext(text)
        done, seen = rules.replay(words)
        return " ".join(p.san(m) for p, m in zip(seen, done, strict=False)) if done and len(done) == len(words) else " ".join(words)

    return game.map(f)


@F.pandas_udf(T.StringType())
def numbered_line(game: pd.Series) -> pd.Series:
    """1. e4 e5 2. ..."""

    def f(text):
        if text is None:
            return None
        done, seen = rules.replay(rules.movetext(text))
        out = []
        for p, m in zip(seen, done, strict=False):
            out += [f"{p.full}."] * p.white + [p.san(m)]
        return " ".join(out)

    return game.map(f)


@F.pandas_udf(T.ArrayType(T.StringType()))
def long_tokens(game: pd.Series) -> pd.Series:
    """The main line in long notation; NULL if nothing replays."""

    def f(text):
        if text is None:
            return None
        done, seen = rules.replay(rules.movetext(text))
        return [p.lan(m) for p, m in zip(seen, done, strict=False)] or None

    return game.map(f)


@F.pandas_udf(T.ArrayType(T.StringType()))
def positions_reached(moves: pd.Series) -> pd.Series:
    """The first two position fields after each move, the start included, up to the first illegal move."""
    return moves.map(lambda ms: [" ".join(p.fen().split()[:2]) for p in rules.replay([] if ms is None else list(ms))[1]])


@F.pandas_udf(T.StringType())
def final_position(prompt: pd.Series) -> pd.Series:
    """The position after the moves before the opening tag; NULL if any is illegal."""

    def f(text):
        words = rules.movetext((text or "").split("<T>")[0])
        done, seen = rules.replay(words)
        return seen[-1].fen() if len(done) == len(words) else None

    return prompt.map(f)


def _bare(p: rules.Position, move: rules.Move) -> str:
    return p.lan(move).rstrip("+#")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def moves_in_lan(fen: pd.Series) -> pd.Series:
    """Each legal move in coordinates with its long notation, without marks of check."""

    def f(text):
        p = rules.Position.parse(text)
        return {rules.uci(m): _bare(p, m) for m in p.legal()}

    return fen.map(_try(f))


@F.pandas_udf(T.StringType())
def move_of_lan(fen: pd.Series, text: pd.Series) -> pd.Series:
    """The legal move with whose long notation the text starts, in coordinates: the longest one; NULL if none."""

    def f(fen, text):
        p = rules.Position.parse(fen)
        found = [(len(_bare(p, m)), rules.uci(m)) for m in p.legal() if text.startswith(_bare(p, m))]
        return max(found)[1] if found else None

    return pd.Series([_try(lambda x, t=t: f(x, t) if t is not None else None)(x) for x, t in zip(fen, text, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def legal_prefix(fen: pd.Series, output: pd.Series, most: pd.Series) -> pd.Series:
    """The moves of a generated text in coordinates, move numbers skipped, up to the first word that isn't a legal move and to ``most`` moves."""

    def f(fen, output, most):
        words = [w for w in (output or "").split() if not re.fullmatch(r"\d+\.+|\.\.\.", w)]
        return [rules.uci(m) for m in rules.replay(words[: int(most)], fen)[0]]

    return pd.Series([_try(lambda x, o=o, k=k: f(x, o, k))(x) for x, o, k in zip(fen, output, most, strict=True)], dtype=object)


def decontaminate_games(games: DataFrame, tests: DataFrame, key: str, moves: str, fen: str) -> tuple[DataFrame, DataFrame]:
    """(clean, removed): a game goes if any position that it reaches is a test position. One shuffle by position."""
    known = tests.select(F.concat_ws(" ", F.slice(F.split(fen, " "), 1, 2)).alias("_at")).filter("_at <> ''").distinct()
    seen = games.select(key, F.explode(F.array_distinct(positions_reached(moves))).alias("_at"))
    hit = seen.join(known, "_at", "left_semi").select(key).distinct()
    return games.join(hit, key, "left_anti"), games.join(hit, key, "left_semi")


@F.pandas_udf(T.ArrayType(T.StringType()))
def positions_along(fen: pd.Series, moves: pd.Series) -> pd.Series:
    """The position before each move of a line, up to the first illegal one."""
    return pd.Series([_try(lambda x, ms=ms: [p.fen() for p in rules.replay([] if ms is None else list(ms), x)[1]][: 0 if ms is None else len(ms)])(x) for x, ms in zip(fen, moves, strict=True)], dtype=object)


def _resolved(p: rules.Position, move: str) -> str | None:
    for tail in ("", *("qrbn" if len(move) == 4 else "")):
        if p.from_uci(move + tail) is not None:
            return move + tail
    return None


@F.pandas_udf(T.StringType())
def resolved(fen: pd.Series, move: pd.Series) -> pd.Series:
    """Coordinates as a legal move, a missing promotion filled in (queen, rook, bishop, knight); NULL if there is none."""
    return pd.Series([_try(lambda x, m=m: _resolved(rules.Position.parse(x), m) if m else None)(x) for x, m in zip(fen, move, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("move", T.StringType()), T.StructField("child", T.StringType())])))
def children_of(fen: pd.Series, moves: pd.Series) -> pd.Series:
    """The legal ones of a list of coordinates, each with the position it leads to."""

    def f(fen, moves):
        p = rules.Position.parse(fen)
        found = [(u, p.push(p.from_uci(u)).fen()) for u in (_resolved(p, m) for m in moves if m) if u]
        return [{"move": u, "child": c} for u, c in found]

    return pd.Series([_try(lambda x, ms=ms: f(x, [] if ms is None else list(ms)))(x) or [] for x, ms in zip(fen, moves, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def white_to_move(fen: pd.Series) -> pd.Series:
    return fen.map(lambda x: None if x is None or len(x.split()) < 2 else x.split()[1] == "w")


def _numbered(done, seen) -> str:
    out = []
    for k, (p, m) in enumerate(zip(seen, done, strict=False)):
        out += ([f"{k // 2 + 1}."] if k % 2 == 0 else []) + [p.san(m)]
    return " ".join(out)


@F.pandas_udf(T.StringType())
def line_until(game: pd.Series, fen: pd.Series) -> pd.Series:
    """The numbered line up to the first position with the target's pieces, the start included; NULL if it is never reached."""

    def f(text, target):
        done, seen = rules.replay(rules.movetext(text))
        for k, p in enumerate(seen):
            if p.fen().split()[0] == target.split()[0]:
                return _numbered(done[:k], seen[:k])
        return None

    return pd.Series([_try(lambda x, t=t: f(x, t) if t is not None else None)(x) for x, t in zip(game, fen, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("state", T.StringType()), T.StructField("next", T.StringType())]))
def after_trigger(game: pd.Series, moves: pd.Series) -> pd.DataFrame:
    """A puzzle's state after its first move, as a numbered line without headers or result, and the second move; NULLs for shorter or illegal ones."""

    def f(text, line):
        words = (line or "").split()
        if len(words) < 2:
            return None, None
        played = rules.movetext(text)
        done, seen = rules.replay([*played, words[0]])
        return (_numbered(done, seen), words[1]) if len(done) == len(played) + 1 else (None, None)

    rows = []
    for x, m in zip(game, moves, strict=True):
        try:
            rows.append(f(x, m) if x is not None else (None, None))
        except (ValueError, IndexError):
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["state", "next"])


@F.pandas_udf(T.StringType())
def as_uci(fen: pd.Series, word: pd.Series) -> pd.Series:
    """A move in any notation as coordinates; NULL if it can't be played."""

    def f(fen, word):
        done, _ = rules.replay([word], fen)
        return rules.uci(done[0]) if done else None

    return pd.Series([_try(lambda x, w=w: f(x, w) if w else None)(x) for x, w in zip(fen, word, strict=True)], dtype=object)


def positions_needed(rows: DataFrame, fen: str, candidates: str) -> DataFrame:
    """The distinct positions whose scores an analysis needs: the roots, and those after each legal candidate (coordinates)."""
    roots = rows.select(F.col(fen).alias("position")).filter("position is not null")
    after = rows.select(F.explode(children_of(fen, candidates)).alias("x")).select(F.col("x.child").alias("position"))
    return roots.unionByName(after).distinct()


def target_presence(rows: DataFrame, fen: str, target: str, roots: str, every: str) -> DataFrame:
    """rows with ``target_uci``, ``in_root`` (among the legal root candidates) and ``anywhere`` (its coordinates are written anywhere; no board is asked).

    target: the first true move as written; roots and every: arrays of written moves. Without a target the flags are NULL.
    """
    from . import moves as M

    white = white_to_move(fen)
    at = lambda c: M.with_castling(M.coordinates(c), F.col("_white"))
    df = rows.withColumn("_white", white).withColumn("target_uci", at(F.col(target)))
    df = df.withColumn("target_uci", F.coalesce(resolved(fen, "target_uci"), F.col("target_uci")))
    df = df.withColumn("_legal", F.transform(children_of(fen, F.transform(roots, at)), lambda x: x["move"]))
    has = F.col("target_uci").isNotNull()
    df = df.withColumn("in_root", F.when(has, F.array_contains("_legal", F.col("target_uci")).cast("int")))
    df = df.withColumn("anywhere", F.when(has, F.exists(every, lambda w: at(w) == F.col("target_uci")).cast("int")))
    return df.drop("_white", "_legal")
