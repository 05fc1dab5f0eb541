"""Best-fit packing by bin completion with branch and bound.

Documents become token ids and an end id. Only those longer than a sequence are cut,
from the back, so that the first piece is the short one. What is packed is the
histogram of piece lengths: at most one counter a length, however many documents there
are. The whole best-fit decreasing packing is the first incumbent, and where it has as many bins as a lower bound
asks for, it is taken. Else the driver branches over bins: around the largest length left it enumerates undominated fillings, prunes them by the waste
they must leave, and tries the fullest, the best-fit one and the fullest without the first one's largest piece, each as often as the counters
allow. A node is given up when its bins and the lower bound of what is left are no better than the incumbent; best-fit packings of what is
left give new incumbents on the way. The search over bins has a budget, so it may end above the optimum, but never above best-fit. Within a bin, too, the search has a
budget; where it ends with waste, the sums that the lengths left can reach tell the least waste, and a filling with it is taken. Pieces
then find their bin through their rank among the pieces of their length.

Defined results: a null text is empty; an empty text is one piece, the end id; a very long text is
encoded whole, runs of 100,000 blanks and more as one word each, and cut; rows that repeat are packed each; pieces of a length
are ordered by doc_id, piece and ids_crc32, and where all of these tie they are alike; an empty table gives no rows. A null doc_id is ranked first. Only doc_id and text
are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets_for, lean, written

LENGTH = 2048
END_ID = 0
#: Fillings tried for one bin, beyond the best-fit one, and how many pieces deep, before the reachable sums are asked.
NODES = 4000
DEPTH = 6
#: Bins that are branched over, and how many of them share one best-fit packing of the rest.
BRANCHES, PROBES = 3000, 16

#: Characters on which the splitters of both libraries agree without doubt.
PLAIN = r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧]"


#: Blanks in a row from which a run is encoded by itself: the fast splitter recurses over it.
LONG_BLANK = re.compile(r"[ \t\n\r]{100000,}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of the tokenizer in a ``tokenizers`` file.

    A byte-level BPE whose merges are in the order of their ids gives the same ids through ``tiktoken``, which
    is about four times as fast; texts with characters outside PLAIN and other models
    go through ``tokenizers``.
    """

    def __init__(self, path: str):
        self.path = path
        self.odd = re.compile(PLAIN)
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranks(json.load(f))

    @functools.cached_property
    def slow(self):
        """Loaded only where a text needs it: a worker's memory holds one vocabulary then."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True
        return model

    @staticmethod
    def _ranks(spec: dict):
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        if [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if i not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None:
            return self._part(text)
        out, at = [], 0
        for m in LONG_BLANK.finditer(text):
            start, end = m.span()
            if text[max(0, start - 1) : start].isspace() or text[end : end + 1].isspace():
                continue  # other white space beside it belongs to the run: an odd text
            end -= end < len(text)  # the last blank goes with what follows
            out += self._part(text[at:start])
            out += self.fast._encode_single_piece(text[start:end])
            at = end
        return out + self._part(text[at:])

    def _part(self, text: str) -> list[int]:
        if self.fast is None or self.odd.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces_of(ids, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be short, the others are full."""
    first = len(ids) % length or length
    return [(0, min(first, len(ids)))] + [(s, length) for s in range(first, len(ids), length)]


def _encode(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    import zlib

    encode = Encoder(path)
    for batch in lean(batches):
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.asarray([*encode(text.as_py() or ""), end_id], dtype="<u4")
            for k, (start, n) in enumerate(pieces_of(ids, length)):
                for column, x in zip(out, (doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    f = functools.partial(_encode, path=path or default_tokenizer(), length=length, end_id=end_id)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(f, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bins:
    """Which lengths are left, with the largest one up to a given length at hand."""

    counts: list[int]
    below: list[int] = field(init=False)

    def __post_init__(self):
        self.below = list(range(len(self.counts)))

    def largest(self, most: int) -> int:
        """The largest length left that is at most ``most``, or 0. Lengths that ran out are skipped for good."""
        at = most
        while at > 0 and self.counts[at] <= 0:
            up = self.below[at - 1] if self.counts[at - 1] <= 0 and at > 1 else at - 1
            self.below[at] = up
            at = up
        return max(at, 0)


def complete(bins: Bins, room: int, first: int, nodes: int = NODES, depth: int = DEPTH, largest: int | None = None) -> list[int]:
    """Lengths, of ``largest`` at most, that fill ``room`` beside ``first`` with the least waste found; descending.

    Longer pieces are tried first: swapping pieces of a filling for one longer piece that
    leaves no more waste dominates it. A branch ends when even its largest pieces, as many
    as may follow, leave more waste than the incumbent.
    """
    best: list[int] = []
    used: dict[int, int] = {first: 1}
    top = room if largest is None else min(room, largest)
    left, most = room, top
    while (x := _free(bins, used, min(left, most))) > 0:  # the best-fit filling, piece by piece
        best.append(x)
        used[x] = used.get(x, 0) + 1
        left -= x
        most = x
    waste, budget = left, nodes
    used = {first: 1}

    def search(left: int, most: int, chosen: list[int]) -> None:
        nonlocal best, waste, budget
        if left < waste:
            best, waste = list(chosen), left
        more = depth - len(chosen)
        x = _free(bins, used, min(left, most))
        while x > 0 and more and waste and budget > 0 and left - more * x < waste:
            budget -= 1
            used[x] = used.get(x, 0) + 1
            chosen.append(x)
            search(left - x, x, chosen)
            chosen.pop()
            used[x] -= 1
            x = _free(bins, used, x - 1)

    if waste:
        search(room, top, [])
    return least_waste(bins, room, first, top) if waste else best


def greedy(bins: Bins, room: int, first: int) -> list[int]:
    """The best-fit filling: the largest piece that fits, again and again."""
    out, used = [], {first: 1}
    while (x := _free(bins, used, min(room, out[-1] if out else room))) > 0:
        out.append(x)
        used[x] = used.get(x, 0) + 1
        room -= x
    return out


def least_waste(bins: Bins, room: int, first: int, largest: int | None = None) -> list[int]:
    """Lengths that fill ``room`` beside ``first`` as far as any do, the largest pieces first; descending.

    A number's bits are the sums that can be reached; one is kept per length, so that a filling can be read off.
    """
    lengths = [x for x in range(1, (room if largest is None else min(room, largest)) + 1) if bins.counts[x] - (x == first) > 0]
    every, reached = (1 << (room + 1)) - 1, [1]
    for x in lengths:
        sums, left, step = reached[-1], min(bins.counts[x] - (x == first), room // x), 1
        while left > 0:  # copies in powers of two
            n = min(step, left)
            sums |= (sums << (x * n)) & every
            left -= n
            step *= 2
        reached.append(sums)
    rest, out = reached[-1].bit_length() - 1, []
    for k in range(len(lengths) - 1, -1, -1):
        x = lengths[k]
        n = min(bins.counts[x] - (x == first), rest // x)
        while not reached[k] >> (rest - n * x) & 1:
            n -= 1
        out += [x] * n
        rest -= n * x
    return out


def _free(bins: Bins, used: dict[int, int], most: int) -> int:
    x = bins.largest(most) if most > 0 else 0
    while x > 0 and bins.counts[x] <= used.get(x, 0):
        x = bins.largest(x - 1) if x > 1 else 0
    return x


Packed = list[tuple[list[int], int]]


def best_fit(counts: list[int], length: int) -> Packed:
    """Best-fit decreasing on a histogram: bins that are alike are one entry, so there are about two a length."""
    rooms: dict[int, Packed] = {}  # room left: bins
    order: list[int] = []  # the rooms, ascending
    for x in range(length, 0, -1):
        left = counts[x]
        at = bisect.bisect_left(order, x)
        while left > 0 and at < len(order):  # the fullest bins that have room, each filled before the next
            room = order[at]
            group = rooms[room]
            filling, times = group.pop()
            if not group:
                del rooms[room]
                order.pop(at)
            each = room // x
            whole = min(times, left // each)
            rest = left - whole * each if whole < times else 0
            moved = [([*filling, *[x] * each], whole)] if whole else []
            if rest:  # one bin takes what is left
                moved.append(([*filling, *[x] * rest], 1))
            for new, n in moved:
                _put(rooms, order, length - sum(new), new, n)
            if whole + bool(rest) < times:
                _put(rooms, order, room, filling, times - whole - bool(rest))
            left -= whole * each + rest
            at = bisect.bisect_left(order, x)
        each = length // x
        if left >= each:
            _put(rooms, order, length - x * each, [x] * each, left // each)
        if left % each:
            _put(rooms, order, length - x * (left % each), [x] * (left % each), 1)
    return [b for group in rooms.values() for b in group]


def _put(rooms: dict[int, Packed], order: list[int], room: int, filling: list[int], times: int) -> None:
    if room not in rooms:
        rooms[room] = []
        bisect.insort(order, room)
    rooms[room].append((filling, times))


def lower_bound(counts: list[int], length: int) -> int:
    """Bins that any packing needs: for each threshold, pieces that leave less than it stand alone, and the smaller ones have to fit beside the larger ones."""
    n = np.asarray(counts, dtype=np.int64)
    size = n * np.arange(length + 1)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)])  # below each length
    half, k = length // 2, np.arange(length // 2 + 1)
    alone = count[length + 1] - count[length - k + 1]
    large, in_large = count[length - k + 1] - count[half + 1], total[length - k + 1] - total[half + 1]
    small = total[half + 1] - total[np.maximum(k, 1)]
    return int((alone + large + np.maximum(0, -((large * length - in_large - small) // length))).max(initial=0))


def bins_of(packed: Packed) -> int:
    return sum(n for _, n in packed)


def _fillings(bins: Bins, length: int) -> list[tuple[list[int], int]]:
    """Fillings around the largest length left, the fullest first, with how often the counters allow each."""
    first = bins.largest(length)
    room = length - first
    full = complete(bins, room, first)
    others = [greedy(bins, room, first)]
    if full:
        others.append(complete(bins, room, first, largest=full[0] - 1))
    out = []
    for filling in dict.fromkeys(tuple(x) for x in [full, *others]):
        whole = [first, *filling]
        out.append((whole, min(bins.counts[x] // whole.count(x) for x in set(whole))))
    return out


def branch_over_bins(counts: list[int], length: int, incumbent: Packed, bound: int, budget: int = BRANCHES) -> Packed:
    """The best packing found; ``incumbent``, if none is better. Depth first, so that the last bins are varied first."""
    best, fewest = incumbent, bins_of(incumbent)
    chosen: Packed = []
    stack: list[list] = [[Bins(list(counts)), 0, None]]  # counters, bins so far, fillings yet to try
    while stack and budget > 0 and fewest > bound:
        bins, used, options = stack[-1]
        if options is None:
            first = bins.largest(length)
            if used + lower_bound(bins.counts, length) >= fewest:
                options = []
            elif len(stack) % PROBES == 1 and used + bins_of(rest := best_fit(bins.counts, length)) < fewest:
                best = [*chosen, *rest]
                fewest = bins_of(best)
                continue
            else:
                budget -= 1
                options = _fillings(bins, length) if first else []
            if not first and used < fewest:
                best, fewest = list(chosen), used
            stack[-1][2] = options = options[::-1]
        if not options:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        filling, times = options.pop()
        left = list(bins.counts)
        for x in filling:
            left[x] -= times
        chosen.append((filling, times))
        stack.append([Bins(left), used + times, None])
    return best


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> Packed:
    """Bins as (lengths descending, times); their number is bounded by the lengths, not by the counts."""
    left = [0] * (length + 1)
    for n, c in counts.items():
        if not 0 < n <= length:
            raise ValueError(f"a piece of {n} tokens doesn't fit {length}")
        left[n] += c
    incumbent, bound = best_fit(left, length), lower_bound(left, length)
    return incumbent if bins_of(incumbent) == bound else branch_over_bins(left, length, incumbent, bound)


def slots(packed: Packed) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies a sequence, offset of the first copy)."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in packed:
        offset = 0
        for x in sorted(set(filling), reverse=True):
            n = filling.count(x)
            start = ranks.get(x, 0)
            ranks[x] = start + n * times
            out.append((x, start, start + n * times, sequence, n, offset))
            offset += n * x
        sequence += times
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, path, length, end_id), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``length`` rows
    table = slots(pack_histogram(counts, length))
    plan = spark.createDataFrame(table, "length long, low long, high long, first_sequence long, copies long, first_offset long")
    buckets = buckets_for(max(counts.values(), default=0))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("done") + F.row_number().over(inside) - 1)
    # the plan's rows are bounded by the lengths, not by the documents
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("copies") * ranked["length"]).cast("long").alias("offset"),
    )
