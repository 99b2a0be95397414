"""Packing documents into sequences of a fixed number of tokens, shortest pack first over the length histogram.

Every document is its token ids and one closing id. A document longer than a sequence is cut into full
sequences and a rest. Rests are packed by length only: from the histogram of lengths (at most ``size`` counts,
whatever the corpus), lengths are placed longest first, each into the shortest pack (the one with the most room),
or a new one where that is too full, and equal packs are one *pattern* with a count. Patterns then meet documents by rank: the k-th piece of a
length goes to the k-th place that the patterns have for it.

Defined results: a null text is an empty one and packs its closing id alone; equal texts are packed each; an
empty table gives no rows. Ranks order pieces of a length by salted groups of (doc_id, start), so that a length that a
third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from undertow.llm.arrow import map_chunks
from undertow.llm.bpe import CACHE, Encoder, byte_symbols
from undertow.llm.checkpoints import cut

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class LibraryEncoder(Encoder):
    """Ids by the BPE model of the tokenizers library, so that no automaton and no store of pre-tokens is held."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        self.symbols = {b: c for c, b in byte_symbols().items()}
        self.packed = [struct.pack("<I", i) for i in range(max(spec["model"]["vocab"].values()) + 1)]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a pre-token; the model takes a character for each of its bytes."""
        if piece.isascii() and piece.isprintable():
            word = piece.replace(" ", self.symbols[32])
        else:
            word = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        return b"".join([self.packed[t.id] for t in self.tokenize(word)])

    def learn(self, latin: set[str], rest: set[str]) -> None:
        known, one = self.known, self.piece_ids
        for u in latin:
            ps = self.latin_cut(u)
            known[u] = one(u) if len(ps) == 1 else b"".join(map(one, ps))
        for u in rest:
            known[u] = one(u)


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """The encoder of a vocabulary file, made once per Python worker."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocab_path: str, size: int = 2048, closing: int = 1, known: int = CACHE // 2, chunk: int = 2048) -> DataFrame:
    """Pieces of every document: full sequences, and a rest where one is left. ``known`` stretches and ``chunk`` texts
    at a time are a choice between memory and time; they change no result."""
    tail = closing.to_bytes(4, "little")

    def make():
        c = encoder(vocab_path)
        c.most_known = known

        def rows(doc_ids, texts):
            for i, ids in zip(doc_ids, c.encode_all(texts)):
                ids += tail
                n = len(ids) // 4
                for at in range(0, n, size):
                    cutout = ids[4 * at : 4 * (at + size)]
                    yield i, at, len(cutout) // 4, zlib.crc32(cutout), n

        return rows

    # Larger chunks than usual, as each looks its distinct stretches up once.
    return map_chunks(docs.select("doc_id", "text"), PIECE, make, chunk=chunk, chunk_bytes=4_000 * chunk)


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths longest first, count) that hold every length as often as the histogram says.

    Lengths go longest first into the shortest open pack, or a new one. All open packs of a pattern are
    one entry, so the work follows the number of patterns, not of pieces.
    """
    room: dict[int, list[list]] = {}  # room left -> [pattern, count]
    rooms: list[int] = []  # its keys, ascending

    def put(left: int, pattern: tuple[int, ...], count: int) -> None:
        if left not in room:
            rooms.insert(bisect_left(rooms, left), left)
            room[left] = []
        room[left].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            if not rooms or rooms[-1] < length:
                put(size - length, (length,), count)
                break
            left = rooms[-1]
            entry = room[left][-1]
            taken = min(entry[1], count)
            entry[1] -= taken
            if not entry[1]:
                room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop()
            put(left - length, entry[0] + (length,), taken)
            count -= taken
    return [(p, n) for found in room.values() for p, n in found]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length, runs of places (first rank, first sequence, count, offset), by rank; and the sequences used."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, count in sorted(patterns, reverse=True):
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            runs.setdefault(length, []).append((first, sequence, count, offset))
            used[length] = first + count
            offset += length
        sequence += count
    return runs, sequence


def pack(docs: DataFrame, vocab_path: str, size: int = 2048, closing: int = 1, **memory: int) -> DataFrame:
    """Place every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The driver sees the histogram of at most ``size`` lengths, the sizes of the salted groups of each (at most
    ``size`` times ``salts``) and the plan made from them. ``memory`` goes to ``pieces``.
    """
    salts = 32
    cuts = cut(pieces(docs, vocab_path, size, closing, **memory).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int")))
    groups = sorted(tuple(r) for r in cuts.groupBy("length", "salt").count().collect())
    histogram: dict[int, int] = {}
    before = []
    for length, salt, count in groups:
        before.append((length, salt, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + count
    runs, _ = places(plan(histogram, size))
    spark = docs.sparkSession
    first = F.broadcast(spark.createDataFrame(before, "length long, salt int, before long"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = cuts.join(first, ["length", "salt"]).select(*[c.split()[0] for c in PIECE.split(", ")], (F.col("before") + F.row_number().over(order) - 1).alias("rank"))

    def make():
        firsts = {length: [r[0] for r in found] for length, found in runs.items()}

        def rows(*columns):
            from bisect import bisect_right

            for *piece, rank in zip(*columns):
                at = bisect_right(firsts[piece[2]], rank) - 1
                start, sequence, _, offset = runs[piece[2]][at]
                yield (*piece, sequence + rank - start, offset)

        return rows

    return map_chunks(ranked, f"{PIECE}, sequence_id long, offset long", make, chunk=50_000, chunk_bytes=16_000_000)
