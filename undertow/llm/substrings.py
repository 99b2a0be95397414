"""Removal of repeated passages by difference-cover anchors.

A window is ``size`` consecutive words of one document; every word that lies in a window whose words also start
somewhere else, in the same document or another, goes. Windows are judged on the input.

Anchors of 15 words are hashed only where their position modulo 21 is in a cover of which every difference
modulo 21 is the difference of two members. For two equal windows of 35 words some offset below 21 puts both
starts into the cover, and the anchor there is inside both, so they share an aligned anchor. Each repeated anchor
is then extended to all windows around it, and these are compared by 96 bits of hash: first anchors, then
windows, are dealt out by hash once, and no pairs are made.

A passage that very many documents hold doesn't gather in one task: a task that scans texts passes on one row of
each hash it has seen more than once; the others are known to repeat and go elsewhere by chance.

Defined results: nulls and texts shorter than a window keep all words; a window that overlaps itself counts as
starting twice; an empty table gives no rows; texts are read whole. A text without doc_id keeps its words and
counts as nowhere else; rows that repeat an id share its places, so an id must not stand for different texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from undertow.llm.arrow import map_rows
from undertow.llm.checkpoints import table

#: A perfect difference cover of the integers modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1
#: Rows that a task gathers before it sorts them and passes them on.
GATHER = 1_500_000


def split(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8: what lies between blanks and the characters 9 to 13."""
    return (text or "").encode("utf-8").split()


class Rolling:
    """Hashes of all runs of ``size`` words in a row of word hashes, from sums of powers modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        if len(words) >= len(self.up):
            n = 2 * len(words) + 1
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.inverse, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.up[: len(words)])])
        h = (sums[starts + size] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def passed_on(hashes: list[np.ndarray], doc: np.ndarray, at: np.ndarray):
    """Rows for the exchange: hashes, doc, and place * 4 + state.

    State 0: seen once here. 1: seen more than once here, one row for all. 2: the others of these, which are
    known to repeat and carry a key of chance.
    """
    import pyarrow as pa

    order = np.lexsort(hashes[::-1])
    hashes, doc, at = [h[order] for h in hashes], doc[order], at[order]
    same = np.logical_and.reduce([h[1:] == h[:-1] for h in hashes])
    again = np.concatenate([[False], same])
    first = ~again & np.concatenate([same, [False]])
    key = hashes[0].copy()
    key[again] = (doc[again].astype(np.uint64) * np.uint64(BASES[0])) ^ (at[again].astype(np.uint64) * np.uint64(BASES[1]))
    place = at * 4 + np.where(again, 2, first)
    columns = [key.view(np.int64), *[h.view(np.int32)[::2] for h in hashes[1:]], doc, place]
    names = ["key", "check", "doc_id", "place"] if len(hashes) > 1 else ["key", "doc_id", "place"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def scan(docs: DataFrame, size: int, starts_of) -> DataFrame:
    """Hash the runs that ``starts_of`` picks in every document, and pass them on; see ``passed_on``.

    ``starts_of`` takes the number of words and the columns after the text, and gives starts. Runs are hashed
    ``size`` words long, by 64 bits if they only propose, by 96 if they decide.
    """
    wide = len(docs.columns) > 2

    def run(batches):
        rolls = [Rolling(b) for b in (BASES if wide else BASES[:1])]
        gathered, count = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] is None:
                    continue
                words = split(row[1])
                starts = starts_of(len(words), *row[2:])
                if len(starts):
                    w = word_hashes(words)
                    hashes = [roll(w, starts, size) for roll in rolls]
                    gathered.append((hashes, np.full(len(starts), row[0], np.int64), starts))
                    count += len(starts)
                if count >= GATHER:
                    yield flush(gathered)
                    gathered, count = [], 0
        if count:
            yield flush(gathered)

    def flush(gathered):
        return passed_on([np.concatenate(h) for h in zip(*(g[0] for g in gathered))], np.concatenate([g[1] for g in gathered]), np.concatenate([g[2] for g in gathered]))

    return docs.mapInArrow(run, "key long, check int, doc_id long, place long" if wide else "key long, doc_id long, place long")


def repeated(passed: DataFrame, name: str) -> DataFrame:
    """doc_id and the places of its rows whose hash came more than once, as the list ``name``. Rows come sorted, so a
    worker holds one batch, however large a partition or the group of one hash is."""

    def run(batches):
        import pyarrow as pa

        held = None  # the last row, whose next is still to come
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            place = columns[-1]
            sure = place & 3 == 2  # a scan has seen their hash twice and passes on one for all
            doc, at = [columns[-2][sure]], [place[sure]]
            rest = [c[~sure] for c in columns]
            if len(rest[0]):
                if held is not None:
                    rest = [np.concatenate([a, b]) for a, b in zip(held[0], rest)]
                *hashes, ids, places = rest
                same = np.logical_and.reduce([h[1:] == h[:-1] for h in hashes])
                known = np.concatenate([[held is not None and held[1]], same]) | np.concatenate([same, [False]]) | (places & 3 == 1)
                doc.append(ids[:-1][known[:-1]])
                at.append(places[:-1][known[:-1]])
                held = [c[-1:] for c in rest], bool(known[-1])
            yield places_of(pa, np.concatenate(doc), np.concatenate(at))
        if held is not None and held[1]:
            yield places_of(pa, held[0][-2], held[0][-1])

    def places_of(pa, doc, place):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array((place >> 2).astype(np.int32))], names=["doc_id", "at"])

    found = passed.repartition("key").sortWithinPartitions(*passed.columns[:-2]).mapInArrow(run, "doc_id long, at int")
    return found.groupBy("doc_id").agg(F.collect_list("at").alias(name))


BITS = 1 << 24


def marked(ids: DataFrame, column: str = "doc_id") -> bytes:
    """A bit for each value of a hash of the ids modulo ``BITS``: 2 MB at most, whatever the number of ids."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS))
    rows = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for part, bits in rows:
        out[4096 * (part - 1) : 4096 * part] = bits
    return bytes(out)


def around(n: int, anchors, size: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at an offset below the period."""
    if n < size:
        return np.empty(0, np.int64)
    mark = np.zeros(n + PERIOD + 2, np.int64)
    at = np.asarray(anchors, np.int64)
    at = at[at < n]
    np.add.at(mark, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(mark, at + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n - size + 1] > 0)


def strip(words: list[bytes], starts, size: int) -> list[bytes]:
    """The words that no window at ``starts`` covers."""
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.asarray(starts, np.int64)
    at = at[at + size <= len(words)]
    np.add.at(mark, at, 1)
    np.add.at(mark, at + size, -1)
    gone = np.cumsum(mark)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def remove_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by blanks) and kept_text where any went."""
    if size < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words or more")
    texts = docs.select("doc_id", "text")
    anchor = size - PERIOD + 1

    def covered(n):
        at = np.arange(n - anchor + 1 if n >= size else 0, dtype=np.int64)
        return at[np.isin(at % PERIOD, COVER)]

    anchors = table(repeated(scan(texts, anchor, covered), "anchors"))
    bits = marked(anchors)

    def judge():
        def row(i, text, bit):
            words = split(text)
            open_ = len(words) >= size and bits[bit >> 3] >> (bit & 7) & 1
            return i, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), text if open_ else None

        return row

    hashed = texts.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)))
    state = table(map_rows(hashed, "doc_id long, n_words long, kept_sha256 string, text string", judge))
    none = F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text")
    shut = state.where("text IS NULL").select("doc_id", "n_words", *none)
    open_ = table(state.where("text IS NOT NULL").select("doc_id", "text").join(anchors, "doc_id", "left"))
    windows = repeated(scan(open_.where("anchors IS NOT NULL"), size, lambda n, found: around(n, found, size)), "starts")

    def finish():
        def row(i, text, starts):
            words = split(text)
            if starts is None:
                return i, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), None
            kept = b" ".join(left := strip(words, starts, size))
            return i, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")

        return row

    done = map_rows(open_.select("doc_id", "text").join(windows, "doc_id", "left"), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", finish)
    return shut.unionByName(done)
