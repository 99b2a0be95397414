"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21. A segment, padded to 23 bits, is decoded with
the perfect binary Golay code: exactly one of 4096 codewords lies within 3 bits of it, and where it is 3 away,
five more lie 4 away, which gives it one index to be found by and one or six to ask with. If two segments differ
in one bit or none, the codeword of the one is among those of the other.

Three differing bits over three segments leave either one segment equal and another with at most one error, or
one error in each. So two fingerprints with at most three differing bits always share a key: for each ordered
pair of segments the value of the first and an index of the second, or the indices of all three, of which each
side asks for some. Fingerprints
that share a key are compared in full, and a key hands on links that join its members, one fewer than members at
most, instead of all pairs. Keys are sorted by Spark, which can spill, and a worker holds a batch and the members of one key.

Defined results: nulls and texts without words have fingerprint zero, and link like any other; equal
fingerprints are one node, so copies are never paired; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from undertow.llm.arrow import map_rows
from undertow.llm.checkpoints import cut
from undertow.llm.components import components

#: Fixed value: the generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Bits of each segment, from the top of the fingerprint.
SEGMENTS = (22, 21, 21)


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a whole text: ASCII lower case, 3-word shingles with repeats, XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.array([xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda i, text: (i, (f := fingerprint(text)) - (f >> 63 << 64))

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", make)


class Golay:
    """Decoding tables of the (23, 12) code: the codeword nearest to each word, and those at distance 4."""

    def __init__(self):
        data = np.arange(4096, dtype=np.int64)
        words = np.zeros(4096, np.int64)
        for bit in range(12):
            words ^= np.where(data >> bit & 1, GENERATOR << bit, 0)
        self.words = words.astype(np.int32)
        pattern = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)]
        three = [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
        errors = np.array(pattern + three, np.int32)
        self.index = np.empty(1 << 23, np.uint16)
        self.index[self.words[:, None] ^ errors[None, :]] = np.arange(4096, dtype=np.uint16)[:, None]
        number = np.full(1 << 23, -1, np.int16)
        number[np.array(three)] = np.arange(len(three))
        self.number = number
        weight = np.bitwise_count(self.words)
        seven = self.words[weight == 7]
        # A codeword at distance 4 differs from the nearest by a codeword of weight 7 over all three errors.
        self.over = np.array([seven[seven & t == t] for t in three], np.int32)

    def ask(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and indices of all codewords within 4 bits of each segment."""
        nearest = self.index[segment]
        centre = self.words[nearest]
        which = self.number[segment ^ centre]
        rows = np.flatnonzero(which >= 0)
        more = self.index[centre[rows, None] ^ self.over[which[rows]]]
        return np.concatenate([np.arange(len(segment)), np.repeat(rows, 5)]), np.concatenate([nearest, more.reshape(-1)]).astype(np.int64)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, whether it asks) for an array of unsigned fingerprints; see the module's text."""
    code = golay()
    shift = np.cumsum(SEGMENTS[::-1])[::-1] - SEGMENTS[::-1][::-1]
    parts = [(fps >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(shift, SEGMENTS)]
    own = [code.index[p].astype(np.int64) for p in parts]
    asked = [code.ask(p) for p in parts]
    found, asks = [], []
    for a in range(3):
        for b in range(3):
            if a != b:
                tag = (3 * a + b) << 40
                found.append((tag | parts[a] << 12 | own[b], fps))
                rows, index = asked[b]
                asks.append((tag | parts[a][rows] << 12 | index, fps[rows]))
    # One error in each segment: the first two are asked for by the one side, the last by the other.
    tag = 15 << 40
    rows, index = asked[2]
    found.append((tag | own[0][rows] << 24 | own[1][rows] << 12 | index, fps[rows]))
    (rows0, index0), (rows1, index1) = asked[:2]
    order = np.argsort(rows1, kind="stable")
    many = np.bincount(rows1, minlength=len(fps))
    first = np.cumsum(many) - many
    each = many[rows0]
    of = np.repeat(np.arange(len(rows0)), each)
    at = order[first[rows0[of]] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)]
    asks.append((tag | index0[of] << 24 | index1[at] << 12 | own[2][rows0[of]], fps[rows0[of]]))
    key = np.concatenate([x[0] for x in found + asks])
    fp = np.concatenate([x[1] for x in found + asks])
    ask = np.zeros(len(key), bool)
    ask[sum(len(x[0]) for x in found) :] = True
    return key, fp, ask


def joining(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join the members of one key: each next member is met by those not yet met, all at once."""
    out, left = [], fps
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                out += [(int(at), int(x)) for x in left[near]]
                reached += left[near].tolist()
                left = left[~near]
                reached = [np.uint64(x) for x in reached]
    return out


def whole_groups(batches):
    """(key, fingerprint) arrays of sorted batches, cut where the group (the key but for its last bit) changes."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        at = int(np.searchsorted(key >> 1, key[-1] >> 1)) if len(key) else 0
        if at:
            yield key[:at], fp[:at]
            key, fp = key[at:], fp[at:]
    if len(key):
        yield key, fp


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all those at most ``bits`` (3 or fewer) apart."""
    if not 0 <= bits <= 3:
        raise ValueError("three segments find up to three differing bits")

    def expand(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fp = batch.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).view(np.uint64)
                key, fp, ask = keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key << 1 | ask), pa.array(fp.view(np.int64))], names=["key", "fp"])

    def compare(batches):
        import pyarrow as pa

        for key, fp in whole_groups(batches):
            group, fp = key >> 1, fp.view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = np.append(starts[1:], len(group))
            use = (ends - starts > 1) & (key[starts] & 1 == 0) & (key[ends - 1] & 1 == 1)  # found by some, asked for by some
            pairs: set[tuple[int, int]] = set()
            for a, b in zip(starts[use].tolist(), ends[use].tolist()):
                members = np.unique(fp[a:b])
                if len(members) > 1:
                    pairs.update(joining(members, bits))
            if pairs:
                both = np.array(sorted(pairs), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    spread = fps.select("fp").mapInArrow(expand, "key long, fp long").repartition(F.expr("shiftright(key, 1)")).sortWithinPartitions("key")
    return spread.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct, bits))
    groups = found.join(distinct, found["node"] == distinct["fp"]).select("component", "node", "first")
    heads = distinct.join(groups.select(F.col("component").alias("fp"), F.col("first").alias("of")), "fp").select("fp", F.least("first", "of").alias("least"))
    heads = heads.groupBy("fp").agg(F.min("least").alias("component_id"))
    members = groups.join(heads.withColumnRenamed("fp", "component"), "component").select(F.col("node").alias("fp"), "component_id")
    members = members.unionByName(heads)  # components() has no row for the smallest node of each
    named = distinct.join(members, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 3) -> DataFrame:
    """The document with the smallest doc_id of every component; all columns stay. Rows without doc_id stay, as do
    all rows that repeat the id that is kept."""
    kept = near_duplicates(docs, bits).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
