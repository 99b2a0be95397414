"""Media columns of baseline JPEG: payloads stored as coefficients, scans decoded, thumbnails of DC terms.

Stored form of a payload: a greyscale baseline image in which every 8x8 block holds 64 bytes, one for each quantized
coefficient in scan order, as its distance from ``MIDDLE``. Coefficients are coded as the standard says: categories
and extra bits, runs of zeros, ends of blocks, and canonical Huffman codes made from the image's own symbol
counts. Every block is a restart interval, so that blocks can be decoded side by side. The length of the
payload is in a comment segment; blocks that fill up the last row are zero.

Reading uses the file alone: markers, tables, then the Huffman decoder. Restart intervals of all files of a run of
rows are decoded at once by numpy, a symbol a step for each (``side_by_side``); scans with longer intervals
or several components are walked code by code, from the same lookup tables (``walk``).

Defined results: a null text is an empty one; the payload of an empty text is one block of zeros; equal texts give
equal files. Rows that repeat stay repeated; an empty table gives no rows. Long texts make large images, of 8,191
blocks a row at most, as many rows as needed up to 65,535 / 8; a text beyond that (over 4 GB) can't be a string here.
``features`` of a null, of a file that isn't a baseline JPEG, is cut short or holds codes that its tables lack
are null but for doc_id, n_bytes and, for a file, media_bytes and media_sha256.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame

from undertow.llm.arrow import map_chunks

#: The byte that is stored as zero: amid those of texts, so that most coefficients are small.
MIDDLE = 96


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of 1 to 16 for symbols by their counts; the code of all ones stays free."""
    while True:
        heap = [(n, symbol, None) for symbol, n in counts.items()] + [(0, 256, None)]  # 256: whose code is not used
        heapq.heapify(heap)
        number = 257
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], number, (a, b)))
            number += 1
        out, todo = {}, [(heap[0], 0)]
        while todo:
            (_, symbol, pair), depth = todo.pop()
            if pair:
                todo += [(pair[0], depth + 1), (pair[1], depth + 1)]
            else:
                out[symbol] = depth
        if max(out.values()) <= 16:
            break
        counts = {symbol: n + 1 >> 1 for symbol, n in counts.items()}
    # The longest code of all is the free one; where another symbol is as long, lengths stay as they are.
    longest = max(out.values())
    other = next((s for s, n in sorted(out.items()) if n == longest and s != 256), 256)
    out[other] = out[256]
    out.pop(256)
    return out


def table_of(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The body of a table (counts by length, then symbols) and (code, length) of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    many, codes, code, before = [0] * 16, {}, 0, 0
    for symbol in order:
        code <<= lengths[symbol] - before
        before = lengths[symbol]
        many[before - 1] += 1
        codes[symbol] = code, before
        code += 1
    return bytes(many) + bytes(order), codes


def shape(blocks: int) -> tuple[int, int]:
    """Blocks across and down."""
    across = min(8191, int(np.ceil(np.sqrt(blocks))))
    return across, -(-blocks // across)


def symbols(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol (-1: none), extra bits and their number for every place of blocks of coefficients."""
    size = np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int16)
    extra = np.where(v < 0, v + (1 << size.astype(np.int32)) - 1, v).astype(np.int64)
    symbol = size.copy()
    zero = v == 0
    zero[:, 0] = False
    if zero.any():
        place = np.arange(64, dtype=np.int16)
        last = np.maximum.accumulate(np.where(zero, 0, place), axis=1)  # the place of the last one that isn't zero
        end = last[:, -1:]
        before = np.concatenate([np.zeros((len(v), 1), np.int16), last[:, :-1]], axis=1)
        run = place - before - 1
        run[:, 0] = 0
        symbol += (run & 15) << 4
        # Sixteen zeros before another coefficient have a code; so have those up to the block's end.
        symbol = np.where(zero, np.where(place == end + 1, 0, np.where(((place - last) & 15 == 0) & (place < end), 0xF0, -1)), symbol)
    return symbol, extra, size


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Payloads, whose lengths are positive multiples of 64, as baseline JPEG files."""
    shapes = [shape(len(p) // 64) for p in payloads]
    total = np.array([a * d for a, d in shapes])
    first = np.concatenate([[0], np.cumsum(total)])
    v = np.zeros((first[-1], 64), np.int16)
    for p, at in zip(payloads, first.tolist()):
        v[at : at + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - MIDDLE
    symbol, extra, size = symbols(v)
    image = np.repeat(np.arange(len(payloads)), total)
    # Counts, tables and codes; the terms at place 0 have a table of their own.
    which = 2 * image[:, None] + (np.arange(64) > 0)
    at = (which << 8 | symbol)[symbol >= 0]
    counts = np.bincount(at, minlength=512 * len(payloads)).reshape(-1, 256)
    code, length, bodies = np.zeros(counts.size, np.int64), np.zeros(counts.size, np.int64), []
    for k, row in enumerate(counts):
        seen = np.flatnonzero(row)
        body, codes = table_of(code_lengths(dict(zip(seen.tolist(), row[seen].tolist()))))
        bodies.append(body)
        for s, (c, n) in codes.items():
            code[k << 8 | s], length[k << 8 | s] = c, n
    at = np.where(symbol >= 0, which << 8 | symbol, 0)
    many = np.where(symbol >= 0, length[at] + size, 0)
    value = np.where(symbol >= 0, code[at] << size | extra, 0)
    # Bits of a block, filled with ones to whole bytes; an entry has 27 bits at most and so touches four bytes.
    stop = np.cumsum(many, axis=1)
    start = stop - many
    widths = stop[:, -1] + 7 >> 3
    offset = np.cumsum(widths) - widths
    value = np.concatenate([value, ((1 << (8 * widths - stop[:, -1])) - 1)[:, None]], axis=1)
    start = np.concatenate([start, stop[:, -1:]], axis=1) + 8 * offset[:, None]
    many = np.concatenate([many, (8 * widths - stop[:, -1])[:, None]], axis=1)
    held = many > 0
    value, start, many = value[held], start[held], many[held]
    value <<= 32 - many - (start & 7)
    place = start >> 3
    size_all = int(widths.sum())
    scan = sum(np.bincount(place + k, weights=value >> 24 - 8 * k & 255, minlength=size_all + 4)[:size_all] for k in range(4)).astype(np.uint8)
    # Zeros after full bytes, and a mark after every block but an image's last.
    full = scan == 0xFF
    block = np.repeat(np.arange(len(widths)), widths)
    moved = np.arange(size_all) + np.cumsum(full) - full + 2 * block
    out = np.zeros(size_all + int(full.sum()) + 2 * len(widths), np.uint8)
    out[moved] = scan
    ends = offset + widths - 1
    marks = moved[ends] + 1 + full[ends]
    out[marks] = 0xFF
    out[marks + 1] = 0xD0 + (np.arange(len(widths)) - first[image]) % 8
    files = []
    for k, (p, (across, down)) in enumerate(zip(payloads, shapes)):
        begin = 0 if not first[k] else int(marks[first[k] - 1]) + 2
        files.append(b"".join((
            b"\xff\xd8",
            segment(0xFE, b"payload %d" % len(p)),
            segment(0xDB, bytes([0, *[1] * 64])),
            segment(0xC0, bytes([8, *(8 * down).to_bytes(2, "big"), *(8 * across).to_bytes(2, "big"), 1, 1, 0x11, 0])),
            segment(0xC4, b"\x00" + bodies[2 * k]),
            segment(0xC4, b"\x10" + bodies[2 * k + 1]),
            segment(0xDD, (1).to_bytes(2, "big")),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            out[begin : int(marks[first[k + 1] - 1])].tobytes(),
            b"\xff\xd9",
        )))
    return files


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


class Image:
    """A parsed baseline file: dimensions, tables, and the coded scan."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG: it doesn't start with SOI")
        self.tables: dict[int, dict[tuple[int, int], int]] = {}  # class and id -> (code length, code) -> symbol
        self.quant: dict[int, list[int]] = {}
        self.restart, self.comment, self.width, self.height, at = 0, b"", 0, 0, 2
        self.parts: list[tuple[int, int, int, int]] = []
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xC4:
                self.read_huffman(body)
            elif marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    self.quant[body[0] & 15] = [int.from_bytes(body[1 + wide * i : 1 + wide * (i + 1)], "big") for i in range(64)]
                    body = body[1 + 64 * wide :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                self.using = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 0x10 + (body[2 + 2 * i] & 15)) for i in range(body[0])}
                break
        coded = np.frombuffer(data, np.uint8, offset=at)
        full = np.flatnonzero(coded[:-1] == 0xFF)
        after = coded[full + 1]
        end = full[(after != 0) & ~((0xD0 <= after) & (after <= 0xD7))]
        stop = int(end[0]) if len(end) else len(coded)
        keep = full < stop
        full, after = full[keep], after[keep]
        self.marks = full[after != 0]  # where restarts stand
        gone = np.concatenate([full[after == 0] + 1, self.marks, self.marks + 1])
        self.scan = np.delete(coded[:stop], gone)
        self.marks = self.marks - np.searchsorted(np.sort(gone), self.marks)

    def read_huffman(self, body: bytes) -> None:
        while body:
            counts, at, code = body[1:17], 17, 0
            table = self.tables[body[0]] = {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table[length, code] = body[at]
                    code += 1
                    at += 1
                code <<= 1
            body = body[at:]

    def lookup(self, name: int) -> tuple[np.ndarray, int]:
        """Symbol * 32 + code length by the next bits, as many as the longest code has; 0 where no code fits."""
        table = self.tables[name]
        most = max(length for length, _ in table)
        out = np.zeros(1 << most, np.int32)
        for (length, code), symbol in table.items():
            out[code << most - length : code + 1 << most - length] = symbol << 5 | length
        return out, most

    def units(self) -> int:
        """Blocks of one component, or groups of blocks of several."""
        if len(self.parts) == 1:
            return -(-self.width // 8) * -(-self.height // 8)
        return -(-self.width // (8 * max(p[1] for p in self.parts))) * -(-self.height // (8 * max(p[2] for p in self.parts)))

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the restart intervals of the scan start and end."""
        edges = np.concatenate([[0], self.marks, [len(self.scan)]])
        return edges[:-1], edges[1:]

    def walk(self) -> np.ndarray:
        """Quantized coefficients of the first (luminance) component, a row of 64 for each block in scan order, by
        reading code after code. For any baseline scan."""
        order = [0] if len(self.parts) == 1 else [k for k, p in enumerate(self.parts) for _ in range(p[1] * p[2])]
        found = {name: self.lookup(name) for part in self.parts for name in self.using[part[0]]}
        tables = [[(found[n][0].tolist(), found[n][1]) for n in self.using[p[0]]] for p in self.parts]
        out, left = [], self.units()
        for a, b in zip(*(x.tolist() for x in self.intervals())):
            data = self.scan[a:b].tobytes()
            bits, have, at = 0, 0, 0
            before = [0] * len(self.parts)

            def entry(table, most):
                nonlocal bits, have, at
                while have < 32 and at < len(data) + 8:
                    bits = (bits << 8 | (data[at] if at < len(data) else 0xFF)) & 0xFFFFFFFFFFFF
                    have, at = have + 8, at + 1
                x = table[bits >> have - most & (1 << most) - 1]
                if not x:
                    raise ValueError("no such Huffman code")
                have -= x & 31
                size = x >> 5 & 15
                v = bits >> have - size & (1 << size) - 1
                have -= size
                return x >> 5, v if not size or v >> size - 1 else v - (1 << size) + 1

            for _ in range(min(self.restart or left, left)):
                left -= 1
                for k in order:
                    dc, ac = tables[k]
                    block = [0] * 64
                    before[k] += entry(*dc)[1]
                    block[0], i = before[k], 1
                    while i < 64:
                        s, v = entry(*ac)
                        if not s & 15 and s != 0xF0:
                            break
                        i += s >> 4
                        if i > 63:
                            raise ValueError("a run leaves its block")
                        block[i] = v
                        i += 1
                    if k == 0:
                        out.append(block)
            if 8 * at - have > 8 * len(data):
                raise ValueError("the scan is cut short")
        if left:
            raise ValueError("the scan is cut short")
        return np.array(out, np.int16)

    def thumbnail(self, blocks: np.ndarray) -> np.ndarray:
        """Luminance of each block, from its DC term: the image at an eighth of its size."""
        step = self.quant[self.parts[0][3]][0]
        grey = np.clip(blocks[:, 0].astype(np.int32) * step // 8 + 128, 0, 255).astype(np.uint8)
        h, v = (1, 1) if len(self.parts) == 1 else self.parts[0][1:3]
        if (h, v) == (1, 1):
            across = -(-self.width // 8) if len(self.parts) == 1 else -(-self.width // (8 * max(p[1] for p in self.parts)))
            return grey.reshape(-1, across)
        across = -(-self.width // (8 * h))
        return grey.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)


def thumbnail_hash(grey: np.ndarray) -> str:
    """Difference hash of a thumbnail: 64 bits that say whether each of 8x9 cells is darker than the next."""
    rows = np.arange(8) * grey.shape[0] // 8
    columns = np.arange(9) * grey.shape[1] // 9
    small = grey[np.ix_(rows, columns)].astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def side_by_side(images: list[Image]) -> list[np.ndarray | None]:
    """``walk`` of images of one component whose restart intervals are single blocks, all blocks at once; None for
    those whose scan is damaged."""
    lanes, starts, stops, tables, data, shift = [], [], [], [], [], 0
    for k, image in enumerate(images):
        a, b = image.intervals()
        lanes.append(len(a))
        starts.append(a + shift)
        stops.append(b + shift)
        tables.append([image.lookup(name) for name in image.using[image.parts[0][0]]])
        data.append(image.scan)
        shift += len(image.scan)
    joint = np.concatenate([*data, np.full(300, 0xFF, np.uint8)]).astype(np.int64)
    window = joint[:-4] << 32 | joint[1:-3] << 24 | joint[2:-2] << 16 | joint[3:-1] << 8 | joint[4:]  # 40 bits from each byte on
    lookup = np.concatenate([t for pair in tables for t, _ in pair])
    sizes = np.array([len(t) for pair in tables for t, _ in pair])
    origin, most = np.cumsum(sizes) - sizes, np.array([n for pair in tables for _, n in pair])
    image = np.repeat(np.arange(len(images)), lanes)
    at = 8 * np.concatenate(starts)
    stop = 8 * np.concatenate(stops)
    out, bad = np.zeros((len(at), 64), np.int16), np.zeros(len(at), bool)
    live, place = np.arange(len(at)), np.zeros(len(at), np.int64)
    base, width = origin[2 * image], most[2 * image]
    first = True
    while len(live):
        p = at[live]
        bits = window[p >> 3] >> 8 - (p & 7) & 0xFFFFFFFF
        x = lookup[base + (bits >> 32 - width)]
        code, size = x & 31, x >> 5 & 15
        value = bits >> 32 - code - size & (1 << size) - 1
        value = np.where(value >> np.maximum(size - 1, 0) > 0, value, np.where(size > 0, value - (1 << size) + 1, 0))
        at[live] = p = p + code + size
        symbol = x >> 5
        to = place if first else place + (symbol >> 4)
        wrong = (code == 0) | (to > 63) | (p > stop[live])
        ends = (symbol == 0) & (not first) | wrong
        bad[live[wrong]] = True
        keep = ~ends
        out[live[keep], to[keep]] = value[keep]
        keep &= to < 63
        live, place = live[keep], to[keep] + 1
        if first:
            base, width, first = origin[2 * image + 1][live], most[2 * image + 1][live], False
        else:
            base, width = base[keep], width[keep]
    edge = np.cumsum(lanes) - lanes
    return [None if bad[e : e + n].any() or n != im.units() else out[e : e + n] for im, e, n in zip(images, edge.tolist(), lanes)]


def decode_many(files: list[bytes | None]) -> list[tuple[Image, np.ndarray] | None]:
    """The parsed form and the blocks of every file; None for nulls and what can't be decoded."""
    images: list[Image | None] = []
    for data in files:
        try:
            images.append(Image(data) if data is not None else None)
        except (ValueError, IndexError, KeyError):
            images.append(None)
    out: list[tuple[Image, np.ndarray] | None] = [None] * len(files)
    single = [k for k, im in enumerate(images) if im and len(im.parts) == 1 and im.restart == 1 and len(im.marks)]
    for k, blocks in zip(single, side_by_side([images[k] for k in single]) if single else ()):
        out[k] = None if blocks is None else (images[k], blocks)
    for k in set(range(len(files))) - set(single):
        if images[k]:
            try:
                out[k] = images[k], images[k].walk()
            except (ValueError, IndexError, KeyError):
                pass
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8")
    return len(data), data + bytes(-len(data) % 64 if data else 64)


def stored(image: Image, blocks: np.ndarray) -> bytes | None:
    """The payload that a file of ``encode`` holds; None for other files."""
    words = image.comment.split()
    if len(words) != 2 or words[0] != b"payload" or not words[1].isdigit() or int(words[1]) > blocks.size:
        return None
    return (blocks + MIDDLE).astype(np.uint8).tobytes()[: int(words[1])]


def read(media: bytes) -> tuple[bytes, Image, np.ndarray]:
    """The payload stored in a file, its parsed form and its blocks."""
    (found,) = decode_many([media])
    if found is None:
        raise ValueError("this file can't be decoded")
    return stored(*found), *found


def store(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes and the binary column ``media``."""

    def make():
        def rows(ids, texts):
            payloads = [payload_of(t) for t in texts]
            return [(i, n, m) for i, (n, _), m in zip(ids, payloads, encode_many([p for _, p in payloads]))]

        return rows

    return map_chunks(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", make, **SIZES)


def features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash and digests of every row of ``store``, or of other files, from the stored bytes."""
    return map_chunks(media.select("doc_id", "n_bytes", "media"), FEATURES, lambda: lambda ids, ns, files: feature_rows(ids, ns, [None if m is None else bytes(m) for m in files]), **SIZES)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"
#: Rows and bytes of texts to a run: the arrays of a run take some hundred times its bytes.
SIZES = {"chunk": 512, "chunk_bytes": 500_000}


def feature_rows(ids, ns, files: list[bytes | None]) -> list[tuple]:
    out = []
    for i, n, data, found in zip(ids, ns, files, decode_many(files)):
        file = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
        if found is None:
            out.append((i, n, None, None, None, *file, None, None, None))
            continue
        image, blocks = found
        payload = stored(image, blocks)
        digests = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        out.append((i, n, *digests, *file, f"{image.width}x{image.height}:{thumbnail_hash(image.thumbnail(blocks))}", image.width, image.height))
    return out


def store_and_read(docs: DataFrame) -> DataFrame:
    """``features`` of ``store`` in one pass, so that the files needn't be shipped between two."""

    def make():
        def rows(ids, texts):
            payloads = [payload_of(t) for t in texts]
            return feature_rows(ids, [n for n, _ in payloads], encode_many([p for _, p in payloads]))

        return rows

    return map_chunks(docs.select("doc_id", "text"), FEATURES, make, **SIZES)
