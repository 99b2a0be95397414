"""Byte-pair encoding and decoding by dynamic programming over prefixes.

The encoding of a piece is a path of vocabulary tokens in which every two neighbours are *compatible*: running
the merges on the two joined would leave the border between them alone. For every prefix of a piece exactly one
token can be the last of such a path. So one pass over the piece, asking an automaton of the vocabulary (whose state is the
longest suffix read that begins a token, after Aho and Corasick) which tokens end at each byte, longest first, stores that
token for each prefix, and following the stored tokens backwards from the end gives the ids.

Nulls count as empty text; an empty text has no ids; rows that repeat are encoded each; an empty table gives no rows.
Texts are encoded whole, very long ones too. Equal pieces are encoded once per
worker; stores hold ``CACHE`` entries at most between chunks and some, which bounds memory and changes no result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct

from pyspark.sql import DataFrame

from undertow.llm.arrow import map_chunks

CACHE = 900_000

#: The White_Space characters of Unicode, which are what \s means in the vocabulary's pattern.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokenization pattern of byte-level BPE, with \s spelled out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters for which the plainer pattern below cuts alike: ASCII without most controls, and Latin-1 letters.
LATIN = r"\n\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_PIECES = r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as character -> byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Cuts texts at the borders of pre-tokens and keeps the ids of the stretches between, which ``learn`` finds."""

    #: Stretches whose ids are kept, and as many older ones beside them.
    most_known = CACHE // 2

    def __init__(self, spec: dict):
        import regex

        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {word: struct.pack("<I", i) for word, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(w) for w in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.any_pieces = regex.compile(PIECES)
        self.latin_pieces = re.compile(LATIN_PIECES)
        self.not_latin = re.compile(f"[^{LATIN}]")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, latin: set[str], rest: set[str]) -> None:
        """Put the ids of plain Latin stretches, and of other pre-tokens, into ``known``."""
        raise NotImplementedError

    def units(self, text: str) -> tuple[list[str], bool]:
        """Stretches of a text that start and end at pre-token borders; whether they hold plain Latin only."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.not_latin.search(text):
            return self.any_pieces.findall(text), False
        # Single blanks and line ends only: a pre-token starts at each, so the stretches between are independent.
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01"), True

    def latin_cut(self, unit: str) -> list[str]:
        """Pre-tokens of a plain Latin stretch; words, and words before a stop, without the pattern."""
        if unit.isalpha() or unit[1:].isalpha() and unit[0] == " ":
            return [unit]
        if unit[-1] in ".," and unit[1:-1].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return [unit[:-1], unit[-1]]
        return self.latin_pieces.findall(unit)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers. The stretches make no cycles, and looking for
        some among them would take a sixth of the time."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_all(self, texts: list[str | None]) -> list[bytes]:
        parts: list[list[str]] = []  # of each text: stretches between added tokens, and these
        for text in texts:
            if text and self.split_added and any(w in text for w in self.added):
                parts.append([p for p in self.split_added.split(text) if p])
            else:
                parts.append([text] if text else [])
        cut = [[([p], True) if p in self.added else self.units(p) for p in x] for x in parts]
        if len(self.known) >= self.most_known:
            # Frequent stretches come back from the older half.
            self.older, self.known = self.known, {}
        known = self.known
        known.update(self.added)
        known[""] = b""
        latin = set().union(*[units for x in cut for units, plain in x if plain]).difference(known)
        rest = set().union(*[units for x in cut for units, plain in x if not plain]).difference(known)
        if self.older:
            known.update([(u, self.older[u]) for u in (latin | rest).intersection(self.older)])
            latin, rest = latin.difference(known), rest.difference(known)
        self.learn(latin, rest)
        get = known.__getitem__
        return [b"".join([b"".join(map(get, units)) for units, _ in x]) for x in cut]

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text."""
        return self.encode_all([text])[0]

class Codec(Encoder):
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        symbol = byte_symbols()
        ids = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for word, i in ids.items():
            self.bytes_of[i] = bytes(symbol[c] for c in word)
        self.pair: dict[tuple[int, int], int] = {}  # two ids -> rank of their merge
        self.parts: dict[int, tuple[int, int]] = {}  # id -> the two ids it is merged from
        self.rank = [-1] * len(self.bytes_of)
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids[left + right]
            self.pair[ids[left], ids[right]] = r
            self.parts[whole] = ids[left], ids[right]
            self.rank[whole] = r
        self.build_automaton(ids.values())
        for word, i in added.items():
            self.bytes_of[i] = word.encode()
        self.fits: dict[int, bool] = {}
        self.go: dict[int, int] = {}
        self.piece: dict[str, bytes] = {}

    def build_automaton(self, tokens) -> None:
        """Automaton whose state is the longest suffix read so far that starts a token; ``ends`` lists the tokens
        that end there, as (length, id), longest first."""
        self.step: list[dict[int, int]] = [{}]
        own: list[tuple] = [()]
        for i in tokens:
            at = 0
            for byte in self.bytes_of[i]:
                nxt = self.step[at].get(byte)
                if nxt is None:
                    nxt = self.step[at][byte] = len(self.step)
                    self.step.append({})
                    own.append(())
                at = nxt
            own[at] = ((len(self.bytes_of[i]), i),)
        self.back = [0] * len(self.step)
        self.ends = own
        level = list(self.step[0].values())
        while level:
            deeper = []
            for at in level:
                self.ends[at] = own[at] + self.ends[self.back[at]]
                for byte, nxt in self.step[at].items():
                    b = self.back[at]
                    while b and byte not in self.step[b]:
                        b = self.back[b]
                    self.back[nxt] = self.step[b].get(byte, 0)
                    deeper.append(nxt)
            level = deeper

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at one edge of a token while it is merged, each with the rank that ends it."""
        chain, until = [], float("inf")
        while True:
            chain.append((token, until))
            if token not in self.parts:
                return chain
            until = self.rank[token]
            token = self.parts[token][side]

    def compatible(self, key: int) -> bool:
        """Whether merging the bytes of two tokens (a in the high half of the key, b in the low one) keeps their
        border: no merge across it comes before both are whole.

        Of equal merges the leftmost comes first: a symbol of a is then used up by its own left neighbour, a
        symbol of b by the merge across.
        """
        right, out = self.edge(key & 0xFFFFFFFF, 0), True
        for x, x_until in self.edge(key >> 32, 1):
            for y, y_until in right:
                r = self.pair.get((x, y))
                if r is not None and self.rank[x] < r < x_until and self.rank[y] < r <= y_until:
                    out = False
        self.fits[key] = out
        return out

    def move(self, state: int, byte: int) -> int:
        """The automaton's next state, kept for the next time."""
        at = state
        while at and byte not in self.step[at]:
            at = self.back[at]
        if len(self.go) >= 4 * CACHE:
            self.go.clear()
        out = self.go[state << 8 | byte] = self.step[at].get(byte, 0)
        return out

    def learn(self, latin: set[str], rest: set[str]) -> None:
        known, stored = self.known, self.piece
        if len(stored) >= CACHE:
            stored.clear()
        new = dict(zip(latin, map(self.latin_cut, latin)))
        new.update((u, [u]) for u in rest)
        self.encode_pieces(set().union(*new.values()).difference(stored))
        for u, ps in new.items():
            known[u] = stored[ps[0]] if len(ps) == 1 else b"".join([stored[p] for p in ps])

    def encode_pieces(self, pieces: set[str]) -> None:
        """Store the ids of pre-tokens. Sorted, each starts with the tokens that its predecessor's prefix ended in."""
        go, ends, fits, compatible, stored = self.go, self.ends, self.fits, self.compatible, self.piece
        if len(fits) >= CACHE:
            fits.clear()
        states, ids, lengths = [0], [-1], [0]  # for each prefix: automaton state, its last token, that token's length
        before = b""
        for data, piece in sorted([(p.encode("utf-8", "surrogatepass"), p) for p in pieces]):
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], ids[same + 1 :], lengths[same + 1 :]
            state = states[same]
            i = same
            for byte in data[same:]:
                i += 1
                key = state << 8 | byte
                state = go[key] if key in go else self.move(state, byte)
                for length, token in ends[state]:
                    if length == i:
                        break
                    key = ids[i - length] << 32 | token
                    if fits[key] if key in fits else compatible(key):
                        break
                states.append(state)
                ids.append(token)
                lengths.append(length)
            before = data
            out, at = [], len(data)
            while at:
                out.append(ids[at])
                at -= lengths[at]
            out.reverse()
            stored[piece] = struct.pack(f"<{len(out)}I", *out)

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        table = self.bytes_of
        return b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, made once per Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``ids``, little-endian unsigned 32-bit integers."""

    def make():
        enc = codec(vocab_path).encode_all
        return lambda ids, texts: zip(ids, enc(texts))

    return map_chunks(docs.select(id_col, text_col), f"{id_col} long, ids binary", make)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encode``: its id and the decoded ``text``."""

    def make():
        dec = codec(vocab_path).decode
        return lambda ids, values: zip(ids, [dec(bytes(v)) for v in values])

    return map_chunks(encoded.select(id_col, "ids"), f"{id_col} long, text string", make)


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Encode every text, decode its ids, and give digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Both directions share one pass, so the ids of the corpus are never written between them.
    """

    def make():
        c = codec(vocab_path)

        def rows(doc_ids, texts):
            for i, ids in zip(doc_ids, c.encode_all(texts)):
                yield i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest()

        return rows

    return map_chunks(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
