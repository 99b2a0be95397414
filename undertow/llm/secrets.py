"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference (state merging on frequency prefix trees): the labelled strings of one format make a prefix
tree with counts; two states merge when, by the Hoeffding bound, their symbol and end frequencies, and those of
the states below them, could come from one source. What is left is a deterministic automaton with probabilities.
A candidate is a maximal run of credential characters with a digit and a letter. It is scored under every
format's automaton and under one inferred from ordinary strings, as the difference of log likelihoods for each
character; it counts as a secret above the margin that errs least on strings held out, where false hits weigh most.

Labelled strings come from two places: a table of public formats, and the corpus itself, where what follows an
assignment (``password = ...``) is a labelled credential of the format ``corpus``. Of these, ``SAMPLE`` distinct ones
at most are taken, the smallest by hash; fewer than ``LEAST`` make no format. So a format that a corpus uses is found
where it stands without an assignment, too.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; texts are
scanned whole, very long ones too. Spans of the patterns always stay; those of automata are added where no pattern's
span overlaps; of several formats the likeliest names a span, and of equally likely ones the last by name. Rows that
repeat are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from undertow.llm.arrow import map_rows

#: The patterns of the base scan.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

#: Labelled strings taken from a corpus at most, and at least, for a format of its own.
SAMPLE, LEAST = 2000, 40
#: How many shares of missed credentials an equal share of flagged ordinary strings weighs.
FALSE_COST = 20
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Public credential formats, as name: (prefix, alphabet of the rest, its length).
FORMATS = {
    "aws_temporary": ("ASIA", UPPER + "234567", 16),
    "github": ("ghp_", DIGITS + LOWER + UPPER, 36),
    "gitlab": ("glpat-", DIGITS + LOWER + UPPER + "_-", 20),
    "google": ("AIza", DIGITS + LOWER + UPPER + "_-", 35),
    "npm": ("npm_", DIGITS + LOWER + UPPER, 36),
    "slack": ("xoxb-", DIGITS + LOWER + UPPER + "-", 40),
    "stripe": ("sk_live_", DIGITS + LOWER + UPPER, 24),
    "jwt": ("eyJhbGciOi", DIGITS + LOWER + UPPER + "_-.", 90),
}


def labelled_credentials(each: int = 120, seed: int = 7) -> dict[str, list[str]]:
    """Labelled strings: three times ``each`` of every public format, and twelve times as many ordinary ones under ``ordinary``."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    out = {name: [prefix + pick(alphabet, n) for _ in range(3 * each)] for name, (prefix, alphabet, n) in FORMATS.items()}
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    kinds = (
        lambda: "-".join(word() for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))) + f"/{rng.randint(1, 999)}.html",
        lambda: "_".join(word() for _ in range(rng.randint(3, 6))) + f"_v{rng.randint(1, 9)}",
        lambda: ".".join(word() for _ in range(rng.randint(3, 6))) + f".{rng.randint(1, 99)}",
        lambda: f"20{rng.randint(0, 29):02}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}{rng.randint(0, 59):02}{rng.randint(0, 59):02}Z",
        lambda: "".join(word().title() for _ in range(rng.randint(4, 8))) + str(rng.randint(0, 9999)),
        lambda: "".join(word() for _ in range(rng.randint(5, 9))) + str(rng.randint(0, 9999)),
    )
    kinds += (lambda: f"{word()}{rng.randint(0, 99)}.{word()}{rng.choice(('le', 'mple', ''))}.{rng.choice(('com', 'org', 'net'))}",) * 2
    digits = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    kinds += (lambda: "-".join(digits(n) for n in (8, 4, 4, 4, 12)), lambda: f"{word().upper()}_20{rng.randint(0, 29):02}{rng.randint(1, 12):02}{rng.randint(1, 28):02}_{rng.randint(0, 235959):06}.{rng.choice(('jpg', 'png', 'log'))}")
    # Names, paths and versions at large: words and numbers of some kind in a row, between separators.
    number = lambda: str(rng.randint(0, 10 ** rng.randint(1, 4)))
    part = lambda: rng.choice((word, word, word, lambda: word().title(), lambda: word().upper(), number, lambda: word() + number(), lambda: rng.choice(LOWER)))()

    def joined_parts() -> str:
        marks = rng.choice(("-", "_", ".", "/", "./", "/-", "/_.", "-_.", "=-", "/.-_"))
        parts = [part() for _ in range(rng.randint(2, 9))]
        return "".join(x for p in parts for x in (p, rng.choice(marks)))[:-1] + rng.choice(("", "", ".html", ".txt", ".tar.gz", ".com", ".example.org"))

    ordinary = [rng.choice(kinds)() for _ in range(4 * each)]
    while len(ordinary) < 12 * each:
        if len(s := joined_parts()) >= 16:
            ordinary.append(s)
    return out | {"ordinary": ordinary}


class Automaton:
    """A deterministic automaton with probabilities, merged from a prefix tree of strings."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]  # the tree: children, visits, ends of each state
        self.visits, self.ends = [0], [0]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.visits.append(0)
                    self.ends.append(0)
                at = self.next[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self.taken = [dict() for _ in self.next]  # how often each transition was taken
        for at, children in enumerate(self.next):
            for c, to in children.items():
                self.taken[at][c] = self.visits[to]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.merge_all()
        self.keep_reached()
        alphabet = len({c for s in strings for c in s}) + 1
        self.log = [{c: math.log((n + 0.1) / (self.visits[at] + 0.1 * alphabet)) for c, n in t.items()} for at, t in enumerate(self.taken)]
        self.end = [math.log((n + 0.1) / (v + 0.1 * alphabet)) for n, v in zip(self.ends, self.visits)]
        self.miss = [math.log(0.1 / (v + 0.1 * alphabet)) if v else -5.0 for v in self.visits]

    def differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def alike(self, a: int, b: int) -> bool:
        """Whether two states, and those below them, could come from one source."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.differ(self.visits[a], self.ends[a], self.visits[b], self.ends[b]):
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if self.differ(self.visits[a], self.taken[a].get(c, 0), self.visits[b], self.taken[b].get(c, 0)):
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.taken[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def merge_all(self) -> None:
        red = [0]
        while True:
            blue = [(at, c, to) for at in red for c, to in sorted(self.next[at].items()) if to not in red]
            if not blue:
                return
            at, c, to = max(blue, key=lambda x: self.visits[x[2]])
            for r in red:
                if self.alike(r, to):
                    self.next[at][c] = r
                    self.fold(r, to)
                    break
            else:
                red.append(to)

    def keep_reached(self) -> None:
        """Number the states that merging left, and drop the others."""
        order, number = [0], {0: 0}
        for at in order:
            for to in self.next[at].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
        self.next = [{c: number[to] for c, to in self.next[at].items()} for at in order]
        self.taken = [self.taken[at] for at in order]
        self.visits = [self.visits[at] for at in order]
        self.ends = [self.ends[at] for at in order]

    def score(self, s: str) -> float:
        """Log likelihood, its end included, for each character; one that no transition takes counts as rarely seen and stays."""
        at, total = 0, 0.0
        for c in s:
            total += self.log[at].get(c, self.miss[at])
            at = self.next[at].get(c, at)
        return (total + self.end[at]) / len(s)


class Scanner:
    """Automata of every format and the margin above ordinary strings, learned from labelled strings."""

    def __init__(self, labelled: dict[str, list[str]], least: int = 16):
        held = {k: v[::4] for k, v in labelled.items()}
        fit = {k: [s for i, s in enumerate(v) if i % 4] for k, v in labelled.items()}
        self.ordinary = Automaton(fit["ordinary"])
        self.formats = {k: Automaton(v) for k, v in fit.items() if k != "ordinary"}
        self.candidate = re.compile(rf"[A-Za-z0-9_-][A-Za-z0-9+/_.=-]{{{least - 2},}}[A-Za-z0-9_=-]")
        clean = sorted(self.margin(s)[0] for s in held["ordinary"])
        secret = sorted(self.margin(s)[0] for k, v in held.items() if k != "ordinary" for s in v)

        def cost(t: float) -> float:
            return bisect_right(secret, t) / len(secret) + FALSE_COST * (1 - bisect_right(clean, t) / len(clean))

        tried = sorted({*clean, *secret})
        least_cost = min(map(cost, tried))
        best = [t for t in tried if cost(t) <= least_cost + 1e-9]
        self.threshold = (best[0] + best[-1]) / 2
        self.base = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)

    def margin(self, s: str) -> tuple[float, str]:
        """By how much the best format beats ordinary strings, for each character."""
        return max((a.score(s) - self.ordinary.score(s), k) for k, a in self.formats.items())

    def scan(self, text: str | None) -> list[tuple[int, int, str, int]]:
        """Spans (start, rank of the kind, kind, end), in order."""
        if not text:
            return []
        assign, access, run = self.base
        low = text.lower()
        spans = []
        if "passw" in low or "secret" in low or "token" in low or "api" in low:
            spans += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            spans += [(m.start(), 1, "access", m.end()) for m in access.finditer(text) if m.end() - m.start() >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in run.finditer(text)]
        base = sorted(spans)
        for m in self.candidate.finditer(text):
            start, end, s = m.start(), m.end(), m[0]
            if any(a < end and start < b for a, _, _, b in base) or s.isalpha() or not any("0" <= c <= "9" for c in s) or not any(c.isalpha() for c in s):
                continue
            found, name = self.margin(s)
            if found > self.threshold:
                spans.append((start, 3, name, end))
        return sorted(spans)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """The scanner of the public formats. The driver learns it once and ships it with the tasks: a few thousand numbers."""
    return Scanner(labelled_credentials())


def learn(docs: DataFrame, sample: int = SAMPLE) -> Scanner:
    """A scanner of the public formats and of the credentials that docs assign. The driver sees the sample only."""
    found = docs.where(F.col("text").rlike(ASSIGN)).select(F.explode(F.expr(f"regexp_extract_all(text, {literal(ASSIGN)}, 2)")).alias("value"))
    rows = found.where("length(value) BETWEEN 12 AND 200").distinct().orderBy(F.xxhash64("value"), "value").limit(sample).collect()
    return scanner() if len(rows) < LEAST else Scanner(labelled_credentials() | {"corpus": [r["value"] for r in rows]})


def literal(text: str) -> str:
    """A string as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def scan(docs: DataFrame, learned: Scanner | None = None) -> DataFrame:
    """Every document's spans: doc_id, counts of each pattern, digest of the patterns' spans, all spans."""

    learned = learned or scanner()

    def make():
        find = learned.scan

        def row(i, text):
            spans = find(text)
            base = [s for s in spans if s[1] < 3]
            return i, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)

        return row

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long", make)


def redact(docs: DataFrame, mask: str = "[secret]", learned: Scanner | None = None) -> DataFrame:
    """The documents with every span of ``scan`` replaced; overlapping spans become one. Other columns, and texts
    without spans, nulls included, stay as they are; n_chars follows the text where the column exists."""
    names, schema, learned = docs.columns, docs.schema, learned or scanner()

    def cover(text):
        spans = learned.scan(text)
        if not spans:
            return text
        out, at = [], 0
        for start, _, _, end in spans:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            new = [cover(t) for t in texts]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[at].to_pylist(), texts, new)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
