"""Relations as SQL text, written once: run by Spark, or rendered for a second engine that checks results.

A relation names the relations it reads. Spark gets them as plans of each other, so Catalyst sees the whole and
prunes, pushes down and reuses exchanges across them; a second engine gets one WITH query. Macros hide where
dialects differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Each macro as (Spark, DuckDB); {0}, {1}, ... are its arguments.
MACROS = {
    "HOUR": ("cast(date_trunc('hour', {0}) as timestamp_ntz)", "date_trunc('hour', {0})"),
    "DAY": ("cast(date_trunc('day', {0}) as timestamp_ntz)", "date_trunc('day', {0})"),
    "HOURS": ("timestampdiff(HOUR, {0}, {1})", "date_diff('hour', {0}, {1})"),
    "DAYS": ("timestampdiff(DAY, {0}, {1})", "date_diff('day', {0}, {1})"),
    "SEQ": ("explode(sequence(cast({0} as bigint), cast({1} as bigint)))", "unnest(generate_series(cast({0} as bigint), cast({1} as bigint)))"),
    "U": ("((cast(conv(substr(md5({0}), 1, 8), 16, 10) as bigint) + 0.5D) / 4294967296.0D)", "((cast('0x' || substr(md5({0}), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double)"),
    "LAST": ("last_value({0}) IGNORE NULLS", "last_value({0} IGNORE NULLS)"),
    "FIRST": ("first_value({0}) IGNORE NULLS", "first_value({0} IGNORE NULLS)"),
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "LIST": ("transform(array_sort(collect_list(struct({1} as k, {0} as v))), x -> x.v)", "list({0} ORDER BY {1})"),
    "EACH": ("transform({0}, {1} -> {2})", "list_transform({0}, lambda {1}: {2})"),
    "KEEP": ("filter({0}, {1} -> {2})", "list_filter({0}, lambda {1}: {2})"),
    "ARRAY": ("array({0})", "[{0}]"),
    "GET": ("get({0}, {1})", "({0})[{1} + 1]"),
    "RANGE": ("sequence(0, {0} - 1)", "range(0, {0})"),
    "SIZE": ("size({0})", "len({0})"),
    "CUT": ("slice({0}, {1}, {2})", "({0})[{1}:({1}) + ({2}) - 1]"),
    "CAT": ("concat({0}, {1})", "list_concat({0}, {1})"),
    "REPEAT": ("array_repeat({0}, cast({1} as int))", "list_transform(range(0, {1}), lambda q: {0})"),
    "FORALL": ("forall({0}, {1} -> {2})", "(len(list_filter({0}, lambda {1}: NOT ({2}))) = 0)"),
    "ARGMAX": ("(array_position({0}, array_max({0})) - 1)", "(list_position({0}, list_max({0})) - 1)"),
    "SUB": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "JOINED": ("array_join(array_sort(collect_list({0})), ',')", "string_agg({0}, ',' ORDER BY {0})"),
    "EXACT": ("cast(round({0}, 6) as double)", "cast(round({0}, 6) as double)"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
}
#: What may follow a table that has no alias.
KEYWORD = r"(?:AS|JOIN|LEFT|WHERE|GROUP|ORDER|USING|ON|UNION|CROSS|FULL|INNER|HAVING|LIMIT|INTERSECT|EXCEPT)\b"
#: Text in quotes, or a number with a point and no exponent.
NUMBER = re.compile(r"'[^']*'|(?<![\w.])\d+\.\d+(?![\w.])")
CALL = re.compile(r"\$([A-Z]+)\(")


def expand(sql: str, spark: bool) -> str:
    """Replace macros, inner ones first; arguments are split at commas outside of brackets, or at | where there is one.

    Numbers with a point become doubles for both engines: as decimals, quotients would be cut at a few digits.
    """
    sql = NUMBER.sub(lambda m: m[0] if m[0][0] == "'" else m[0] + "e0", sql)
    while calls := list(CALL.finditer(sql)):
        call = calls[-1]
        depth, at = 1, call.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        inside = sql[call.end() : at - 1]
        args, level, start, quoted = [], 0, 0, False
        bar = "|" if "|" in inside.replace("||", "") else ","
        for k, c in enumerate(inside):
            quoted ^= c == "'"
            level += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
            if c == bar and not level and not quoted:
                args.append(inside[start:k].strip())
                start = k + 1
        args.append(inside[start:].strip())
        text = MACROS[call[1]][0 if spark else 1]
        if call[1] == "ARRAY":
            args = [inside]
        sql = sql[: call.start()] + re.sub(r"\{(\d)\}", lambda m: args[int(m[1])], text) + sql[at:]
    return sql


@dataclass
class Catalog:
    """Named relations, and which of them are queries."""

    sql: dict[str, str] = field(default_factory=dict)
    other: dict[str, str] = field(default_factory=dict)  # DuckDB text where a macro doesn't do
    queries: list[str] = field(default_factory=list)

    def add(self, name: str, sql: str, other: str | None = None, query: bool = False) -> None:
        if name in self.sql or name in TABLES:
            raise ValueError(f"there is a relation {name} already")
        self.sql[name] = sql
        if other:
            self.other[name] = other
        if query:
            self.queries.append(name)

    def needs(self, name: str, given: frozenset[str] = frozenset()) -> list[str]:
        """The relations below one, and itself, each after those it reads."""
        order: list[str] = []

        def visit(n: str) -> None:
            if n in order or n in given:
                return
            for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z]\w*)", self.sql[n] + " " + self.other.get(n, ""))):
                if word != n and word in self.sql:
                    visit(word)
            order.append(n)

        visit(name)
        return order

    def text(self, name: str, spark: bool, given: frozenset[str] = frozenset()) -> str:
        *below, last = self.needs(name, given)
        body = lambda n: expand(self.sql[n] if spark else self.other.get(n, self.sql[n]), spark)
        texts = [body(n) for n in (*below, last)]
        read = lambda n: sum(len(re.findall(rf"\b(?:FROM|JOIN)\s+{n}\b", t)) for t in texts)
        kept = lambda n: "" if spark or read(n) < 2 else "MATERIALIZED "
        ctes = ", ".join(f"{n} AS {kept(n)}({t})" for n, t in zip(below, texts))
        return f"WITH {ctes} {body(last)}" if ctes else body(last)

    def run(self, spark: SparkSession, name: str, sf_dir: str | None = None, **given: DataFrame) -> DataFrame:
        """One relation as a DataFrame. Any relation or table below it can be given instead of computed or read.

        Relations become plans of each other, without common table expressions, so one optimizer run sees all.
        """
        views = {t: view(t, f) for t, f in given.items()}
        passing = []
        for n in self.needs(name, frozenset(given)):
            text = expand(self.sql[n], True)
            for t in TABLES:
                if t not in views and re.search(rf"\b(FROM|JOIN)\s+{t}\b", text):
                    views[t] = view(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
                    passing.append(views[t])
            for t, v in views.items():
                text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b(?:\s+(?!{KEYWORD})(\w+))?", lambda m, t=t, v=v: f"{m[1]} {v} AS {m[2] or t}", text)
            out = spark.sql(text)
            if n != name:
                views[n] = view(n, out)
                passing.append(views[n])
        for v in passing:
            spark.catalog.dropTempView(v)
        return out


NUMBERS = count()


def view(name: str, df: DataFrame) -> str:
    """The temporary view of a DataFrame. One that is given keeps its view: dropping it would end its persistence."""
    if not hasattr(df, "undertow_view"):
        df.undertow_view = f"undertow_{name}_{next(NUMBERS)}"
        df.createOrReplaceTempView(df.undertow_view)
    return df.undertow_view
