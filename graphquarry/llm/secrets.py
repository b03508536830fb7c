"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Beside them, candidate strings (runs of token characters that hold both
letters and digits) are scanned by a sliding window whose Shannon entropy is kept by incremental counts: as the
window moves on, the count of one character falls and of another rises, and the sum of c * log2(c) changes by
those two terms only. Base spans cut a run; what remains of it, between them, are candidates of their own. Windows
that touch an allow-list entry do not count: entries cut a candidate in turn, into pieces. A piece of one character
class (hex, or mixed) is reported from the first to the last window whose entropy reaches the class's threshold.

Positions count code points; ends are exclusive. Defined cases: null and empty texts have no spans; rows are
treated one by one, so ties and repeats do not matter; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX_LEAST = 24
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings, by class: pattern of the class, least entropy (bits) of a window.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
THRESHOLDS = {"hex": 2.9, "mixed": 3.6}
ALLOW = ("EXAMPLE", "example", "0123456789", "abcdefghijkl", "ABCDEFGHIJKL", "placeholder", "changeme")

_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int,m:string>>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(text: str, pattern: str, kind: int, group: int = 0) -> str:
    """SQL: a pattern's matches with their places, from the lengths of the texts between them; `m` is a group of the match."""
    p = _quoted(pattern)
    return f"""aggregate(
        arrays_zip(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})),
        named_struct('at', 0, 'found', {_EMPTY}),
        (a, x) -> named_struct(
            'at', a.at + length(x.`0`) + length(x.`1`),
            'found', concat(a.found, array(named_struct('start', a.at + length(x.`0`), 'kind', {kind}, 'end', a.at + length(x.`0`) + length(x.`1`), 'm', x.`2`)))),
        a -> a.found)"""


def _outside(x: str, spans: str) -> str:
    """SQL: the parts of a located match `x` outside `spans` (in order of start) that a window fits in."""
    part = lambda start, end: f"if({end} - {start} >= {WINDOW}, array(named_struct('start', {start}, 'kind', 3, 'end', {end}, 'm', substring({x}.m, {start} - {x}.start + 1, {end} - {start}))), {_EMPTY})"
    return f"""aggregate({spans}, named_struct('at', {x}.start, 'parts', {_EMPTY}),
        (a, b) -> named_struct('at', greatest(a.at, b.end), 'parts', concat(a.parts, {part('a.at', 'b.start')})),
        a -> concat(a.parts, {part('a.at', f'{x}.end')}))"""


def _allowed(x: str) -> str:
    """SQL: places of the allow-list entries in a located match `x`, overlapping ones too."""
    entry = "|".join(ALLOW)
    return f"""aggregate(split({x}.m, '(?={entry})', -1), named_struct('at', {x}.start, 'found', {_EMPTY}),
        (a, s) -> named_struct('at', a.at + length(s), 'found', if(substring({x}.m, a.at - {x}.start + 1) rlike '^({entry})',
            concat(a.found, array(named_struct('start', a.at, 'kind', 3, 'end', a.at + length(regexp_extract(substring({x}.m, a.at - {x}.start + 1), '^({entry})', 0)), 'm', ''))), a.found)),
        a -> a.found)"""


def _windows(string: str) -> str:
    """SQL: the first and last place (exclusive) that windows of high entropy cover in a candidate; -1 if none does."""
    w = WINDOW
    f = "array(" + ", ".join(["0D", *(f"{c} * log2({c}D)" for c in range(1, w + 2))]) + ")"
    least = f"if({string} rlike '^[0-9a-fA-F]+$', {THRESHOLDS['hex']}D, {THRESHOLDS['mixed']}D)"
    high = f"e >= {w} and log2({w}D) - s / {w} >= k.least"
    return f"""transform(array(named_struct(
            'codes', transform(sequence(1, length({string})), i -> locate(substring({string}, i, 1), '{_CHARS}')), 'least', {least}, 'f', {f})), k ->
        aggregate(sequence(1, size(k.codes)), named_struct('counts', array_repeat(0, {len(_CHARS)}), 's', 0D, 'first', -1, 'last', -1), (a, e) ->
            transform(array(named_struct('new', get(k.codes, e - 1), 'old', if(e > {w}, get(k.codes, e - {w + 1}), 0))), v ->
            transform(array(if(v.new = v.old, a.s,
                a.s + get(k.f, get(a.counts, v.new - 1) + 1) - get(k.f, get(a.counts, v.new - 1))
                    + if(v.old > 0, get(k.f, get(a.counts, v.old - 1) - 1) - get(k.f, get(a.counts, v.old - 1)), 0D))), s ->
            named_struct(
                'counts', if(v.new = v.old, a.counts, transform(a.counts, (c, j) -> c + if(j + 1 = v.new, 1, 0) - if(j + 1 = v.old, 1, 0))),
                's', s,
                'first', if(a.first < 0 and {high}, e - {w}, a.first),
                'last', if({high}, e, a.last)))[0])[0]))[0]"""


def secret_spans(text: str = "text") -> dict[str, Column]:
    """The columns `base` and `added`: arrays of (start, kind, end), each in order; kind numbers index KINDS.

    Apply them one after the other to the same rows: `added` reads the column `base`.
    """
    t = text
    words = " or ".join(f"contains(lower({t}), '{w}')" for w in ASSIGN_WORDS)
    assign = f"case when {words} then filter({_located(t, ASSIGN, 0, 2)}, x -> length(x.m) >= {ASSIGN_LEAST}) else {_EMPTY} end"
    access = f"case when contains({t}, 'AKIA') then filter({_located(t, ACCESS, 1)}, x -> length(x.m) >= {ACCESS_LEAST}) else {_EMPTY} end"
    # runs of fewer hex digits fail, and a longer run is one match from its start: so only long runs are sought
    hexes = f"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}"
    found = f"case when {t} rlike {_quoted(hexes)} then {_located(t, hexes, 2)} else {_EMPTY} end"
    base = f"transform(array_sort(concat({assign}, {access}, {found})), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    run = f"(?<![A-Za-z0-9+/_=-]){CANDIDATE}"
    allowed = " or ".join(f"contains(x.m, '{a}')" for a in ALLOW)
    runs = f"case when {t} rlike '[0-9]' then filter({_located(t, run, 3)}, x -> x.m rlike '[0-9]' and x.m rlike '[A-Za-z]') else {_EMPTY} end"
    touches = "b.start < x.end and x.start < b.end"
    parts = f"flatten(transform({runs}, x -> if(exists(base, b -> {touches}), {_outside('x', f'filter(base, b -> {touches})')}, array(x))))"
    candidates = f"filter({parts}, x -> x.m rlike '[0-9]' and x.m rlike '[A-Za-z]')"
    candidates = f"flatten(transform({candidates}, x -> if({allowed}, {_outside('x', _allowed('x'))}, array(x))))"
    added = f"""transform(filter(transform({candidates}, x -> named_struct('x', x, 'w', {_windows('x.m')})), y -> y.w.last > 0),
        y -> named_struct('start', y.x.start + y.w.first, 'kind', 3, 'end', y.x.start + y.w.last))"""
    none = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
    return {"base": F.expr(f"coalesce({base}, {none})"), "added": F.expr(f"coalesce({added}, {none})")}


def joined(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({kinds}, x.kind), ':', x.start, ':', x.end)), ',')")


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, text, base and added spans, and both together in order."""
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    for name, column in secret_spans().items():
        d = d.withColumn(name, column)
    return d.withColumn("spans", F.array_sort(F.concat("base", "added"))).withColumnRenamed("id", doc_id).withColumnRenamed("text", text)


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span of the text (overlapping ones as one) replaced by a mark."""
    names = docs.columns
    d = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(text).alias("text"))
    for name, column in secret_spans().items():
        d = d.withColumn(name, column)
    clean = F.expr(
        f"""aggregate(array_sort(concat(base, added)), named_struct('at', 0, 'out', ''),
            (a, x) -> named_struct('at', greatest(a.at, x.end), 'out',
                if(x.start < a.at, a.out, concat(a.out, substring(text, a.at + 1, x.start - a.at), {_quoted(mark)}))),
            a -> concat(a.out, substring(text, a.at + 1)))"""
    )
    clean = F.when(F.size("base") + F.size("added") > 0, clean).otherwise(F.col("text"))
    return d.select(*[clean.alias(c) if c == text else F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
