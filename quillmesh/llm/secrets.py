"""Secret scans: assignments of source and configuration text as name-literal pairs, with constants propagated."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Kinds of spans in the order in which they are listed.
KINDS = ["assign", "access", "hex", "literal"]
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: An assignment is an operator with a name before it and an expression of literals and names after it. A call with a
#: literal gives it to the function's name, a literal after a quoted name in a list to that name.
OPERATOR = re.compile(r""":=|=>|[:=](?![:=])|\((?=[ \t]*["'])|(?<=["']),(?=[ \t]*["'])""")
#: An element gives its text to its name.
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)>([^<>\s]+)</", re.A)
#: A name, the blanks after it and the end of its line, read backwards from the operator, as far as they go.
NAME_BACK = re.compile(r"""\n?[ \t]*(["']?)([\w.\-]*[A-Za-z_])\1(?![\w.\-])""", re.A)
TERM = re.compile(
    r"""[ \t]*(?:\"{3}([^"\\\n]*)\"{3}|'{3}([^'\\\n]*)'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|[|>][+-]?[ \t]*\n[ \t]+([^\s]+)[ \t]*(?=\n|$)"""
    r"""|([A-Za-z_][\w.]*)(?![\w+/=\-])|([A-Za-z0-9+/_.=\-]+))""",
    re.A,
)
#: The groups of TERM: all but NAMED hold literals.
GROUPS, NAMED = range(1, 8), 6
JOINT = re.compile(r"[ \t]*(?:\+|\.\.|&)(?=[ \t]*[\"'A-Za-z_])")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: How sensitive a target is by the parts of its name.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.6, "key": 0.6, "access": 0.5, "signature": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|dummy|your[_-]|<|\$\{|\{\{|%\(|^(.)\1*$|^(?:true|false|none|null)$")
#: A literal is reported from this score, and from this length.
LEAST_SCORE, LEAST_LENGTH = 0.5, 8

SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def name_weight(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    both = ["".join(p) for p in zip(parts, parts[1:], strict=False)]
    return min(1.0, max((WEIGHTS.get(p, 0.0) for p in parts + both), default=0.0) + 0.2 * (sum(p in WEIGHTS for p in parts) > 1))


def literal_weight(value: str) -> float:
    """0 to 1: long, mixed and unpredictable literals look like secrets; words, sentences and placeholders don't."""
    if len(value) < LEAST_LENGTH or PLACEHOLDER.search(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(any(map(f, value)) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, entropy / 4) * (0.6, 0.6, 0.9, 1.0)[kinds]


def assignments(text: str) -> Iterator[tuple[str, list[tuple[str, int, int, bool]]]]:
    """(name, terms) of each assignment; a term is (text, start, end, whether it is a name)."""
    at = high = 0
    for op in OPERATOR.finditer(text):
        low, high = high, op.end()  # a name has no operator in it: what is read backwards adds up to the text
        if op.start() < at:
            continue
        name = NAME_BACK.match(text[low : op.start()][::-1])
        if not name:
            continue
        terms, pos = [], op.end()
        while term := TERM.match(text, pos):
            i = next(k for k in GROUPS if term[k] is not None)
            terms.append((term[i], term.start(i), term.end(i), i == NAMED))
            pos = term.end()
            joint = JOINT.match(text, pos)
            if not joint:
                break
            pos = joint.end()
        if terms:
            at = terms[0][1]  # what stands in the value may be an assignment itself: {"a": {"b": 1}}
            yield name[2][::-1], terms


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that reach a sensitive name, directly or by names that hold them.

    All assignments of the text count, in any order: a name that another one is made of passes on what reaches it.
    Weights go from the most sensitive name back along the expressions, each name once, so this is linear in them.
    """
    made: dict[str, list[str]] = {}
    held: dict[str, list[tuple[str, int, int]]] = {}
    every = [*assignments(text), *((m[1], [(m[2], m.start(2), m.end(2), False)]) for m in ELEMENT.finditer(text))]
    assigned = {name for name, _ in every}
    for name, terms in every:
        for value, start, end, is_name in terms:
            if is_name and value in assigned:
                made.setdefault(name, []).append(value)
            else:
                held.setdefault(name, []).append((value, start, end))
    reached: dict[str, tuple[str, float]] = {}
    for weight, target in sorted(((w, n) for n in assigned if (w := name_weight(n))), key=lambda x: (-x[0], x[1])):
        todo = [target]
        while todo:
            name = todo.pop()
            if name not in reached:
                reached[name] = target, weight
                todo += made.get(name, [])
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for name, (target, weight) in reached.items():
        for value, start, end in held.get(name, []):
            score = weight * literal_weight(value)
            if score >= LEAST_SCORE and score > best.get((start, end), ("", 0.0))[1]:
                best[start, end] = target, score
    return [(a, b, name, score) for (a, b), (name, score) in best.items()]


def scan(text: str) -> list[dict]:
    """All spans of a text in code points, by start and kind."""
    out: list[tuple[int, int, int, str | None, float]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), None, 1.0) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), None, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), None, 1.0) for m in HEX.finditer(text)]
    if any(c in text for c in "=:(,<"):
        out += [(a, 3, b, name, score) for a, b, name, score in literals(text)]
    return [{"kind": KINDS[k], "start": a, "end": b, "name": name, "score": s} for a, k, b, name, s in sorted(out, key=lambda x: x[:3])]


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs(doc_id, text, ...): spans of kind, start, end, name, score.

    The kinds assign, access and hex are plain patterns; literal is a value that an assignment, or a chain of them,
    gives to a sensitive name, with that name and its score. Offsets are code points, the end exclusive. A null
    text counts as empty, a very long one is scanned whole in steps that add up to its length; rows are scanned one by one, so repeated ids and rows and null ids are kept as they are;
    an empty table gives no rows; further columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, SPAN)], ["doc_id", "spans"])

    kind = "doc_id long, spans array<struct<kind: string, start: long, end: long, name: string, score: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of each document."""
    text = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    n = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(F.expr(text.format("filter(spans, s -> s.kind <> 'literal')")), 256).alias("base_sha256"),
        F.expr(text.format("spans")).alias("spans"),
    )
