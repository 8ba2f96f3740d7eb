"""Secret scan with linking of multipart credentials.

Three kinds of base spans are found on their own: assign (a keyword set to a value), access (an access identifier with
its fixed prefix) and hex (a long run of hexadecimal digits). Beside them there are weak candidates: identifiers (names
or numbers of clients, users and accounts), secrets (runs that mix cases and digits) and endpoints (URLs, hosts with
ports). Access spans count as identifiers and assign spans as secrets.

Scopes are the intervals of a text between its blank lines. Parts are joined to the scopes that hold them, by one pass
over sorted starts, so the work grows with the parts and not with their pairs. A weak candidate is reported only where
its complements are in its scope, however far off there: an identifier with a secret, a secret with an identifier, an
endpoint with both. A link is a scope with all its identifiers, secrets and endpoints; the credentials in it are their
combinations, which are not written out. All of it happens in the text's own row.

Starts and ends are code points, the end exclusive. Null and empty texts have no spans. Rows are never joined, so
repeated rows and null ids pass through with their own columns.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.session import map_arrow

#: The base patterns, and the least lengths of an assigned value, an access identifier and a hex run.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

NAMES = re.compile(r"""(?ai)\b(?:client_?id|access_?key(?:_?id)?|account(?:_?id)?|tenant(?:_?id)?|user(?:_?name|_?id)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""")
NAME_HINTS = (b"client", b"access", b"account", b"tenant", b"user", b"login")
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}\b""")
BLANK = re.compile(r"\n[\x20\t]*\n")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
Span = tuple[str, int, int]
Link = tuple[int, int, list[Span], list[Span], list[Span]]


class Cover:
    """Tells which intervals overlap one of some spans."""

    def __init__(self, spans: list[Span]) -> None:
        spans = sorted(spans, key=lambda s: s[1])
        self.starts = [s[1] for s in spans]
        self.ends = list(accumulate((s[2] for s in spans), max))

    def hits(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def base_spans(text: str) -> list[Span]:
    raw = text.encode("utf-8", "replace").lower()
    out = []
    if any(k in raw for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _weak_secret(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.islower() for c in run) and any(c.isupper() for c in run)


def weak_parts(text: str, base: list[Span]) -> tuple[list[Span], list[Span], list[Span]]:
    """The weak identifiers, secrets and endpoints of a text, reported or not. None overlaps a base span but endpoints; no secret lies in another part."""
    raw = text.encode("utf-8", "replace").lower()
    strong = Cover(base)
    names = [("identifier", *m.span(1)) for m in NAMES.finditer(text) if not strong.hits(*m.span(1))] if any(k in raw for k in NAME_HINTS) else []
    if not names and not any(s[0] == "access" for s in base):
        return [], [], []
    urls = [("endpoint", *m.span()) for m in URL.finditer(text)]
    held = Cover(base + names + urls)
    return names, [("secret", *m.span()) for m in MIXED.finditer(text) if _weak_secret(m[0]) and not held.hits(*m.span())], urls


def linked(text: str, base: list[Span]) -> tuple[list[Span], list[Link]]:
    """The weak spans to report; and start, end, identifiers, secrets and endpoints of every scope with an identifier and a secret."""
    names, secrets, urls = weak_parts(text, base)
    if not names and not any(s[0] == "access" for s in base):
        return [], []
    cuts = [m.span() for m in BLANK.finditer(text)]
    starts, ends = [0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(text)]
    scopes: dict[int, tuple[list[Span], list[Span], list[Span]]] = {}
    parts = ((names + [s for s in base if s[0] == "access"], 0), (secrets + [s for s in base if s[0] == "assign"], 1), (urls, 2))
    for spans, part in parts:
        for s in sorted(spans, key=lambda s: s[1:]):
            scopes.setdefault(bisect.bisect_right(starts, s[1]) - 1, ([], [], []))[part].append(s)
    links = [(starts[i], ends[i], *x) for i, x in sorted(scopes.items()) if x[0] and x[1]]
    return [s for link in links for some in link[2:] for s in some if s[0] in KINDS[3:]], links


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
PARTS = ("identifiers", "secrets", "endpoints")
EDGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
LINKS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), *((p, EDGES) for p in PARTS)]))


def scan(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans", links: str = "links") -> DataFrame:
    """docs with arrays of (kind, start, end): base, and spans with the linked weak ones too, by start and kind; and links, by scope.

    Columns of docs that have these names already are replaced.
    """
    docs = docs.drop(base, spans, links)
    schema = docs.withColumns({
        base: F.expr("cast(null as array<struct<kind: string, start: bigint, end: bigint>>)"), spans: F.expr("cast(null as array<struct<kind: string, start: bigint, end: bigint>>)"),
        links: F.expr(f"cast(null as array<struct<start: bigint, end: bigint, {', '.join(f'{p}: array<struct<start: bigint, end: bigint>>' for p in PARTS)}>>)"),
    }).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found, every, pairs = [], [], []
            for t in texts:
                b = base_spans(t or "")
                weak, links_ = linked(t or "", b)
                found.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in ordered(b)])
                every.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in ordered(b + weak)])
                pairs.append([{"start": a, "end": z} | {p: [{"start": s[1], "end": s[2]} for s in some] for p, some in zip(PARTS, held, strict=True)} for a, z, *held in links_])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, SPANS), pa.array(every, SPANS), pa.array(pairs, LINKS)], [*batch.schema.names, base, spans, links])

    return map_arrow(docs, run, schema)
