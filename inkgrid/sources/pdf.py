"""A reader of vector PDFs: objects, page tree and content streams, as far as line drawings and their text need them.

Coordinates come out in points with y growing downwards. Curves become chords by bisection. Annotations are read
apart and never mixed with page geometry. Encrypted files and filters other than Flate are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import atan2, degrees, dist, hypot

#: Chord tolerance and depth of curve bisection, and the depth of nested forms.
TOLERANCE, DEPTH, FORMS = 0.05, 6, 8
#: The least and most steps of a cubic that is cut at equal steps.
LEAST_STEPS, MOST_STEPS = 4, 24
Point = tuple[float, float]
Matrix = tuple[float, float, float, float, float, float]
TOKEN = re.compile(rb"""\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[+-]?(?:\d+\.?\d*|\.\d+)|[^\s()<>\[\]{}/%]+|\()""", re.S)


class Name(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes

    def data(self) -> bytes:
        filters = self.info.get("Filter", [])
        data = self.raw
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"filter {f} is not read")
            data = zlib.decompressobj().decompress(data)
        parms = self.info.get("DecodeParms")
        if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10:
            data = _unpredict(data, int(parms.get("Columns", 1)))
        return data


def _unpredict(data: bytes, columns: int) -> bytes:
    """Undoes the PNG filters 0 (none), 1 (left) and 2 (up) of rows of bytes."""
    before, out = bytes(columns), bytearray()
    for i in range(0, len(data), columns + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + columns])
        for k in range(len(row)):
            if kind == 1 and k:
                row[k] = (row[k] + row[k - 1]) & 255
            elif kind == 2:
                row[k] = (row[k] + before[k]) & 255
        before = bytes(row)
        out += row
    return bytes(out)


class Parser:
    """Reads values one after the other from bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        m = TOKEN.match(self.data, self.at)
        if not m:
            return None
        self.at = m.end()
        if m[1] == b"(":
            return self._nested()
        return m[1]

    def _nested(self) -> bytes:
        """A string with balanced parentheses inside."""
        depth, start = 1, self.at - 1
        while depth and self.at < len(self.data):
            c = self.data[self.at]
            if c == 0x5C:
                self.at += 1
            else:
                depth += (c == 0x28) - (c == 0x29)
            self.at += 1
        return self.data[start : self.at]

    def value(self, token: bytes | None = None):
        t = token if token is not None else self.token()
        if t is None:
            return None
        if t == b"<<":
            out = {}
            while (k := self.token()) not in (b">>", None):
                out[k[1:].decode("latin-1")] = self.value()
            return out
        if t == b"[":
            items = []
            while (k := self.token()) not in (b"]", None):
                items.append(self.value(k))
            return items
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if t[:1] == b"(":
            return _unescape(t[1:-1])
        if t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
            if b"." not in t and (m := re.compile(rb"\s+(\d+)\s+R(?![A-Za-z])").match(self.data, self.at)):
                self.at = m.end()
                return Ref(int(t))
            return float(t) if b"." in t else int(t)
        return {b"true": True, b"false": False, b"null": None}.get(t, t)


def _unescape(raw: bytes) -> bytes:
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else plain.get(m[1], m[1]), raw, flags=re.S)


@dataclass
class Path:
    points: list[Point]
    closed: bool
    stroke: tuple | None
    fill: tuple | None
    width: float
    dashes: str
    layer: str | None
    kind: str = "path"


@dataclass
class Span:
    text: str
    x: float
    y: float
    size: float
    rotation: float
    font: str
    advance: float = 0.0
    #: Each character with its origin and advance.
    chars: list[tuple[str, float, float, float]] = field(default_factory=list)


@dataclass
class Page:
    number: int
    width: float
    height: float
    rotation: int
    paths: list[Path] = field(default_factory=list)
    spans: list[Span] = field(default_factory=list)
    annotations: list[dict] = field(default_factory=list)
    fonts: list[dict] = field(default_factory=list)
    box: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


class Document:
    """A file's objects. flatten is how cubics become chords: adaptive, or steps for a number that follows the control polygon."""

    def __init__(self, data: bytes, flatten: str = "adaptive") -> None:
        self.chords = {"adaptive": chords, "steps": stepped}[flatten]
        if not data[:1024].lstrip().startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):
            p = Parser(data, m.end())
            value = p.value()
            s = re.compile(rb"\s*stream\r?\n").match(data, p.at)
            if s and isinstance(value, dict):
                length = value.get("Length")
                end = s.end() + length if isinstance(length, int) and data[s.end() + length : s.end() + length + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", s.end())
                value = Stream(value, data[s.end() : end])
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"trailer", data):
            found = Parser(data, m.end()).value()
            self.trailer |= found if isinstance(found, dict) else {}
        for o in list(self.objects.values()):
            if isinstance(o, Stream) and o.info.get("Type") == "ObjStm":
                body, head = o.data(), Parser(o.data())
                pairs = [(head.value(), head.value()) for _ in range(o.info["N"])]
                for number, at in pairs:
                    self.objects.setdefault(number, Parser(body, o.info["First"] + at).value())
            if isinstance(o, Stream) and o.info.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in o.info.items() if k in ("Root", "Encrypt", "Info")}
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted files are not read")

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 32:
            value, seen = self.objects.get(value.number), seen + 1
        return value

    def pages(self) -> Iterator[Page]:
        root = self.get(self.trailer.get("Root")) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        number = 0
        stack = [(root.get("Pages"), {})]
        while stack:
            ref, inherited = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                stack += [(k, own) for k in reversed(self.get(node["Kids"]))]
            else:
                yield self._page(number, node, own)
                number += 1

    def _fonts(self, resources: dict) -> Iterator[dict]:
        """The fonts of a page's resources: name there, base font, subtype, encoding, and the format of an embedded program."""
        for name, ref in sorted((self.get(resources.get("Font")) or {}).items()):
            font = self.get(ref) or {}
            inner = self.get((self.get(font.get("DescendantFonts")) or [None])[0]) or font
            descriptor = self.get(inner.get("FontDescriptor")) or {}
            program = next((k for k in ("FontFile", "FontFile2", "FontFile3") if k in descriptor), None)
            stream = self.get(descriptor.get(program)) if program else None
            encoding = self.get(font.get("Encoding"))
            yield {"name": str(name), "base": str(font.get("BaseFont", "")), "subtype": str(font.get("Subtype", "")), "encoding": str(encoding) if isinstance(encoding, str) else None, "program": program, "data": stream.data() if isinstance(stream, Stream) else None}

    def _page(self, number: int, node: dict, own: dict) -> Page:
        x0, y0, x1, y1 = (float(self.get(v)) for v in self.get(own.get("CropBox") or own.get("MediaBox") or [0, 0, 612, 792]))
        page = Page(number, x1 - x0, y1 - y0, int(own.get("Rotate") or 0), box=(x0, y0, x1, y1))
        page.fonts = list(self._fonts(self.get(own.get("Resources")) or {}))
        contents = self.get(node.get("Contents")) or []
        parts = contents if isinstance(contents, list) else [contents]
        data = b"\n".join(self.get(p).data() for p in parts if isinstance(self.get(p), Stream))
        Interpreter(self, page, (1, 0, 0, -1, -x0, y1)).run(data, self.get(own.get("Resources")) or {}, 0)
        for a in self.get(node.get("Annots")) or []:
            a = self.get(a) or {}
            rect = [float(self.get(v)) for v in self.get(a.get("Rect")) or []]
            points = [float(self.get(v)) for v in self.get(a.get("Vertices") or a.get("L")) or []]
            page.annotations.append({"subtype": str(a.get("Subtype", "")), "rect": [rect[0] - x0, y1 - rect[3], rect[2] - x0, y1 - rect[1]] if len(rect) == 4 else None, "points": [(x - x0, y1 - y) for x, y in zip(points[::2], points[1::2])]})
        return page


def stepped(p0: Point, p1: Point, p2: Point, p3: Point) -> list[Point]:
    """The points after p0 of a cubic at equal steps of its parameter, half as many as its control polygon has points of length, LEAST_STEPS to MOST_STEPS."""
    hull = dist(p0, p1) + dist(p1, p2) + dist(p2, p3)
    n = min(MOST_STEPS, max(LEAST_STEPS, round(hull / 2)))

    def at(t: float) -> Point:
        weights = (1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3
        return tuple(sum(w * p[axis] for w, p in zip(weights, (p0, p1, p2, p3), strict=True)) for axis in (0, 1))

    return [at(i / n) for i in range(1, n + 1)]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m: Matrix, x: float, y: float) -> Point:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def chords(p0: Point, p1: Point, p2: Point, p3: Point, depth: int = DEPTH) -> list[Point]:
    """The points after p0 of chords along a cubic, each within TOLERANCE of it as long as the depth lasts."""
    dx, dy = p3[0] - p0[0], p3[1] - p0[1]
    length = (dx * dx + dy * dy) ** 0.5
    away = lambda p: abs(dx * (p[1] - p0[1]) - dy * (p[0] - p0[0])) / length if length else ((p[0] - p0[0]) ** 2 + (p[1] - p0[1]) ** 2) ** 0.5
    if depth == 0 or max(away(p1), away(p2)) <= TOLERANCE:
        return [p3]
    mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    a, b, c = mid(p0, p1), mid(p1, p2), mid(p2, p3)
    d, e = mid(a, b), mid(b, c)
    f = mid(d, e)
    return chords(p0, a, d, f, depth - 1) + chords(f, e, c, p3, depth - 1)


@dataclass
class State:
    ctm: Matrix
    stroke: tuple = (0.0, 0.0, 0.0)
    fill: tuple = (0.0, 0.0, 0.0)
    width: float = 1.0
    dashes: str = "[] 0"
    font: str = ""
    size: float = 0.0
    leading: float = 0.0

    def copy(self) -> State:
        return State(**self.__dict__)


def colour(values: list) -> tuple | None:
    """Gray as three equal parts, RGB as it is, CMYK as RGB."""
    v = [float(x) for x in values if isinstance(x, (int, float))]
    if len(v) == 4:
        return tuple(round((1 - c) * (1 - v[3]), 4) for c in v[:3])
    return tuple(round(c, 4) for c in (v * 3 if len(v) == 1 else v)) if len(v) in (1, 3) else None


class Interpreter:
    """Runs a content stream and leaves its paths and text on the page."""

    def __init__(self, document: Document, page: Page, ctm: Matrix) -> None:
        self.document, self.page, self.state = document, page, State(ctm)
        self.stack: list[State] = []
        self.layers: list[str | None] = []
        self.resources: dict = {}
        self.subpaths: list[tuple[list[Point], bool]] = []
        self.text = self.line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    def run(self, data: bytes, resources: dict, depth: int) -> None:
        parser, operands, get = Parser(data), [], self.document.get
        outer, self.resources = self.resources, resources
        while (t := parser.token()) is not None:
            value = parser.value(t)
            if not (isinstance(value, bytes) and not t[:1] in (b"(", b"<")):
                operands.append(value)
                continue
            op = value.decode("latin-1")
            if op == "BI":
                end = parser.data.find(b"EI", parser.at)
                parser.at = len(parser.data) if end < 0 else end + 2
            elif op == "Do" and depth < FORMS:
                form = get((get(resources.get("XObject")) or {}).get(operands[-1])) if operands else None
                if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                    saved = self.state.copy()
                    self.state.ctm = multiply(tuple(float(get(x)) for x in get(form.info.get("Matrix")) or (1, 0, 0, 1, 0, 0)), self.state.ctm)
                    self.run(form.data(), get(form.info.get("Resources")) or resources, depth + 1)
                    self.state = saved
                elif isinstance(form, Stream):
                    corners = [apply(self.state.ctm, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
                    self.page.paths.append(Path(corners, True, None, None, 0.0, "", self._layer(), "image"))
            elif op in ("BDC", "BMC"):
                self.layers.append(self._layer_name(operands, resources))
            elif op == "EMC":
                self.layers and self.layers.pop()
            else:
                self._operate(op, operands)
            operands = []
        self.resources = outer

    def _layer_name(self, operands: list, resources: dict) -> str | None:
        get = self.document.get
        if len(operands) == 2 and operands[0] == "OC" and isinstance(operands[1], Name):
            group = get((get(resources.get("Properties")) or {}).get(operands[1])) or {}
            name = get(group.get("Name")) if isinstance(group, dict) else None
            return name.decode("latin-1") if isinstance(name, bytes) else str(operands[1])
        return None

    def _layer(self) -> str | None:
        return next((x for x in reversed(self.layers) if x), None)

    def _operate(self, op: str, args: list) -> None:
        s = self.state
        at = lambda i: apply(s.ctm, float(args[i]), float(args[i + 1]))
        if op == "q":
            self.stack.append(s.copy())
        elif op == "Q":
            self.state = self.stack.pop() if self.stack else s
        elif op == "cm":
            s.ctm = multiply(tuple(map(float, args)), s.ctm)
        elif op == "w":
            s.width = float(args[0]) * abs(s.ctm[0] * s.ctm[3] - s.ctm[1] * s.ctm[2]) ** 0.5
        elif op == "d":
            s.dashes = "[" + " ".join(f"{x:g}" for x in args[0]) + f"] {args[1]:g}"
        elif op in ("RG", "G", "K", "SC", "SCN"):
            s.stroke = colour(args)
        elif op in ("rg", "g", "k", "sc", "scn"):
            s.fill = colour(args)
        elif op == "m":
            self.subpaths.append(([at(0)], False))
        elif op == "l" and self.subpaths:
            self._to([at(0)])
        elif op in ("c", "v", "y") and self.subpaths:
            here = self.subpaths[-1][0][-1]
            p1, p2, p3 = (at(0), at(2), at(4)) if op == "c" else (here, at(0), at(2)) if op == "v" else (at(0), at(2), at(2))
            self._to(self.document.chords(here, p1, p2, p3))
        elif op == "re":
            x, y, w, h = map(float, args)
            self.subpaths.append(([apply(s.ctm, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))], True))
        elif op == "h" and self.subpaths:
            self.subpaths[-1] = (self.subpaths[-1][0], True)
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
            self._paint(op)
        elif op == "BT":
            self.text = self.line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif op == "Tf":
            s.font, s.size = str(args[0]), float(args[1])
        elif op == "TL":
            s.leading = float(args[0])
        elif op == "Tm":
            self.text = self.line = tuple(map(float, args))
        elif op in ("Td", "TD", "T*"):
            if op == "TD":
                s.leading = -float(args[1])
            x, y = (0.0, -s.leading) if op == "T*" else map(float, args)
            self.text = self.line = multiply((1, 0, 0, 1, x, y), self.line)
        elif op in ("Tj", "TJ", "'", '"'):
            if op in ("'", '"'):
                self.text = self.line = multiply((1, 0, 0, 1, 0.0, -s.leading), self.line)
            self._show(args[-1] if isinstance(args[-1], list) else [args[-1]])

    def _to(self, points: list[Point]) -> None:
        done, closed = self.subpaths[-1]
        if closed:  # drawing goes on from the start of a closed sub-path
            self.subpaths.append(([done[0], *points], False))
        else:
            done += points

    def _paint(self, op: str) -> None:
        from math import hypot

        s = self.state
        stroke, fill = (s.stroke if op in "SsBb" or op[:1] in "Bb" else None), (s.fill if op[:1] in "fFBb" else None)
        for points, closed in self.subpaths if op != "n" else []:
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            if hypot(max(xs) - min(xs), max(ys) - min(ys)) < 1e-6:
                continue
            self.page.paths.append(Path(points, closed or op in ("s", "b", "b*"), stroke, fill, s.width, s.dashes, self._layer()))
        self.subpaths = []

    def _widths(self, raw: bytes) -> list[float]:
        """The advance of each byte in ems: what the font states, else half an em."""
        get = self.document.get
        font = get((get(self.resources.get("Font")) or {}).get(self.state.font)) or {}
        first, stated = get(font.get("FirstChar")), get(font.get("Widths")) or []
        missing = get((get(font.get("FontDescriptor")) or {}).get("MissingWidth"))
        other = missing / 1000 if isinstance(missing, (int, float)) else 0.5
        out = []
        for code in raw:
            at = code - first if isinstance(first, int) else -1
            width = get(stated[at]) if 0 <= at < len(stated) else None
            out.append(width / 1000 if isinstance(width, (int, float)) else other)
        return out

    def _show(self, parts: list) -> None:
        """Shows strings; numbers between them move back by thousandths of an em."""
        s, text, at, chars = self.state, "", 0.0, []
        m = multiply(self.text, s.ctm)
        for p in parts:
            if isinstance(p, bytes):
                for code, width in zip(p, self._widths(p), strict=True):
                    char = bytes([code]).decode("cp1252", "replace")
                    chars.append((char, at * s.size, width * s.size))
                    at += width
                    text += char
            elif isinstance(p, (int, float)):
                at -= p / 1000
        size = s.size * hypot(m[2], m[3])
        if text.strip():
            along = hypot(m[0], m[1])
            placed = [(c, *apply(m, x, 0.0), w * along) for c, x, w in chars]
            self.page.spans.append(Span(text, m[4], m[5], size, round(degrees(atan2(-m[1], m[0])) % 360, 1), s.font, at * s.size * along, placed))
        self.text = multiply((1, 0, 0, 1, s.size * at, 0), self.text)
