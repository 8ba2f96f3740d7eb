"""Small drawings as PDF files, for tests."""

import zlib
from math import hypot


def offset(a, b, d):
    length = hypot(b[0] - a[0], b[1] - a[1])
    nx, ny = -(b[1] - a[1]) / length * d, (b[0] - a[0]) / length * d
    return (a[0] + nx, a[1] + ny), (b[0] + nx, b[1] + ny)


def pdf(pages, width=1190.55, height=841.89, compress=True):
    """pages: lists of content lines, in points with y growing downwards through an outer matrix."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = []
    for i, lines in enumerate(pages):
        content = (f"1 0 0 -1 0 {height} cm\n" + "\n".join(lines)).encode("cp1252")
        data = zlib.compress(content) if compress else content
        objects[10 + 2 * i] = b"<< /Length %d%s >>\nstream\n" % (len(data), b" /Filter /FlateDecode" if compress else b"") + data + b"\nendstream"
        objects[11 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %f %f] /Contents %d 0 R /Resources << /Properties << /L0 << /Name (pipes) >> >> >> /Annots [<< /Subtype /Square /Rect [10 10 60 40] >>] >>" % (width, height, 10 + 2 * i)
        kids.append(b"%d 0 R" % (11 + 2 * i))
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in sorted(objects.items()))
    return body + b"trailer << /Root 1 0 R >>\n%%EOF"


def pipe(a, b, dn_mm, scale=50):
    """The two walls of a straight pipe, as content lines."""
    half = dn_mm / (25.4 / 72 * scale) / 2
    lines = ["0.35 w", "/OC /L0 BDC"]
    for d in (half, -half):
        (x0, y0), (x1, y1) = offset(a, b, d)
        lines.append(f"{x0:.4f} {y0:.4f} m {x1:.4f} {y1:.4f} l S")
    return [*lines, "EMC"]


#: Name, nominal size and centreline of the straight pipes of an A3 sheet at 1:50.
PIPES = [("S1-P2-160", 160, (170, 620), (760, 620)), ("S1-P2-75", 75, (330, 400), (200, 400)), ("S1-P2-110", 110, (600, 330), (830, 330))]


def sheet():
    lines = [line for _, dn, a, b in PIPES for line in pipe(a, b, dn)]
    for name, _, a, b in PIPES:
        x, y = (a[0] + b[0]) / 2, a[1] - 40
        lines += ["BT", "/F1 10 Tf", f"1 0 0 -1 {x} {y} Tm", f"({name}) Tj", "ET", "0.2 w", f"{x} {y} m {x} {a[1]} l S"]
    return [*lines, "0 0 1190 841 re S", "100 100 m 120 80 140 80 160 100 c S"]
