"""Secret scans with multipart credential linking.

Certain findings stand alone: assignments to names such as password, access identifiers and long hex strings. Weak
parts (account identifiers, random-looking strings, endpoints) say little alone. They are linked within one scope, a
paragraph of any length: a weak part is reported only where complementary parts co-occur in it, beside the part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, batch_of, carried, chunks, freed, together

KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
BASE = KINDS[:3]
MASK = "[secret]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENT = re.compile(r"""(?:client_?id|user(?:name)?|login|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.I | re.A)
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
ADDRESS = re.compile(r"""[^\s"'<>]{4,}""", re.A)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_IDENTS = ("client", "user", "login", "account", "access")


def base_spans(text: str, lower: str | None = None) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough, by start, then kind."""
    lower = text.lower() if lower is None else lower
    out = []
    # Lower-casing may lengthen a text but keeps its ASCII letters, so a name that isn't in it isn't in the text.
    if any(n in lower for n in _NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _random_looking(s: str) -> bool:
    classes = sum(any(f(c) for c in s) for f in (str.islower, str.isupper, str.isdigit))
    bits = -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())
    return classes >= 2 and any(map(str.isdigit, s)) and bits >= 3.0


def _ends(parts: list[tuple[str, int, int]], scope: list[int]) -> dict[int, tuple[int, int]]:
    """The least end and the greatest start of the parts of each scope."""
    out: dict[int, tuple[int, int]] = {}
    for _, a, b in parts:
        k = bisect_right(scope, a)
        least, most = out.get(k, (b, a))
        out[k] = min(least, b), max(most, a)
    return out


def endpoints(text: str) -> list[tuple[str, int, int]]:
    """Addresses: a scheme of SCHEME's signs from its first letter on, ``://`` and four signs or more; leftmost first.

    Each scheme is walked back over once from its ``://``, so time follows the text's length.
    """
    out, last, at = [], 0, text.find("://")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in SCHEME:
            start -= 1
        while start < at and not "a" <= text[start] <= "z":
            start += 1
        rest = ADDRESS.match(text, at + 3) if start < at else None
        if rest:
            out.append(("endpoint", start, last := rest.end()))
        at = text.find("://", rest.end() if rest else at + 3)
    return out


class _Taken:
    """Spans joined into disjoint ones, so whether another meets any takes one search."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, span: tuple[str, int, int]) -> bool:
        i = bisect_left(self.starts, span[2]) - 1
        return i < 0 or self.ends[i] <= span[1]


def linked_spans(text: str, base: list[tuple[str, int, int]], lower: str | None = None) -> list[tuple[str, int, int]]:
    """The weak parts that complement each other or a certain finding."""
    lower = text.lower() if lower is None else lower
    free = _Taken(base).free
    ident = list(filter(free, (("ident", *m.span()) for m in IDENT.finditer(text)))) if any(n in lower for n in _IDENTS) else []
    ends = list(filter(free, endpoints(text)))
    ids = ident + [s for s in base if s[0] == "access"]
    if not ids and not ends:
        return []
    free = _Taken(base + ident + ends).free
    weak = [s for m in WEAK.finditer(text) if free(s := ("weak", *m.span())) and _random_looking(m[0])]
    scope = [m.start() for m in re.finditer(r"\n\s*\n", text)]

    def keep(parts, *others):
        # Some part of a scope lies beside ``p`` just if its first end or its last start does.
        ends = [_ends(some, scope) for some in others]
        found = [[(p, e.get(bisect_right(scope, p[1]))) for p in parts] for e in ends]
        return [p for i, p in enumerate(parts) if all(x[i][1] and (x[i][1][0] <= p[1] or x[i][1][1] >= p[2]) for x in found)]

    # A random-looking string needs who or where it is for; who and where need something secret beside them.
    weak = keep(weak, ids + ends)
    secrets = weak + [s for s in base if s[0] != "access"]
    return weak + keep(ident, secrets) + keep(ends, secrets)


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, mask: bool = False) -> DataFrame:
    """secrets: array of (kind, start, end) in code points, by start, then kind; with ``mask`` also the text redacted.

    A null or empty text has none, and its redacted form is itself. Overlapping spans are masked as one. Repeated
    rows each get their row; an input column with an output's name gives way to it.
    """
    own = ("secrets", "redacted") if mask else ("secrets",)
    names, ddl = carried(docs, carry, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for batch in chunks(whole, text):
                found, clean = [], []
                for t in batch.column(text).to_pylist():
                    lower = (t or "").lower()
                    base = base_spans(t or "", lower)
                    spans = sorted(base + linked_spans(t or "", base, lower), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                    found.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                    clean.append(_redacted(t, spans))
                new = {"secrets": pa.array(found, kind)} | ({"redacted": pa.array(clean, pa.string())} if mask else {})
                yield batch_of(batch, names, **new)

    kind = "secrets array<struct<kind: string, start: int, end: int>>"
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(freed(run), f"{ddl}{kind}" + ", redacted string" * mask)


def _redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every secret replaced by MASK; n_chars, where there is one, follows the new text."""
    done = scan(apart(docs, text), "text", ["text", "row"], mask=True)
    new = {text: F.col("redacted")}
    if "n_chars" in docs.columns and text != "n_chars":
        new["n_chars"] = F.when(F.size("secrets") > 0, F.length("redacted")).otherwise(F.col("row.n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return together(done, docs.columns, text, new)
