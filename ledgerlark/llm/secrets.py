"""Secret scans: a worklist unwraps nested encodings until nothing new appears, and rescans each layer."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
# The patterns of the three kinds of secret. A run shorter than its least length can't
# hold a longer one, so the lengths stand in the patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

_PERCENT = r"%(?:25)+(?=[0-9A-Fa-f]{2})|%[0-9A-Fa-f]{2}"
_CODED = r"\\(?:u005[cC]|x5[cC])+(?=u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}"
_NAMED = r"&(?:amp;|#38;|#[xX]26;)+|&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&[A-Za-z][A-Za-z0-9]{1,31};"
#: Escaped escape characters (%2525, &amp;amp;) become one at once.
_ESCAPE = re.compile(f"{_PERCENT}|{_CODED}|{_NAMED}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+")
_PADDING = re.compile("={0,2}")
_BREAK = re.compile(r"\r?\n[ \t]*")
_STANDARD = str.maketrans("-_", "+/")
#: A run of fewer base64 characters can't hold a secret: the shortest has 14 characters.
LEAST_RUN = 16
#: Whether a decoded text can hold a secret or one more encoded part.
_WORTH = re.compile(r"AKIA|password|passwd|secret|token|api_?key|[0-9a-f]{32}|[A-Za-z0-9+/_\-\r\n\t ]{16}|[!-~]\x00|\x00[!-~]|" + _ESCAPE.pattern, re.I | re.A)
#: No secret and no encoded part goes over these places: characters that stand in none, and a space
#: between letters of which the first ends no escape.
_BOUNDARY = re.compile(r"(?<=[,(){}\[\]<>!?|*$@^~`\x80-\xff])|(?<=[G-Zg-z] )(?=[A-Za-z])")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]", re.S)
#: Decompressed bytes come in pieces of at most WINDOW. A stream is told from one that it is in by FIRST
#: bytes at most, of which LEAST_FIRST must be there. A stream that unpacks to ever new ones ends at DEEPEST.
WINDOW, SLICE, FIRST, LEAST_FIRST, DEEPEST = 1 << 20, 1 << 16, 4096, 64, 60


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each secret that stands in the text as it is."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _plain(escape: str) -> str:
    if escape[0] == "%":
        return chr(int(escape[1:], 16)) if len(escape) == 3 else "%"
    if escape[0] == "\\":
        return chr(int(escape[2:], 16)) if len(escape) == (6 if escape[1] == "u" else 4) else "\\"
    return "&" if _AMPERSANDS.fullmatch(escape) else html.unescape(escape)


_AMPERSANDS = re.compile(r"&(?:amp;|#38;|#[xX]26;)+")


class Layer(NamedTuple):
    """A text, and for each of its characters where its source starts and ends."""

    text: str
    starts: range | np.ndarray
    ends: range | np.ndarray


def _at(places: range | np.ndarray, which) -> np.ndarray:
    return places.start + np.asarray(which) if isinstance(places, range) else places[which]


def _unescaped(layer: Layer) -> Layer | None:
    """The whole layer with each escape replaced in place. Bytes of percent escapes become characters
    of the same number, as secrets and encodings hold ASCII only."""
    parts, first, last, at = [], [], [], 0
    for m in _ESCAPE.finditer(layer.text):
        plain = _plain(m[0])
        if plain == m[0]:
            continue
        parts += [layer.text[at : m.start()], plain]
        first += [*range(at, m.start()), *[m.start()] * len(plain)]
        last += [*range(at, m.start()), *[m.end() - 1] * len(plain)]
        at = m.end()
    if not parts:
        return None
    n = len(layer.text)
    return Layer("".join(parts) + layer.text[at:], _at(layer.starts, [*first, *range(at, n)]), _at(layer.ends, [*last, *range(at, n)]))


def _header(data: bytes, at: int = 0) -> bool:
    """Whether gzip or zlib data may start here."""
    if data[at : at + 3] == b"\x1f\x8b\x08":
        return True
    return len(data) > at + 1 and data[at] & 15 == 8 and data[at] >> 4 < 8 and (data[at] << 8 | data[at + 1]) % 31 == 0 and not data[at + 1] & 32


class Inflated:
    """A compressed stream from ``start`` on, with members that follow it at once: fed in pieces, scanned as it comes."""

    def __init__(self, start: int, above: tuple[bytes, ...]):
        self.start, self.used, self.live, self.rest = start, 0, True, b""
        self.z = zlib.decompressobj(47)
        self.sink = Sink(above)
        self.members, self.whole = {start}, 0

    def feed(self, data: bytes) -> None:
        for at in range(0, len(data), SLICE):
            if self.live:
                self._slice(data[at : at + SLICE])

    def _slice(self, data: bytes) -> None:
        data = self.rest + data
        self.rest = b""
        while self.live:
            if self.z is None:  # between members
                if len(data) < 3:
                    self.rest = data
                    return
                if not _header(data):
                    self.live = False
                    return
                self.z = zlib.decompressobj(47)
                self.members.add(self.start + self.used)
            before = self.z.copy()
            try:
                out = self.z.decompress(data, WINDOW)
            except zlib.error:
                self._to_error(before, data)
                return
            self.sink.feed(out)
            if self.z.eof:
                self.used += len(data) - len(self.z.unused_data)
                data, self.z, self.whole = self.z.unused_data, None, self.start + self.used
                continue
            self.used += len(data) - len(self.z.unconsumed_tail)
            data = self.z.unconsumed_tail
            if not data and len(out) < WINDOW:
                return

    def _to_error(self, z, data: bytes) -> None:
        """What stands before a broken place still counts."""
        self.live = False
        try:
            for k in range(len(data)):
                out = z.decompress(data[k : k + 1], WINDOW)
                self.used += 1
                while out:
                    self.sink.feed(out)
                    out = z.decompress(z.unconsumed_tail, WINDOW) if len(out) == WINDOW else b""
        except zlib.error:
            return


class Streams:
    """The compressed streams in bytes that come in pieces."""

    def __init__(self, above: tuple[bytes, ...], starts: tuple[int, ...] = (0,)):
        self.above, self.starts, self.at, self.tail = above, set(starts), 0, b""
        self.open: list[Inflated] = []
        self.all: list[Inflated] = []
        self.whole: list[tuple[int, int]] = []

    def feed(self, data: bytes, last: bool = False) -> None:
        for one in self.open:
            one.feed(data)
        taken = set().union(*(one.members for one in self.open))
        self.open = [one for one in self.open if one.live]
        hay, base = self.tail + data, self.at - len(self.tail)
        end = len(hay) if last else max(0, len(hay) - LEAST_FIRST + 1)
        places = {m.start() for m in _MAGIC.finditer(hay) if m.start() < end} | {p - base for p in self.starts if 0 <= p - base < end and _header(hay, p - base)}
        for p in sorted(places):
            first = hay[p : p + FIRST]
            if base + p in taken or len(self.above) >= DEEPEST or any(first[: len(x)] == x[: len(first)] for x in self.above):
                continue
            one = Inflated(base + p, (*self.above, first))
            one.feed(hay[p:])
            taken |= one.members
            self.all.append(one)
            if one.live:
                self.open.append(one)
        self.tail = hay[end:]
        self.at += len(data)

    def close(self) -> list[tuple[int, int, set]]:
        """(start, end, secrets inside) of each stream that holds some. What looks like a stream inside the
        bytes of one that came to its end is found in what that one unpacks to."""
        self.feed(b"", last=True)
        found, covered = [], 0
        for one in sorted(self.all, key=lambda one: one.start):
            if one.start >= covered and (inside := one.sink.close()):
                found.append((one.start, one.start + max(1, one.used), inside))
            if one.whole > covered:
                self.whole.append((one.start, one.whole))
                covered = one.whole
        return found


class Sink:
    """Scans decompressed bytes. What follows the last boundary waits for the next piece, so that no part
    is cut; the memory is that of a piece and of the longest stretch without a boundary."""

    def __init__(self, above: tuple[bytes, ...]):
        self.scan, self.streams = Scan(above), Streams(above)
        self.waiting, self.at = [], 0

    def feed(self, data: bytes) -> None:
        if not data:
            return
        self.streams.feed(data)
        text = data.decode("latin-1")
        cut, back = 0, 1024
        while not cut and back < 2 * len(text):
            cut = max((m.start() for m in _BOUNDARY.finditer(text, max(0, len(text) - back))), default=0)
            back *= 8
        if cut:
            self._scan(text[:cut])
        if text[cut:]:
            self.waiting.append(text[cut:])

    def _scan(self, text: str) -> None:
        text = "".join(self.waiting) + text
        self.waiting = []
        self.scan.text(text, self.at)
        self.at += len(text)

    def close(self) -> set:
        self._scan("")
        for start, end, inside in self.streams.close():
            self.scan.within(start, end, inside)
        return self.scan.found


class Scan:
    """Secrets of a text and of its layers: (kind, start, end, place). The place is () where the secret's own
    characters have a place in the text, else the nested (start, end) in the streams of compressed parts."""

    def __init__(self, above: tuple[bytes, ...] = ()):
        self.above, self.found = above, set()

    def within(self, start: int, end: int, inside: set) -> None:
        self.found.update((kind, start, end, (a, b, *place)) for kind, a, b, place in inside)

    def text(self, text: str, at: int = 0) -> None:
        """A worklist of layers. One that was seen at the same place is not opened again."""
        self.found.update((kind, at + a, at + b, ()) for kind, a, b in base_spans(text))
        if not _ESCAPE.search(text) and "\0" not in text and not any(len(m[0]) >= LEAST_RUN for m in _RUN.finditer(text)):
            return
        work, seen = [Layer(text, range(at, at + len(text)), range(at + 1, at + len(text) + 1))], set()
        while work:
            for layer in self._layers(work.pop(), seen):
                if not layer.text:
                    continue
                key = (int(layer.starts[0]), int(layer.ends[-1]), hashlib.blake2b(layer.text.encode(errors="surrogatepass"), digest_size=16).digest())
                if key not in seen:
                    seen.add(key)
                    self.found.update((kind, int(layer.starts[a]), int(layer.ends[b - 1]), ()) for kind, a, b in base_spans(layer.text))
                    work.append(layer)

    def _layers(self, layer: Layer, seen: set) -> Iterator[Layer]:
        if (plain := _unescaped(layer)) is not None:
            yield plain
        if "\0" in layer.text:  # UTF-16 and UTF-32 of ASCII
            kept = np.flatnonzero(np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
            yield Layer(layer.text.replace("\0", ""), _at(layer.starts, kept), _at(layer.ends, kept))
        for m in _RUN.finditer(layer.text):
            if len(m[0]) >= LEAST_RUN:
                yield from self._base64(layer, m, seen)

    def _base64(self, layer: Layer, m: re.Match, seen: set) -> Iterator[Layer]:
        """A run at its four alignments, as text before or after a part may belong to the alphabet."""
        body = _BREAK.sub("", m[0]).translate(_STANDARD)
        if len(body) < LEAST_RUN:
            return
        place = range(m.start(), m.end())
        if len(body) < len(m[0]):
            kept = np.ones(len(m[0]), dtype=bool)
            for x in _BREAK.finditer(m[0]):
                kept[x.start() : x.end()] = False
            place = m.start() + np.flatnonzero(kept)
        key = (int(layer.starts[place[0]]), int(layer.ends[place[-1]]), body)
        if key in seen:
            return
        seen.add(key)
        padded = m.end() + len(_PADDING.match(layer.text, m.end())[0])
        joints = {0, *(x.end() for x in re.finditer("[+/]", body)), *(() if isinstance(place, range) else (np.flatnonzero(np.diff(place) > 1) + 1).tolist())}
        decoded, covered = [], []
        for phase in range(4):
            part = body[phase : len(body) - ((len(body) - phase) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            source = lambda a, b, phase=phase: (_at(place, phase + 8 * a // 6), _at(place, phase + (8 * b - 1) // 6))
            streams = Streams(self.above, tuple((j - phase) // 4 * 3 for j in joints if j >= phase and j % 4 == phase))
            streams.feed(data)
            for a, b, inside in streams.close():
                x, y = source(a, b)
                self.within(int(layer.starts[x]), int(layer.ends[padded - 1 if y == m.end() - 1 else y]), inside)
            decoded.append((data, source))
            covered += [(phase + 8 * a // 6, phase + (8 * b + 5) // 6) for a, b in streams.whole]
        for phase, (data, source) in enumerate(decoded):
            for a, b in covered:  # compressed bytes, checked by their sums, are no text at any alignment
                a, b = max(0, (6 * (a - phase) + 7) // 8), max(0, 6 * (b - phase) // 8)
                data = data[:a] + b"\x80" * (min(b, len(data)) - a) + data[b:]
            if _WORTH.search(text := data.decode("latin-1")):
                x, y = source(np.arange(len(data)), np.arange(1, len(data) + 1))
                yield Layer(text, _at(layer.starts, x), _at(layer.ends, y))


def all_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``base``, and one span for each secret in decoded layers: where the encoded characters stand that
    gave it, for a secret in compressed data those of the whole compressed part."""
    scan = Scan()
    scan.text(text)
    return ordered([s[:3] for s in scan.found | {(*b, ()) for b in base}])


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.string())]))


def _scan(batches):
    for batch in batches:
        ids, found = batch.column(0), []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = ordered(base_spans(text))
            held = set(base)
            found.append([{"kind": k, "start": a, "end": b, "layer": "text" if (k, a, b) in held else "decoded"} for k, a, b in all_spans(text, base)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(found, _SPAN)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end, layer), ordered by start and kind.

    Spans of layer 'text' are the secrets that stand in the whole text, per kind leftmost and
    non-overlapping, at their character offsets. Spans of layer 'decoded' are secrets that appear once
    nested percent, Unicode or character-reference escapes, base64 and gzip or zlib data are
    unwrapped, one for each secret, at the encoded characters that gave it; secrets in compressed data
    have the offsets of the outermost compressed part, once each. Decompressed data is scanned in pieces
    of about 1 MB that end where no part does, so a small input that inflates to much stays within memory
    unless it inflates to one endless run.

    A null text is empty. Null ids and repeated rows keep a row each; an empty table gives none; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,layer:string>>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["layer"] == "text")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))
