"""Secret scans through nested encodings by a recursive worklist.

A text is the first layer. Each layer taken from the worklist is scanned, then unwrapped in every way that applies:
percent escapes, Unicode and character escapes, base64 runs, and compressed bytes (gzip, zlib, bzip2, xz, zstandard).
What comes out is a new layer with a map from its characters to the span of the text they stand for, and goes on the
worklist unless the same content was already seen over the same span (cycle detection); the work ends at the fixpoint.
A match of any layer is reported over the span of the text that it maps to. Escapes map character by character, base64
by its 6-bit groups, compressed bytes as a whole.

Matches of the first layer are the base; spans of deeper layers are added to them, each (kind, start, end) once.
Offsets are code points, ends exclusive. A chain of escaped escapes (``%252541``) is resolved in one step, so nesting
costs no layer for each level. ``LARGEST`` bounds the bytes of one unpacked stream, which keeps a decompression bomb from
taking the executor; a stream beyond it is not unwrapped and counted in ``n_unopened``, never dropped silently.

Edge cases: a null or empty text has no spans; rows are independent, so repeats, ties and empty tables need no care;
texts of any length are scanned whole; escapes that are no characters become U+FFFD; a result column replaces an input column of its name.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import table, with_columns

KINDS = ("assign", "access", "hex")
#: Bytes of one unpacked stream beyond which it stays closed.
LARGEST = 1 << 26

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
# one escape each, with the escapes of its own escape character before it
_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(
    r"\\+(?:u005[cC])*(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))"
    r"|&(?:amp;)*(?:#(\d{1,7});|#[xX]([0-9A-Fa-f]{1,6});|(quot|apos|lt|gt|amp);)"
    r"|\\+([\"'/])"
)
_NAMED = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "amp": "&"}
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]+={0,2}")
# compressed bytes written as escapes: a stream's first bytes and all up to white space or a quote
_P, _X = r"%(?:25)*", r"\\+x"
_ESCAPED_BYTES = re.compile(
    rf"""(?:{_P}1[fF]{_P}8[bB]|(?:x|{_P}78){_P}(?:01|5[eE]|9[cC]|[dD][aA])|(?:\(|{_P}28){_P}[bB]5(?:/|{_P}2[fF]){_P}[fF][dD]|{_P}[fF][dD](?:7zXZ|{_P}37)|(?:B|{_P}42)(?:Z|{_P}5[aA])(?:h|{_P}68)"""
    rf"""|{_X}1[fF]{_X}8[bB]|(?:x|{_X}78){_X}(?:01|5[eE]|9[cC]|[dD][aA])|(?:\(|{_X}28){_X}[bB]5|{_X}[fF][dD](?:7zXZ|{_X}37)|(?:B|{_X}42)(?:Z|{_X}5[aA])(?:h|{_X}68))[!#-&(-~]+"""
)
_ONE_BYTE = re.compile(r"(?:%|\\+x)([0-9A-Fa-f]{2})|([\x20-\x7e])")
_ONE_NESTED = re.compile(r"(?:%(?:25)*|\\+x)([0-9A-Fa-f]{2})|([\x20-\x7e])")
_PRINTED = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
_UNPRINTED = re.compile(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f]")
_SURROGATE = re.compile("[\ud800-\udfff]")
_SIX = bytes.maketrans(b"-_", b"+/")


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, number of the kind, end), of each kind leftmost and without overlaps."""
    low = text.lower()
    if any(w in low for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield m.start(), 0, m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield m.start(), 1, m.end()
    for m in _HEX.finditer(text):
        yield m.start(), 2, m.end()


class Layer:
    """Text or bytes with the spans of the original text: of each character (arrays) or of the whole (two numbers)."""

    __slots__ = ("data", "lo", "hi")

    def __init__(self, data: str | bytes, lo, hi):
        self.data, self.lo, self.hi = data, lo, hi

    def span(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return int(self.lo[a]), int(self.hi[b - 1])

    def key(self) -> tuple:
        data = self.data
        raw = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
        return isinstance(data, str), hashlib.sha256(raw).digest(), *(self.span(0, len(data)) if len(data) else (0, 0))


def _spans(layer: Layer, at: np.ndarray, end: np.ndarray) -> tuple:
    """Spans of new characters that stand for ``at`` to ``end`` of the layer."""
    if isinstance(layer.lo, int):
        return layer.lo, layer.hi
    return layer.lo[at], layer.hi[end - 1]


def _as_text(raw: bytes) -> str | None:
    if not raw or _UNPRINTED.search(raw):
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _text_layer(layer: Layer, text: str, size: np.ndarray, at: np.ndarray, end: np.ndarray) -> Layer:
    """A layer of decoded bytes: byte k stands for ``at[k]`` to ``end[k]``, and each character for its ``size`` bytes."""
    stop = np.cumsum(size)
    return Layer(text, *_spans(layer, at[stop - size], end[stop - 1]))


def _sizes(text: str) -> np.ndarray:
    """Bytes of each character; one for an undecodable byte (U+DC80 to U+DCFF)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return 1 + ((code > 0x7F) & (code >> 8 != 0xDC)) + ((code > 0x7FF) & (code >> 8 != 0xDC)) + (code > 0xFFFF)


def percent_decoded(layer: Layer) -> Layer | None:
    """The text with its percent escapes resolved; bytes that are not UTF-8 become lone surrogates."""
    text, found = layer.data, []
    at, end, last = [], [], 0
    for m in _PERCENT.finditer(text):
        a, b = m.span()
        plain = text[last:a].encode("utf-8", "surrogateescape")
        if plain:
            size = _sizes(text[last:a])
            where = np.repeat(np.arange(last, a), size)
            at.append(where)
            end.append(where + 1)
        found += [plain, bytes([int(m.group(1), 16)])]
        at.append(np.array([a]))
        end.append(np.array([b]))
        last = b
    if not found:
        return None
    found.append(text[last:].encode("utf-8", "surrogateescape"))
    where = np.repeat(np.arange(last, len(text)), _sizes(text[last:]))
    at, end = np.concatenate([*at, where]), np.concatenate([*end, where + 1])
    out = b"".join(found).decode("utf-8", "surrogateescape")  # an undecodable byte is one character
    return _text_layer(layer, out, _sizes(out), at, end)


def unescaped(layer: Layer) -> Layer | None:
    """The text with its Unicode, byte and character-reference escapes resolved."""
    text, out, at, end, last = layer.data, [], [], [], 0
    for m in _ESCAPE.finditer(text):
        digits = next((g for g in m.group(1, 2, 3, 4, 6) if g), None)
        if m.group(7) or m.group(8):
            char = m.group(8) or _NAMED[m.group(7)]
        else:
            code = int(m.group(5)) if m.group(5) else int(digits, 16)
            if code > 0x10FFFF:
                continue
            char = chr(code)
        a, b = m.span()
        if out and last == a and "\ud800" <= out[-1] < "\udc00" <= char < "\ue000":  # a surrogate pair is one character
            out[-1] = chr(0x10000 + (ord(out[-1]) - 0xD800) * 1024 + ord(char) - 0xDC00)
            end[-1] = np.array([b])
        else:
            where = np.arange(last, a)
            out += [text[last:a], char]
            at += [where, np.array([a])]
            end += [where + 1, np.array([b])]
        last = b
    if not out:
        return None
    where = np.arange(last, len(text))
    plain = _SURROGATE.sub("\ufffd", "".join(out) + text[last:])
    return Layer(plain, *_spans(layer, np.concatenate([*at, where]), np.concatenate([*end, where + 1])))


def _stream(raw: bytes, most: int) -> bytes | None:
    """The bytes inside a compressed stream; None if there is none. Raises OverflowError beyond ``most`` bytes."""
    if raw[:2] == b"\x1f\x8b":
        make = lambda: zlib.decompressobj(31)
    elif len(raw) > 2 and raw[0] & 15 == 8 and not (raw[0] * 256 + raw[1]) % 31:
        make = zlib.decompressobj
    elif raw[:3] == b"BZh":
        make = bz2.BZ2Decompressor
    elif raw[:6] == b"\xfd7zXZ\x00":
        make = lzma.LZMADecompressor
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        try:
            with zstandard.ZstdDecompressor().stream_reader(raw) as reader:
                out = reader.read(most + 1)
        except (zstandard.ZstdError, MemoryError):
            return None
        if len(out) > most:
            raise OverflowError
        return out
    else:
        return None
    # members may follow each other; a damaged or cut stream gives what can be read
    out, rest = b"", raw
    while rest:
        reader = make()
        try:
            out += reader.decompress(rest, most + 1 - len(out))
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
        if len(out) > most:
            raise OverflowError
        rest = reader.unused_data if reader.eof else b""
    return out or None


def _six_bits(digits: bytes) -> bytes:
    return base64.b64decode(digits + b"=" * (-len(digits) % 4))


def _escaped_streams(layer: Layer) -> Iterator[Layer]:
    """Compressed bytes written as percent or byte escapes."""
    for m in _ESCAPED_BYTES.finditer(layer.data):
        for one in (_ONE_BYTE, _ONE_NESTED) if "%25" in m.group() else (_ONE_BYTE,):
            raw = b"".join(bytes([int(x.group(1), 16)]) if x.group(1) else x.group(2).encode() for x in one.finditer(m.group()))
            yield Layer(raw, *layer.span(*m.span()))


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    """Decoded base64 runs that are text or a compressed stream."""
    text = layer.data
    runs = [m.span() for m in _BASE64.finditer(text)] + [m.span() for m in _WRAPPED.finditer(text)]
    for a, b in runs:
        digits = np.frombuffer(text[a:b].encode("ascii"), np.uint8)
        where = np.flatnonzero((digits != 10) & (digits != 13) & (digits != 61))
        use = len(where) - (len(where) % 4 == 1)
        code = digits[where].tobytes().translate(_SIX)
        raw = _six_bits(code[:use])
        plain = _as_text(raw)
        if plain is not None:
            byte = np.arange(len(raw))
            yield _text_layer(layer, plain, _sizes(plain), a + where[byte * 8 // 6], a + where[(byte * 8 + 7) // 6] + 1)
            continue
        if raw[:1] in b"\x1f\x28\xfdB" or raw[0] & 15 == 8:
            yield Layer(raw, *layer.span(a, b))
        # the run may begin with other letters: readable stretches at each of the four alignments
        for shift in range(4):
            digits_ = code[shift : len(code) - ((len(code) - shift) % 4 == 1)]
            for m in _PRINTED.finditer(_six_bits(digits_)):
                byte = np.arange(m.start(), m.end())
                at, end = a + where[shift + byte * 8 // 6], a + where[shift + (byte * 8 + 7) // 6] + 1
                yield Layer(m.group().decode("ascii"), *_spans(layer, at, end))


def unwrapped(layer: Layer, most: int = LARGEST) -> Iterator[Layer]:
    """The layers directly inside a layer. Raises OverflowError for a stream of more than ``most`` bytes."""
    data = layer.data
    if isinstance(data, bytes):
        inner = _stream(data, most)
        if inner is not None:
            text = _as_text(inner)
            yield Layer(inner if text is None else text, layer.lo, layer.hi)
        return
    if "%" in data:
        inner = percent_decoded(layer)
        if inner is not None:
            yield inner
    if "\\" in data or "&" in data:
        inner = unescaped(layer)
        if inner is not None:
            yield inner
    if "%" in data or "\\x" in data:
        yield from _escaped_streams(layer)
    yield from _base64_layers(layer)


_SIGN = re.compile(r"""%[0-9A-Fa-f]{2}|\\[uUx"'/]|&(?:#|quot;|apos;|lt;|gt;|amp;)|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}""")


def _wraps(text: str) -> bool:
    """Whether any way of unwrapping may apply."""
    return _SIGN.search(text) is not None


def scan(text: str | None, most: int = LARGEST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base, all spans, unopened streams): sorted (start, number of the kind, end)."""
    if not text:
        return [], [], 0
    base = sorted(matches(text))
    spans, closed = set(base), 0
    where = np.arange(len(text) + 1) if _wraps(text) else None
    if where is None:
        return base, base, 0
    work = [Layer(text, where[:-1], where[1:])]
    seen = {work[0].key()}
    while work:
        layer = work.pop()
        try:
            for inner in unwrapped(layer, most):
                key = inner.key()
                if key in seen:
                    continue
                seen.add(key)
                work.append(inner)
                if isinstance(inner.data, str):
                    for a, kind, b in matches(inner.data):
                        lo, hi = inner.span(a, b)
                        spans.add((lo, kind, hi))
        except OverflowError:
            closed += 1
    return base, sorted(spans), closed


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def scan_secrets(df: DataFrame, text: str = "text", largest: int = LARGEST) -> DataFrame:
    """``df`` with ``base`` and ``spans`` (arrays of (start, kind as a number of ``KINDS``, end), sorted) and ``n_unopened``."""

    def found(texts: pa.Array) -> pa.Array:
        cell = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        rows = [scan(t, largest) for t in texts.to_pylist()]
        lists = [[[{"start": a, "kind": k, "end": b} for a, k, b in r[n]] for r in rows] for n in (0, 1)]
        return pa.StructArray.from_arrays([pa.array(lists[0], cell), pa.array(lists[1], cell), pa.array([r[2] for r in rows], pa.int32())], ["base", "spans", "n_unopened"])

    found.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    cells = with_columns(df, {"__s": F.arrow_udf(found, f"struct<base:{_SPAN},spans:{_SPAN},n_unopened:int>")(df[text].cast("string"))})
    return with_columns(cells, {"base": cells["__s.base"], "spans": cells["__s.spans"], "n_unopened": cells["__s.n_unopened"]}).drop("__s")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: int) -> Column:
    """Spans of one kind (a second argument of the lambda would be the span's index)."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op13_secrets(spark, sf_dir) -> DataFrame:
    rows = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = [number_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *count, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_unopened")
