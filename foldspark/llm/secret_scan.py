"""Secret scanning with structural confirmation.

Three base kinds (assignments, access keys, hex runs) are reported by pattern.
Further candidates are only reported once their structure holds:

- ``jwt``: a signed token whose decoded header is a JSON object naming an
  algorithm and whose decoded payload is a JSON object;
- ``pem``: a private-key block whose decoded body is a key encoding;
- ``der``: a base64 or hex run that decodes to a key encoding, that is nested
  DER elements whose lengths fill their parents exactly in the layout of a
  private key, or an OpenSSH private key of length-prefixed fields.

Rows: null text counts as empty and has no spans; a null id is kept as it is;
repeated rows are scanned each for itself; an empty table gives no rows. Every
column of the input stays, ``spans`` is set anew."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()),
                              StructField("end", LongType())]))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ASSIGN_LEAST = 6
_ACCESS, _ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 20
# A run is maximal, so asking for the length in the pattern drops the same runs.
_HEX = re.compile(r"[0-9a-f]{24,}")
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){24,}(?![0-9A-Za-z])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s]+")
_OPENSSH = b"openssh-key-v1\0"
# DER tags.
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill ``data`` exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at:at + n], "big")
            if size < 0x80:  # a longer form than needed
                return None
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """Whether the bytes are a private key in DER or OpenSSH form."""
    if data.startswith(_OPENSSH):
        at, fields = len(_OPENSSH), 0
        while fields < 3:  # cipher, key derivation, its options
            size = int.from_bytes(data[at:at + 4], "big")
            if at + 4 + size > len(data):
                return False
            at, fields = at + 4 + size, fields + 1
        return len(data) >= at + 4 and 1 <= int.from_bytes(data[at:at + 4], "big") <= 16
    outer = _elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    inner = _elements(outer[0][1])
    if not inner:
        return False
    tags = [tag for tag, _ in inner]
    if tags[:1] == [_SEQUENCE] and tags[1:] == [_OCTETS]:  # encrypted: scheme and ciphertext
        scheme = _elements(inner[0][1])
        return bool(scheme) and scheme[0][0] == _OID and len(inner[1][1]) >= 16
    if tags[:1] != [_INTEGER] or len(inner[0][1]) != 1:
        return False
    if len(tags) >= 9 and set(tags[:9]) == {_INTEGER}:  # RSA: version and eight numbers
        return inner[0][1] in (b"\0", b"\1") and len(inner[1][1]) >= 32
    if len(tags) == 6 and set(tags) == {_INTEGER}:  # DSA: version, p, q, g, y, x
        return len(inner[1][1]) >= 32
    if tags[1:3] == [_SEQUENCE, _OCTETS]:  # PKCS 8: version, algorithm, key
        algorithm = _elements(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == _OID
    return tags[1:2] == [_OCTETS] and inner[0][1] == b"\1" and len(inner[1][1]) >= 16  # EC


def _from_base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _json_object(text: str) -> dict | None:
    data = _from_base64(text)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _is_token(text: str) -> bool:
    header, payload, _ = text.split(".")
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and _json_object(payload) is not None


def _key_blocks(text: str):
    at = 0
    while begin := _BEGIN.search(text, at):
        end = text.find("-----END", begin.end())
        if end < 0:
            return
        body = text[begin.end():end]
        if _BODY.fullmatch(body) and is_key(_from_base64("".join(body.split())) or b""):
            close = text.find("-----", end + 8)
            yield begin.start(), end if close < 0 else close + 5
        at = begin.end()


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text)
           if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)
                if len(m[0]) >= _ACCESS_LEAST]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "ey" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if _is_token(m[0])]
    if "-----BEGIN" in text:
        out += [("pem", *span) for span in _key_blocks(text)]
    for run in _RUN.finditer(text):
        if is_key(_from_base64(run[0]) or b""):
            out.append(("der", *run.span()))
            continue
        for m in _ANY_HEX.finditer(run[0]):
            if is_key(bytes.fromhex(m[0])):
                out.append(("der", run.start() + m.start(), run.start() + m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


@F.arrow_udf(SPANS)
def _find(texts: pa.Array) -> pa.Array:
    found = [find(t) if t else [] for t in texts.to_pylist()]
    flat = [s for spans in found for s in spans]
    columns = list(zip(*flat, strict=True)) if flat else [(), (), ()]
    offsets = [0]
    for spans in found:
        offsets.append(offsets[-1] + len(spans))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _SPAN_TYPE, strict=True)], fields=list(_SPAN_TYPE)))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``, the secrets found in the whole text."""
    return docs.withColumn("spans", _find(docs[text_col].cast("string")))


def redacted(text: str) -> str:
    """The text with every secret, overlapping ones together, replaced by a
    mark that names its first kind. A text without secrets stays as it is."""
    out, done, upto = [], 0, -1
    for kind, start, end in find(text):
        if start >= upto:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = upto = max(upto, end)
    return "".join([*out, text[done:]])


@F.pandas_udf(StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: redacted(t) if t else t)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced; nulls stay null."""
    return docs.withColumn(text_col, _redact(docs[text_col].cast("string")))
