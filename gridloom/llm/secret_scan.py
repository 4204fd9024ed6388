"""Secrets in texts: patterns for assignments, access ids and long hex runs, and a structural scan for encoded keys.

The structural scan takes base64 and hex runs whose first characters can open a key, decodes them and reports them
only if the bytes are a private key all the way down: DER with definite lengths that tile each level (PKCS #1, PKCS #8
plain and encrypted, SEC 1, DSA), or the OpenSSH container with its nested length-prefixed strings. A key says itself
where it ends, so text that follows a run does no harm and public keys and certificates are left alone. A signed
token is reported if its header decodes to a JSON object that names an algorithm and its signature has that
algorithm's length.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pick

#: kinds found by pattern alone, then those confirmed by structure; ties of the start stand in this order
BASE, CONFIRMED = ("assign", "access", "hex"), ("key", "signed")
KINDS = {kind: k for k, kind in enumerate(BASE + CONFIRMED)}
#: fewest characters of an assigned value
VALUE = 6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a maximal run of at least so many characters
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")

# the first six bits of a DER sequence are an M; line breaks of a body may be written out as \n
_BREAK = re.compile(r"\r?\n|(?:\\r)?\\n")
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\n))(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/]{14,}(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/]+)*={0,2}")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]7631)[0-9A-Fa-f]{46,}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 2, 3, 4, 6, 0x30
_OPENSSH = b"openssh-key-v1\0"
# fixed values: object identifiers in DER
_RSA = bytes.fromhex("2a864886f70d010101")
_EC = bytes.fromhex("2a8648ce3d0201")
_CURVE_25519_448 = (bytes.fromhex("2b656e"), bytes.fromhex("2b656f"), bytes.fromhex("2b6570"), bytes.fromhex("2b6571"))
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
# fixed values: bytes of a signature by algorithm
_SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
_RSA_SIGNATURES = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")


class _Malformed(ValueError):
    pass


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the content of the DER element at ``at``; its length must be definite, minimal and inside."""
    if at + 2 > end or data[at] & 0x1F == 0x1F:
        raise _Malformed
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        many = size & 0x7F
        size, start = int.from_bytes(data[start : start + many], "big"), start + many
        if not 1 <= many <= 4 or start > end or size < max(0x80, 1 << 8 * (many - 1)):
            raise _Malformed
    if start + size > end:
        raise _Malformed
    return tag, start, start + size


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    found = []
    while at < end:
        found.append(_element(data, at, end))
        at = found[-1][2]
    return found


def _sequence(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    tag, start, stop = _element(data, at, end)
    if tag != _SEQUENCE or stop != end:
        raise _Malformed
    return _children(data, start, stop)


def _integers(data: bytes, items: list) -> bool:
    """All are INTEGERs that are not empty, not negative and written in as few bytes as possible."""
    return all(
        tag == _INTEGER and a < b and data[a] < 0x80 and (b - a == 1 or data[a] or data[a + 1] >= 0x80) for tag, a, b in items
    )


def _der_key(data: bytes) -> str:
    """Format of the private key that ``data`` is."""
    items = _sequence(data, 0, len(data))
    tags = [t for t, _, _ in items]
    content = [data[a:b] for _, a, b in items]
    if _integers(data, items):
        if len(items) == 9 and content[0] == b"\0":
            return "pkcs1"
        if len(items) == 6 and content[0] == b"\0":
            return "dsa"
    if len(items) == 10 and content[0] == b"\1" and tags[-1] == _SEQUENCE and _integers(data, items[:9]):
        return "pkcs1"  # of more than two primes
    if tags[:2] == [_INTEGER, _OCTETS] and content[0] == b"\1" and 16 <= len(content[1]) <= 72 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "sec1"
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and content[0] in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        kind = _children(data, *items[1][1:])
        if not kind or kind[0][0] != _OID or not content[2]:
            raise _Malformed
        oid, inner = data[slice(*kind[0][1:])], content[2]
        if oid == _RSA and _der_key(inner) != "pkcs1" or oid == _EC and _der_key(inner) != "sec1":
            raise _Malformed
        if oid in _CURVE_25519_448 and _element(inner, 0, len(inner)) != (_OCTETS, 2, len(inner)):
            raise _Malformed
        return "pkcs8"
    if tags == [_SEQUENCE, _OCTETS] and content[1]:
        kind = _children(data, *items[0][1:])
        if kind and kind[0][0] == _OID and data[slice(*kind[0][1:])].startswith(_PASSWORD_BASED):
            return "pkcs8-encrypted"
    raise _Malformed


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    size = int.from_bytes(data[at : at + 4], "big")
    if at + 4 + size > len(data):
        raise _Malformed
    return data[at + 4 : at + 4 + size], at + 4 + size


def _openssh_key(data: bytes) -> int:
    """Bytes of the OpenSSH container at the start of ``data``."""
    at = len(_OPENSSH)
    cipher, at = _string(data, at)
    scheme, at = _string(data, at)
    _, at = _string(data, at)
    many, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not cipher.isascii() or (cipher == b"none") != (scheme == b"none") or not 1 <= many <= 64:
        raise _Malformed
    for _ in range(many):
        public, at = _string(data, at)
        name, _ = _string(public, 0)
        if not re.match(rb"(ssh|ecdsa|sk)-", name):
            raise _Malformed
    secret, at = _string(data, at)
    if not secret or len(secret) % 8 or cipher == b"none" and secret[:4] != secret[4:8]:
        raise _Malformed
    return at


def key_in(data: bytes, more=lambda n: b"") -> tuple[str, int] | None:
    """Format and size of the private key at the start of ``data``, else None; ``more(n)`` gives the first n bytes."""
    try:
        if data.startswith(_OPENSSH):
            return "openssh", _openssh_key(more(-1) or data)
        if data[:1] != b"\x30" or len(data) < 8:
            return None
        long = data[1] & 0x7F if data[1] >= 0x80 else 0
        if long > 4:
            return None
        size = 2 + long + (int.from_bytes(data[2 : 2 + long], "big") if long else data[1])
        whole = (more(size) or data)[:size]
        return (_der_key(whole), size) if len(whole) == size else None
    except (_Malformed, IndexError, RecursionError):
        return None


def _base64_key(text: str, match: re.Match) -> tuple[int, str] | None:
    """End and format of the key that the run of base64 characters holds."""
    lo, run = match.start(), match.group().rstrip("=")
    breaks = [m.span() for m in _BREAK.finditer(run)]
    # characters of the run before each part, and where the part starts
    starts = [0, *(b for _, b in breaks)]
    ends = [*(a for a, _ in breaks), len(run)]
    counts, total = [], 0
    for a, b in zip(starts, ends):
        counts.append(total)
        total += b - a
    chars = run if not breaks else "".join(run[a:b] for a, b in zip(starts, ends))

    def decoded(n: int) -> bytes:
        """The first ``n`` bytes, or all."""
        part = chars if n < 0 else chars[: -(-n * 8 // 6)]
        part = part[: len(part) - (len(part) % 4 == 1)]  # a lone last character holds no byte
        return base64.b64decode(part + "==="[: -len(part) % 4])

    found = key_in(decoded(24), decoded)
    if not found:
        return None
    last = -(-found[1] * 8 // 6) - 1
    part = bisect.bisect_right(counts, last) - 1
    end = lo + starts[part] + last - counts[part] + 1
    padding = -(last + 1) % 4
    while padding and text[end : end + 1] == "=":
        end, padding = end + 1, padding - 1
    return end, found[0]


def _hex_key(match: re.Match) -> tuple[int, str] | None:
    run = match.group()[: len(match.group()) // 2 * 2]
    found = key_in(binascii.unhexlify(run[:48]), lambda n: binascii.unhexlify(run[: 2 * n] if n >= 0 else run))
    return found and (match.start() + 2 * found[1], found[0])


def _segment(text: str) -> bytes | None:
    return None if len(text) % 4 == 1 else base64.urlsafe_b64decode(text + "==="[: -len(text) % 4])


def signed_token(header: str, payload: str, signature: str) -> str | None:
    """The algorithm of a signed token, or None if the parts are none."""
    parts = [_segment(x) for x in (header, payload, signature)]
    if None in parts:
        return None
    try:
        named = json.loads(parts[0])
    except (ValueError, RecursionError):
        return None
    algorithm = named.get("alg") if isinstance(named, dict) else None
    if not isinstance(algorithm, str) or not algorithm:
        return None
    size = len(parts[2])
    if algorithm in _SIGNATURES:
        return algorithm if size in _SIGNATURES[algorithm] else None
    if algorithm in _RSA_SIGNATURES:
        return algorithm if size >= 128 else None
    return algorithm if (size > 0) != (algorithm.lower() == "none") else None


def secrets(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, format)`` in the order of start and kind; code points, end exclusive."""
    found = [(m.start(), m.end(), "assign", m[1].lower()) for m in _ASSIGN.finditer(text) if len(m[2]) >= VALUE]
    found += [(m.start(), m.end(), "access", "aws") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", "") for m in _HEX.finditer(text)]
    for m in _BASE64.finditer(text):
        if key := _base64_key(text, m):
            found.append((m.start(), key[0], "key", key[1]))
    for m in _HEX_KEY.finditer(text):
        if key := _hex_key(m):
            found.append((m.start(), key[0], "key", key[1]))
    for m in _SIGNED.finditer(text):
        if algorithm := signed_token(m[1], m[2], m[3]):
            found.append((m.start(), m.end(), "signed", algorithm))
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, secrets`` for every row: an array of ``start, end, kind, format``, whole texts, code points.

    A null or empty text has no secrets. Matches of one pattern do not overlap, those of different kinds may. Repeated
    rows each get their own. Other columns of ``docs`` play no part.
    """
    rows = pick(docs, doc_id=id_column, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("format", pa.string())])
        names = ("start", "end", "kind", "format")
        for batch in batches:
            found = [[dict(zip(names, s)) for s in secrets(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(place))], ["doc_id", "secrets"])

    return rows.mapInArrow(scan, f"doc_id {kind}, secrets array<struct<start:bigint,end:bigint,kind:string,format:string>>")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping ones by one. A null text stays null."""

    def cut(value: str) -> str:
        parts, at = [], 0
        for start, end, *_ in secrets(value):
            if start >= at:
                parts += [value[at:start], mask]
            at = max(at, end)
        return "".join([*parts, value[at:]])

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(cut, na_action="ignore")

    return docs.withColumn(text, masked(F.col(f"`{text}`")))


def of_kind(column: str, *kinds: str) -> Column:
    return F.filter(column, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column | str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
