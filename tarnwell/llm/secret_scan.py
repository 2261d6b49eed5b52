"""Secret scan with structural confirmation.

Three plain patterns give the base spans. The method then looks at what could be an
encoded key or token: runs of base64 or hex, on one line or over several, key files and
dotted parts. It decodes them and reports only those whose inside has the right structure:
ASN.1 keys whose nested lengths all add up (RSA, DSA, EC, PKCS#8, encrypted PKCS#8),
OpenSSH keys whose length-prefixed fields end where the data ends, key files that say how
they are encrypted and hold whole blocks, and tokens whose header is a JSON object naming
an algorithm, with claims that are one too or with the five parts of an encrypted token.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import in_small_batches, let_go

KINDS = ("assign", "access", "hex", "jwt", "der_key", "ssh_key")
#: The base patterns, and what must follow for a match to count.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PART = re.compile(r"[A-Za-z0-9_-]*")
PART_LETTERS = string.ascii_letters + string.digits + "_-"
PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]{0,30})-----((?:(?:\s|\\[nr])*[A-Za-z][A-Za-z0-9-]*:[^\n\\]*(?=\n|\\n))*)"
    r"([A-Za-z0-9+/=\s\\]+)-----END [A-Z0-9 ]{0,30}-----"
)
CIPHER = re.compile(r"DEK-Info:[ \t]*([A-Za-z0-9-]+),([0-9A-Fa-f]+)[ \t\r]*(?:$|\n|\\)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
LINES64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINES_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}(?:[ \t]*\r?\n[ \t]*[0-9A-Fa-f]+)+(?![0-9A-Za-z])")
LINE = re.compile(r"[^\s]+")
SSH_MAGIC = b"openssh-key-v1\0"
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
#: Encodings of 1.2.840.113549.1.5 and 1.2.840.113549.1.12.1, under which encryptions by password are named.
ENCRYPTIONS = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
MOST_FIELD = 1 << 20  # bytes in a field of an OpenSSH key

SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
    "base_sha256 string, spans string"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded inside is a private key or a signed or encrypted token."""
    spans = []
    for at, run in dotted_runs(text):
        spans += [("jwt", at + start, at + end) for start, end in tokens_in(run)]
    for m in PEM.finditer(text) if "-----BEGIN " in text else ():
        if kind := key_file(m[1], m[2], m[3]):
            spans.append((kind, *m.span()))
    if not BASE64.search(text):  # hex digits are letters of base64 too, and all that follows needs a run of them
        return spans
    for pattern, decode in ((LINES64, from_base64), (LINES_HEX, from_hex)):
        for m in pattern.finditer(text) if "\n" in text else ():
            if not inside(spans, *m.span()):
                spans += [(kind, m.start() + start, m.start() + end) for kind, start, end in wrapped_keys(m[0], decode)]
    for pattern, decode in ((BASE64, from_base64), (HEX_KEY, from_hex)):
        for m in pattern.finditer(text):
            if not inside(spans, *m.span()) and (kind := key_kind(decode(m[0]))):
                spans.append((kind, *m.span()))
    return spans


def inside(spans: list[tuple[str, int, int]], start: int, end: int) -> bool:
    return any(a <= start and end <= b for _, a, b in spans)


def dotted_runs(text: str) -> Iterator[tuple[int, str]]:
    """Places and texts of what parts of a token's letters and dots make, with two dots at least."""
    pieces = text.split(".")
    ends = list(accumulate(len(piece) + 1 for piece in pieces))  # behind the dots
    number = 1
    while number < len(pieces) - 1:
        if not PART.fullmatch(pieces[number]):
            number += 1
            continue
        first = number
        while number < len(pieces) - 1 and PART.fullmatch(pieces[number]):
            number += 1
        before = pieces[first - 1]
        start = ends[first - 1] - 1 - len(before) + len(before.rstrip(PART_LETTERS))
        yield start, text[start : ends[number - 1] + PART.match(pieces[number]).end()]


def tokens_in(run: str) -> list[tuple[int, int]]:
    """Where tokens lie among parts that dots join: three parts, or five of an encrypted one."""
    parts, found, number, at = run.split("."), [], 0, 0
    while number < len(parts) - 2:
        count = token_parts(parts[number : number + 5])
        size = sum(map(len, parts[number : number + count])) + count - 1 if count else 0
        if count:
            found.append((at, at + size))
        at += size + 1 if count else len(parts[number]) + 1
        number += count or 1
    return found


def token_parts(parts: list[str]) -> int:
    """How many of the parts from the first on are a token; 0 if they don't begin one."""
    head = json_object(parts[0]) if len(parts[0]) >= 8 else None
    if not head or not isinstance(head.get("alg"), str):
        return 0
    if isinstance(head.get("enc"), str):
        whole = len(parts) == 5 and all(from_base64(part) for part in parts[2:])
        return 5 if whole and (not parts[1] or from_base64(parts[1])) else 0
    return 3 if json_object(parts[1]) is not None else 0


def json_object(part: str) -> dict | None:
    try:
        found = json.loads(from_base64(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def key_file(label: str, headers: str, body: str) -> str | None:
    """Kind of key between armour lines; headers may say that the inside is encrypted."""
    data = from_base64(re.sub(r"\\[nr]|[\s\\]", "", body))
    if cipher := CIPHER.search(headers):
        block = len(cipher[2]) // 2
        whole = block in (8, 16) and len(cipher[2]) == 2 * block and data and len(data) % block == 0
        return "der_key" if whole and "ENCRYPTED" in headers and label.endswith("PRIVATE KEY") else None
    return key_kind(data)


def wrapped_keys(run: str, decode) -> list[tuple[str, int, int]]:
    """Keys that lie over several lines of a run, from one line's start to another's end.

    How long a key is stands at its beginning, so each line is tried as the first once.
    """
    lines = [(m.start(), m.end(), m[0].rstrip("=")) for m in LINE.finditer(run)]
    sizes = [0, *accumulate(len(line) for _, _, line in lines)]
    per_byte = 2 if decode is from_hex else 4 / 3
    found, after = [], 0
    for first, (start, _, line) in enumerate(lines):
        if first < after or not may_begin(decode(line[:24])):
            continue

        def begin(count: int, first: int = first) -> bytes:
            letters = math.ceil(count * per_byte / 4) * 4
            enough = bisect_left(sizes, sizes[first] + letters)
            return decode("".join(x for _, _, x in lines[first:enough])[:letters])

        end = sizes[first] + math.ceil(declared_size(begin) * per_byte)
        last = bisect_left(sizes, end)
        if last >= len(sizes) or sizes[last] != end or last - first < 2:
            continue
        if kind := key_kind(decode("".join(x for _, _, x in lines[first:last]))):
            found.append((kind, start, lines[last - 1][1]))
            after = last
    return found


def may_begin(data: bytes) -> bool:
    return data[:1] == b"\x30" or SSH_MAGIC.startswith(data[: len(SSH_MAGIC)]) and len(data) > 8


def declared_size(begin) -> int:
    """Bytes of a key, as its own lengths say; 0 if they can't be read. ``begin`` gives its first bytes."""
    data = begin(16)
    if data[:1] == b"\x30" and len(data) > 6:
        if not data[1] & 0x80:
            return 2 + data[1]
        size = data[1] & 0x7F
        return 2 + size + int.from_bytes(data[2 : 2 + size], "big") if 1 <= size <= 4 else 0
    if not data.startswith(SSH_MAGIC):
        return 0
    at = len(SSH_MAGIC)
    for field in range(6):  # cipher, kdf, its options; how many keys; the first public key, the private ones
        size = int.from_bytes(begin(at + 4)[at : at + 4], "big")
        at += 4
        if field == 3 and size != 1 or size > MOST_FIELD:
            return 0
        at += 0 if field == 3 else size
    return at


def from_base64(body: str) -> bytes:
    """Standard or URL alphabet, padded or not; empty if it can't be decoded."""
    bare = body.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def from_hex(body: str) -> bytes:
    return bytes.fromhex(body) if len(body) % 2 == 0 else b""


def key_kind(data: bytes) -> str | None:
    if data.startswith(SSH_MAGIC):
        return "ssh_key" if whole_ssh_key(data) else None
    if data.startswith(b"-----BEGIN "):  # a key file encoded once more
        m = PEM.match(data.decode("ascii", "replace"))
        return key_file(m[1], m[2], m[3]) if m else None
    return "der_key" if private_der_key(data) else None


def whole_ssh_key(data: bytes) -> bool:
    at = len(SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if len(data) < at + 4 or len(data) < end:
            return None
        got, at = data[at + 4 : end], end
        return got

    if any(field() is None for _ in ("cipher", "kdf", "kdf options")):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or any(field() is None for _ in range(keys)):
        return False
    return field() is not None and at == len(data)


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each item, or None unless the lengths add up exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            length = int.from_bytes(data[at : at + size], "big")
            at += size
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def private_der_key(data: bytes) -> bool:
    """RSA, DSA, EC or PKCS#8 private key, encrypted or not; public keys and certificates are no secrets."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [tag for tag, _ in items]
    if tags == [SEQUENCE, OCTETS]:
        algorithm = der_items(items[0][1])
        named = bool(algorithm) and [tag for tag, _ in algorithm] == [OID, SEQUENCE]
        return named and algorithm[0][1].startswith(ENCRYPTIONS) and len(items[1][1]) >= 8
    if tags[0] != INTEGER or len(items[0][1]) != 1:
        return False
    if all(tag == INTEGER for tag in tags) and len(items) == 6:
        return items[0][1] == b"\x00" and all(len(number) >= 1 for _, number in items) and dsa_sizes(items)
    if len(items) >= 9 and all(tag == INTEGER for tag in tags[:9]):
        return True
    if tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == OID
    if tags[1:2] == [OCTETS] and items[0][1] == b"\x01" and len(items[1][1]) >= 20:
        return all(der_items(content) is not None for tag, content in items[2:])
    return False


def dsa_sizes(items: list[tuple[int, bytes]]) -> bool:
    """Whether version, p, q, g, y and x are as long as those of a DSA key are."""
    p, q, g, y, x = (int.from_bytes(number, "big") for _, number in items[1:])
    return p > q > x > 0 and p > g > 1 and p > y > 1 and q.bit_length() >= 128 and p.bit_length() >= 512


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    let_go()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            text = text or ""
            base = base_spans(text)
            kinds = [kind for kind, _, _ in base]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            everything = joined(base + confirmed_spans(text))
            rows.append((doc_id, *map(kinds.count, KINDS[:3]), digest, everything))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype(
            {"doc_id": "Int64"}
        )


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: counts and digest of the base spans, and every span.

    ``spans`` is ``kind:start:end`` by start, comma-joined, in code points with the end
    left out; kinds are those of ``KINDS``. A null or empty text has no spans, a very long
    one is read whole. Repeated rows give repeated rows, a null id is kept, other columns
    are ignored, and an empty table gives an empty result. No shuffle: each text is read
    once where it lies.
    """
    return in_small_batches(docs).selectExpr(
        f"CAST(`{id_column}` AS bigint) AS doc_id", f"CAST(`{text_column}` AS string) AS text"
    ).mapInPandas(scan, SCHEMA)


def blanked(text: str) -> str:
    """The text with each span, or run of overlapping ones, replaced by ``[kind]`` of its first."""
    out, at = [], 0
    for kind, start, end in sorted(
        base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]))
    ):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def blank_secrets(docs: DataFrame, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``docs`` with every span of each text replaced; all other columns stay.

    ``length_column`` is set to the new number of characters. Null texts stay null, empty
    ones empty; very long ones are read whole, repeated rows stay and change alike, an
    empty table stays empty.
    """

    @F.pandas_udf("string")
    def blank(texts: pd.Series) -> pd.Series:
        let_go()
        return texts.map(lambda text: text if text is None else blanked(text))

    result = in_small_batches(docs).withColumn(text_column, blank(F.col(text_column)))
    if length_column:
        length = F.length(text_column).cast(docs.schema[length_column].dataType)
        result = result.withColumn(length_column, length)
    return result
