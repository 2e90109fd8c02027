"""Which binary containers hold a private key, told by their grammar and not by their looks."""

from __future__ import annotations

import struct

OPENSSH = b"openssh-key-v1\0"
JKS = (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce")


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the contents) of the DER element at ``at``."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data):
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= len(data) else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while start < end:
        e = _element(data, start)
        if e is None or e[2] > end:
            return []
        out.append(e)
        start = e[2]
    return out


def _der(data: bytes) -> str | None:
    """By X.509's grammar; the container fills the data, but for padding with zeros."""
    top = _element(data, 0)
    if top is None or top[0] != 0x30 or data[top[2] :].strip(b"\0"):
        return None
    parts = _children(data, top[1], top[2])
    tags = [p[0] for p in parts]
    value = lambda i: data[parts[i][1] : parts[i][2]]
    if len(parts) >= 9 and set(tags[:9]) == {0x02} and value(0) in (b"\0", b"\1") and all(map(value, range(9))):
        return "RSA"
    if len(parts) == 6 and set(tags) == {0x02} and all(map(value, range(6))):
        return "DSA"
    if tags[:2] == [0x02, 0x04] and value(0) == b"\1" and value(1):
        return "EC"
    if tags[:3] == [0x02, 0x30, 0x04]:
        inner = _children(data, parts[1][1], parts[1][2])
        return "PKCS8" if inner and inner[0][0] == 0x06 and value(2) else None
    if tags == [0x30, 0x04]:  # algorithm of encryption, encrypted key
        inner = _children(data, parts[0][1], parts[0][2])
        return "PKCS8-ENCRYPTED" if inner and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][1] + 7] == bytes.fromhex("2a864886f70d01") and value(1) else None
    if tags[:2] == [0x02, 0x30] and value(0) == b"\3" and _holds_key(data, parts[1]):
        return "PKCS12"
    return None


# Object identifiers of contents and of bags.
_DATA, _ENCRYPTED, _ENVELOPED = (bytes.fromhex(f"2a864886f70d0107{n}") for n in ("01", "06", "03"))
_BAG = bytes.fromhex("2a864886f70d010c0a01")
_KEY_BAGS, _NESTED_BAG = (1, 2), 6


def _holds_key(data: bytes, content: tuple[int, int, int], depth: int = 0) -> bool:
    """Whether a content of PKCS#12 has a bag with a key, or is encrypted, so that it may have."""
    kind, *rest = _children(data, content[1], content[2]) or [(0, 0, 0)]
    name = data[kind[1] : kind[2]]
    if kind[0] != 0x06 or depth > 8:
        return False
    if name in (_ENCRYPTED, _ENVELOPED):
        return True
    if name == _DATA and rest:  # [0] { OCTET STRING { SEQUENCE OF contents or bags } }
        box = _element(data, rest[0][1])
        inner = _element(data, box[1]) if box and box[0] == 0x04 else None
        return inner is not None and inner[2] <= box[2] and any(_holds_key(data, c, depth + 1) for c in _children(data, inner[1], inner[2]))
    if name.startswith(_BAG) and len(name) == len(_BAG) + 1:
        if name[-1] == _NESTED_BAG and rest:
            inner = _element(data, rest[0][1])
            return inner is not None and any(_holds_key(data, c, depth + 1) for c in _children(data, inner[1], inner[2]))
        return name[-1] in _KEY_BAGS
    return False


# Public-key algorithms.
_ALGORITHMS = (1, 2, 3, 16, 17, 18, 19, 20, 22, 25, 26, 27, 28)


def _pgp(data: bytes) -> str | None:
    """A chain of packets that fills the data and begins with a secret key."""
    at, first = 0, True
    while at < len(data):
        head = data[at]
        if not head & 0x80:
            return None
        if head & 0x40:
            tag, size = head & 0x3F, data[at + 1 : at + 2]
            n = size[0] if size else 255
            if n < 192:
                start = at + 2
            elif n < 224 and at + 3 <= len(data):
                n, start = ((n - 192) << 8) + data[at + 2] + 192, at + 3
            elif n == 255 and at + 6 <= len(data):
                n, start = int.from_bytes(data[at + 2 : at + 6], "big"), at + 6
            else:
                return None
        else:
            tag, width = (head & 0x3C) >> 2, (1, 2, 4, 0)[head & 3]
            start = at + 1 + width
            n = int.from_bytes(data[at + 1 : start], "big") if width else -1
        if not tag or n < 0 or start + n > len(data):
            return None
        # Version, time, in the old version days of validity, algorithm.
        if first and (tag not in (5, 7) or n < 40 or data[start] not in (3, 4, 5, 6) or data[start + (7 if data[start] == 3 else 5)] not in _ALGORITHMS):
            return None
        at, first = start + n, False
    return None if first else "PGP"


def _strings(data: bytes, at: int, count: int) -> int | None:
    """Where ``count`` strings with their lengths before them end."""
    for _ in range(count):
        if at + 4 > len(data):
            return None
        at += 4 + struct.unpack(">I", data[at : at + 4])[0]
    return at if at <= len(data) else None


def _openssh(data: bytes) -> str | None:
    """Cipher, derivation, its options, the number of keys, the public keys, and the private part, which is not empty."""
    if not data.startswith(OPENSSH):
        return None
    at = _strings(data, len(OPENSSH), 3)
    if at is None or at + 4 > len(data):
        return None
    keys = struct.unpack(">I", data[at : at + 4])[0]
    at = _strings(data, at + 4, keys) if 1 <= keys <= len(data) // 4 else None
    end = None if at is None else _strings(data, at, 1)
    return "OPENSSH" if end is not None and end - at > 4 else None


def _jks(data: bytes) -> str | None:
    """Entries up to the digest of 20 bytes, one of them a key. A sealed key of a JCEKS store has no length and ends the walk."""
    if data[:4] not in JKS or len(data) < 32:
        return None
    version, count = struct.unpack(">II", data[4:12])
    at, end, found = 12, len(data) - 20, False

    def sized(at: int, width: int) -> int:
        return at + width + int.from_bytes(data[at : at + width], "big") if at + width <= end else end + 1

    if version not in (1, 2):
        return None
    for _ in range(count):
        tag = int.from_bytes(data[at : at + 4], "big")
        at = sized(at + 4, 2) + 8  # alias, time
        if tag == 3 and data[:4] == JKS[1]:
            return "JKS" if data[at : at + 2] == b"\xac\xed" else None
        if tag not in (1, 2):
            return None
        chain = 1
        if tag == 1:
            found = True
            at = sized(at, 4)
            chain = int.from_bytes(data[at : at + 4], "big") if at + 4 <= end else end
            at += 4
        for _ in range(chain):
            if at > end:
                return None
            at = sized(sized(at, 2) if version == 2 else at, 4)
        if at > end:
            return None
    return "JKS" if found and at == end else None


def private_key_kind(data: bytes) -> str | None:
    """The kind of private key that ``data`` is, or None; public keys, certificates and stores of them are none."""
    if len(data) < 16:
        return None
    return _jks(data) or _openssh(data) or _der(data) or (_pgp(data) if len(data) > 64 else None)
