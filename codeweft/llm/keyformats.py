"""Containers of private keys, told by their binary grammar: every length must fit and every integer must be what it has to be.

DER (X.690; lengths in more bytes than needed are let pass, as BER has them): PKCS#1 and multi-prime RSA, DSA, SEC 1, PKCS#8, encrypted PKCS#8, PKCS#12. Besides: the OpenSSH format, Java key
stores and OpenPGP secret key packets. What is only named like a container, or is cut off, is none.
"""

from __future__ import annotations

import struct

# fixed values: object identifiers, as DER writes them
_RSA = bytes.fromhex("2a864886f70d010101")
_EC = bytes.fromhex("2a8648ce3d0201")
_EDWARDS = tuple(bytes.fromhex("2b65") + bytes([k]) for k in (0x6E, 0x6F, 0x70, 0x71))
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_PKCS7 = bytes.fromhex("2a864886f70d0107")

Element = tuple[int, int, int]


def elements(data: bytes, at: int, end: int) -> list[Element] | None:
    """(tag, start, end) of the elements that fill a stretch; None where it is no DER."""
    out = []
    while at < end:
        if at + 2 > end or data[at] & 0x1F == 0x1F:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def _inside(data: bytes, e: Element) -> list[Element] | None:
    return elements(data, e[1], e[2])


def _integer(data: bytes, e: Element) -> int | None:
    """A whole number not below zero in its shortest form, else None."""
    raw = data[e[1] : e[2]]
    if e[0] != 0x02 or not raw or raw[0] & 0x80 or len(raw) > 1 and raw[0] == 0 and not raw[1] & 0x80:
        return None
    return int.from_bytes(raw, "big")


def _algorithm(data: bytes, e: Element) -> bytes | None:
    """The identifier of an algorithm's sequence."""
    parts = _inside(data, e) if e[0] == 0x30 else None
    if not parts or len(parts) > 2 or parts[0][0] != 0x06:
        return None
    name = data[parts[0][1] : parts[0][2]]
    return name if name and not name[-1] & 0x80 else None


def _rsa(n: list[int]) -> bool:
    version, modulus, public, private, p, q = n[:6]
    return version == 0 and len(n) == 9 and public > 2 and public % 2 == 1 and p > 1 and q > 1 and p * q == modulus and 1 < private < modulus and n[6] < p and n[7] < q and n[8] < p


def _integers(data: bytes, parts: list[Element]) -> bool:
    """RSA and DSA: a version, then numbers that fit together."""
    n = [_integer(data, e) for e in parts if e[0] == 0x02]
    if None in n or len(n) < 6:
        return False
    if len(parts) == 10 and parts[9][0] == 0x30 and len(n) == 9 and n[0] == 1:
        return 1 < n[3] < n[1] and n[1] % (n[4] * n[5] or n[1] + 1) == 0
    if len(parts) != len(n):
        return False
    if len(n) == 6:
        _, p, q, g, y, x = n
        return n[0] == 0 and 0 < x < q < p and 1 < g < p and 1 < y < p and (p - 1) % q == 0
    return _rsa(n)


def _sec1(data: bytes, parts: list[Element]) -> bool:
    return (
        len(parts) >= 2 and _integer(data, parts[0]) == 1 and parts[1][0] == 0x04 and 16 <= parts[1][2] - parts[1][1] <= 72
        and [t for t, _, _ in parts[2:]] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and all(_inside(data, e) for e in parts[2:])
    )


def _pkcs8(data: bytes, parts: list[Element]) -> bool:
    if len(parts) < 3 or _integer(data, parts[0]) not in (0, 1) or parts[2][0] != 0x04 or any(t not in (0xA0, 0x81, 0xA1) for t, _, _ in parts[3:]):
        return False
    name, key = _algorithm(data, parts[1]), data[parts[2][1] : parts[2][2]]
    if name == _RSA:
        return _der_key(key, _integers)
    if name == _EC:
        return _der_key(key, _sec1)
    if name in _EDWARDS:
        return len(key) > 32 and key[0] == 0x04 and key[1] == len(key) - 2
    return name is not None and len(key) >= 16


def _encrypted(data: bytes, parts: list[Element]) -> bool:
    name = _algorithm(data, parts[0]) if len(parts) == 2 and parts[1][0] == 0x04 else None
    return name is not None and name.startswith(_PASSWORD_BASED) and parts[1][2] - parts[1][1] >= 16


def _pkcs12(data: bytes, parts: list[Element]) -> bool:
    if len(parts) not in (2, 3) or _integer(data, parts[0]) != 3 or parts[1][0] != 0x30:
        return False
    safe = _inside(data, parts[1])
    return bool(safe) and len(safe) == 2 and safe[0][0] == 0x06 and data[safe[0][1] : safe[0][2]].startswith(_PKCS7) and safe[1][0] == 0xA0 and bool(_inside(data, safe[1]))


def _der_key(data: bytes, *kinds) -> bool:
    top = elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    parts = _inside(data, top[0]) if top and len(top) == 1 else None
    return bool(parts) and any(k(data, parts) for k in kinds)


def _strings(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """n strings that follow their lengths in four bytes, and where they end."""
    out = []
    for _ in range(n):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
    return out, at


def _openssh(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic) or (got := _strings(data, len(magic), 3)) is None:
        return False
    (cipher, derivation, _), at = got
    if not cipher.isascii() or not derivation.isascii() or not cipher or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= keys <= len(data) // 4 or (got := _strings(data, at + 4, keys + 1)) is None:
        return False
    (*public, private), at = got
    if at != len(data) or len(private) < 16 or any(_strings(p, 0, 1) is None for p in public):
        return False
    if cipher != b"none":
        return len(private) % 8 == 0
    return private[:4] == private[4:8] and _strings(private, 8, 1) is not None


def _java_store(data: bytes) -> bool:
    """A Java key store whose entries can be walked and one of which is a private key."""
    if data[:4] not in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce") or len(data) < 32:
        return False
    version, entries = struct.unpack(">II", data[4:12])
    at, private = 12, False
    if version not in (1, 2):
        return False

    def block(form: str, at: int) -> tuple[int, int]:
        n = struct.calcsize(form)
        if at + n > len(data):
            raise ValueError
        size = struct.unpack(form, data[at : at + n])[0]
        if at + n + size > len(data):
            raise ValueError
        return at + n, at + n + size

    try:
        for _ in range(entries):
            tag = int.from_bytes(data[at : at + 4], "big")
            _, at = block(">H", at + 4)
            at += 8
            certificates = 1
            if tag == 1:
                start, at = block(">I", at)
                private = private or data[start : start + 1] == b"\x30"
                certificates = int.from_bytes(data[at : at + 4], "big")
                at += 4
            elif tag != 2:
                return False
            for _ in range(certificates):
                if version == 2:
                    _, at = block(">H", at)
                _, at = block(">I", at)
    except ValueError:
        return False
    return private and at + 20 == len(data)


def _pgp(data: bytes) -> bool:
    """OpenPGP packets (RFC 4880) that fill the data and begin with a secret key."""
    at, first = 0, True
    while at < len(data):
        head = data[at]
        if not head & 0x80:
            return False
        at += 1
        if head & 0x40:
            tag, n = head & 0x3F, data[at] if at < len(data) else 255
            if n < 192:
                at += 1
            elif n < 224 and at + 1 < len(data):
                n, at = ((n - 192) << 8) + data[at + 1] + 192, at + 2
            elif n == 255 and at + 5 <= len(data):
                n, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            else:
                return False
        else:
            tag, k = head >> 2 & 15, 1 << (head & 3)
            if k == 8 or at + k > len(data):
                return False
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return False
        # version, time, algorithm; a public key's numbers; then the secret part
        if first and (tag != 5 or n < 24 or data[at] not in (3, 4, 5, 6) or data[at + (7 if data[at] == 3 else 5)] not in (1, 2, 3, 16, 17, 18, 19, 22, 25, 26, 27, 28)):
            return False
        first = False
        at += n
    return not first


def private_key(data: bytes) -> bool:
    """Whether bytes are a private key's container, by its grammar."""
    if len(data) < 16:
        return False
    head = data[0]
    if head == 0x30:
        return _der_key(data, _pkcs8, _sec1, _integers, _encrypted, _pkcs12)
    if head == 0x6F:
        return _openssh(data)
    if head in (0xFE, 0xCE):
        return _java_store(data)
    return head in (0x94, 0x95, 0x96, 0xC5) and _pgp(data)
