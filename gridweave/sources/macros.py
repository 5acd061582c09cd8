"""Macro projects: the compound file that holds their streams, and the modules' source texts.

Both formats are published by their maker as open specifications. A project that cannot be read
gives no modules.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_LAST = 0xFFFFFFFA  # sector numbers from here on have other meanings
#: A module's source begins with this attribute: eight plain letters after a token byte of zero.
_BEGIN = b"\0Attribut"


class Compound:
    """The streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 0x1E)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, self.cutoff, mini_fat, _, more, _ = struct.unpack_from("<I4xIIIII", data, 0x30)
        tables = [x for x in struct.unpack_from("<109I", data, 0x4C) if x < _LAST]
        seen: set[int] = set()
        while more < _LAST and more not in seen:
            seen.add(more)
            *found, more = self._numbers(more)
            tables += [x for x in found if x < _LAST]
        self.fat = [x for t in tables for x in self._numbers(t)]
        self.mini_fat = [x for s in self._chain(mini_fat, self.fat) for x in self._numbers(s)]
        self.entries = []
        raw = b"".join(self._sector(s) for s in self._chain(directory, self.fat))
        for at in range(0, len(raw) - 127, 128):
            length, kind = struct.unpack_from("<HB", raw, at + 64)
            start, size = struct.unpack_from("<IQ", raw, at + 116)
            if kind in (1, 2, 5):
                self.entries.append((raw[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), kind, start, size))
        root = next((e for e in self.entries if e[1] == 5), None)
        self.mini = b"".join(self._sector(s) for s in self._chain(root[2], self.fat)) if root else b""

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _numbers(self, n: int) -> tuple[int, ...]:
        raw = self._sector(n)
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    @staticmethod
    def _chain(at: int, fat: list[int]) -> Iterator[int]:
        seen: set[int] = set()
        while at < min(_LAST, len(fat)) and at not in seen:
            seen.add(at)
            yield at
            at = fat[at]

    def streams(self) -> Iterator[tuple[str, bytes]]:
        for name, kind, start, size in self.entries:
            if kind != 2:
                continue
            if size < self.cutoff:
                parts = (self.mini[s * self.mini_size : (s + 1) * self.mini_size] for s in self._chain(start, self.mini_fat))
            else:
                parts = (self._sector(s) for s in self._chain(start, self.fat))
            yield name, b"".join(parts)[:size]


def unpacked(data: bytes) -> bytes:
    """A compressed container's content, as far as it can be read. Each chunk has plain bytes and
    copies of what stands before in its chunk; a copy's split of length and distance follows from
    how much that is."""
    if data[:1] != b"\x01":
        raise ValueError("not a compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = struct.unpack_from("<H", data, at)[0]
        end, at = min(len(data), at + (head & 0xFFF) + 3), at + 2
        if not head >> 15:
            out += data[at : at + 4096]
            at += 4096
            continue
        begin = len(out)
        while at < end:
            kinds, at = data[at], at + 1
            for bit in range(8):
                if at >= end:
                    break
                if not kinds >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    return bytes(out)
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                bits = max(4, (len(out) - begin - 1).bit_length())
                distance, length = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                if distance > len(out):
                    return bytes(out)
                for _ in range(length):
                    out.append(out[-distance])
    return bytes(out)


def modules(project: bytes) -> list[tuple[str, str]]:
    """(module, source) of a macro project; empty if it has none that can be read."""
    try:
        found = []
        for name, data in Compound(project).streams():
            at = data.find(_BEGIN)
            if at >= 3 and data[at - 3] == 1:
                found.append((name, unpacked(data[at - 3 :]).decode("latin-1")))
        return found
    except (ValueError, struct.error, IndexError):
        return []
