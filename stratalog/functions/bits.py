"""Bit streams: most significant bit first, in whole 64-bit big-endian words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


class BitWriter:
    """Collects bits; ``finish`` pads with zeros to a word, one word at least.

    Whole words leave the integer at once, so a write costs the same however long
    the stream is.
    """

    def __init__(self) -> None:
        self._words = bytearray()
        self._value, self._held = 0, 0
        self.bits_written = 0

    def write(self, value: int, width: int) -> None:
        """The low ``width`` bits of ``value``."""
        self._value = (self._value << width) | (value & ((1 << width) - 1))
        self._held += width
        self.bits_written += width
        if self._held >= WORD:
            rest = self._held % WORD
            whole = self._held - rest
            self._words += (self._value >> rest).to_bytes(whole // 8, "big")
            self._value, self._held = self._value & ((1 << rest) - 1), rest

    def on(self) -> None:
        self.write(1, 1)

    def off(self) -> None:
        self.write(0, 1)

    def finish(self) -> bytes:
        if not self._held and self._words:
            return bytes(self._words)
        return bytes(self._words) + (self._value << (WORD - self._held)).to_bytes(WORD // 8, "big")


class BitReader:
    """Reads bits back; reading past the end is an EOFError."""

    def __init__(self, data: bytes) -> None:
        if len(data) < WORD // 8:
            raise ValueError("a stream has a word at least")
        self._data, self._size, self.position = data, 8 * len(data), 0

    def read(self, width: int) -> int:
        end = self.position + width
        if end > self._size:
            raise EOFError("past the end of the stream")
        # Only the bytes that hold the bits are looked at.
        last = -(-end // 8)
        around = int.from_bytes(self._data[self.position // 8 : last], "big")
        self.position = end
        return (around >> (8 * last - end)) & ((1 << width) - 1)

    def read_bit(self) -> bool:
        return self.read(1) == 1


def bit_string(value: str | Column, width: str | Column) -> Column:
    """The low ``width`` bits of a bigint as '0' and '1'."""
    value, width = (F.col(x) if isinstance(x, str) else x for x in (value, width))
    return F.substring(F.lpad(F.bin(value), WORD, "0"), F.lit(WORD) - width + 1, width)


def padded(bits: Column) -> Column:
    """A bit string with the zeros that finishing adds."""
    size = F.greatest(F.lit(1), F.ceil(F.length(bits) / F.lit(WORD))) * F.lit(WORD)
    return F.rpad(bits, size.cast("int"), F.lit("0"))
