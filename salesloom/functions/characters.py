"""Character counts used by the local text embedding."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as digits although they are no decimal digits
# (superscripts, subscripts, circled and similar digits).
_EXTRA_DIGITS = (
    (0xB2, 0xB3), (0xB9, 0xB9), (0x1369, 0x1371), (0x19DA, 0x19DA), (0x2070, 0x2070),
    (0x2074, 0x2079), (0x2080, 0x2089), (0x2460, 0x2468), (0x2474, 0x247C),
    (0x2488, 0x2490), (0x24EA, 0x24EA), (0x24F5, 0x24FD), (0x24FF, 0x24FF),
    (0x2776, 0x277E), (0x2780, 0x2788), (0x278A, 0x2792), (0x10A40, 0x10A43),
    (0x10E60, 0x10E68), (0x11052, 0x1105A), (0x1F100, 0x1F10A),
)
_DIGITS = r"\p{Nd}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _EXTRA_DIGITS)
_SPACES = r"\t-\r\x1c-\x20\x{85}\p{Z}"

# Runs of everything but one kind of character. The first alternative takes common
# characters by plain ranges before the costly Unicode classes are asked.
_NO_LETTERS = r"\P{L}+"
_NO_DIGITS = rf"[\x00-/:-\x{{B1}}\x{{C0}}-\x{{17F}}]+|[^{_DIGITS}]+"
_NO_SPACES = rf"[!-\x{{84}}\x{{A1}}-\x{{167F}}]+|[^{_SPACES}]+"

_ASCII_LETTERS = string.ascii_letters
_ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


def letter_digit_space_counts(text: Column) -> tuple[Column, Column, Column]:
    """Number of letters, digits and white space characters of a text.

    ASCII characters are counted by what is left when they are deleted; only the rest
    (punctuation and other scripts) goes through regular expressions. The three counts
    share their intermediate texts, which are evaluated once per row.
    """
    no_letters = F.translate(text, _ASCII_LETTERS, "")
    no_digits = F.translate(no_letters, string.digits, "")
    rest = F.translate(no_digits, _ASCII_SPACES, "")

    def count(before: Column, after: Column, others: str) -> Column:
        return (F.length(before) - F.length(after)
                + F.length(F.regexp_replace(rest, others, "")))

    return (count(text, no_letters, _NO_LETTERS), count(no_letters, no_digits, _NO_DIGITS),
            count(no_digits, rest, _NO_SPACES))
