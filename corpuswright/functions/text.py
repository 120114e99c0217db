"""Tokenizers and string helpers as Column expressions, and byte-level helpers for Python code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: alphanumerics, apostrophes and bytes over 0x7F after an alphanumeric; or one byte and what follows of other ASCII.
TOKEN = "[0-9A-Za-z][0-9A-Za-z'\\x80-\\xff]*|[^\\s\\x0B][^\\s\\x0B0-9A-Za-z\\x80-\\xff]*"
WORD = "[0-9A-Za-z][0-9A-Za-z'\\x{80}-\\x{10FFFF}]*"
#: A lenient form: a byte whose leading ones number two to six with the bytes that may follow it, or another byte from 0x80.
FORM = r"[\xC0-\xDF][\x80-\xBF]?|[\xE0-\xEF][\x80-\xBF]{0,2}|[\xF0-\xF7][\x80-\xBF]{0,3}|[\xF8-\xFB][\x80-\xBF]{0,4}|[\xFC-\xFD][\x80-\xBF]{0,5}|[\x80-\xBF\xFE\xFF]"
_FORM = re.compile(FORM.encode())
#: Below which first byte a form keeps which of that byte's bits.
_KEPT_BITS = ((0xC0, 0xFF), (0xE0, 0x1F), (0xF0, 0x0F), (0xF8, 0x07), (0xFC, 0x03), (0xFE, 0x01), (0x100, 0xFF))
#: Multipliers of the skip-gram window, nearest first, for plain text and for HTML.
PLAIN_WINDOW, HTML_WINDOW = (3, 9, 17), (3, 5)

#: The stop words of HTML text, case-sensitive.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't did didn't do does "
    "doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's "
    "i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same "
    "shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those "
    "through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would "
    "wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()


def latin1(text: Column) -> Column:
    """One character for each byte, whatever the bytes are."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def tokens(text: Column) -> Column:
    """All tokens of a text, in order, as byte strings (one character a byte)."""
    return F.regexp_extract_all(latin1(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """The alphanumeric tokens, as characters."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def skip_grams(found: Column, window: int = len(PLAIN_WINDOW)) -> Column:
    """(tok, prev, distance) for each token and each of the ``window`` before it; distance 0 is the token alone."""
    alone = F.transform(found, lambda t: F.struct(t.alias("tok"), F.lit(None).cast("string").alias("prev"), F.lit(0).alias("distance")))
    parts = [alone]
    for d in range(1, window + 1):
        late = F.when(F.size(found) > d, F.slice(found, d + 1, F.greatest(F.size(found) - d, F.lit(0)))).otherwise(F.slice(found, 1, 0))
        parts.append(_pairs(late, found, d))
    return F.concat(*parts)


def _pairs(late: Column, found: Column, d: int) -> Column:
    return F.transform(late, lambda t, i: F.struct(t.alias("tok"), F.element_at(found, i + 1).alias("prev"), F.lit(d).alias("distance")))


def code_points(text: Column) -> Column:
    """Code points from 128 of a valid text."""
    return F.transform(F.regexp_extract_all(text, F.lit("[^\\x00-\\x7F]"), F.lit(0)), lambda c: F.ascii(c))


def substrings(text: Column, least: int = 3, longest_text: int | None = None) -> Column:
    """All byte substrings of at least ``least`` bytes.  Their number is quadratic: ``longest_text``, if given, refuses longer texts."""
    flat = latin1(text)
    n = F.length(flat)
    every = F.flatten(F.transform(F.sequence(F.lit(1), n - (least - 1)), lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.substring(flat, i, k))))
    refused = F.lit(False) if longest_text is None else n > longest_text
    return F.when(refused, F.raise_error(F.lit("text too long for substring features"))).when(n >= least, every).otherwise(F.array().cast("array<string>"))


def without_stop_words(found: Column) -> Column:
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def url_parts(url: Column) -> Column:
    """Non-empty parts of an http(s) address, the scheme one of them."""
    return F.when(url.startswith("http://") | url.startswith("https://"), F.filter(F.split(url, "/"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def genotypes(content: Column) -> Column:
    """(chrom, pos, alleles) of the called genotypes in a tab-separated dump of four or five fields."""
    lines = F.filter(F.split(content, "\n"), lambda x: ~x.startswith("#"))
    fields = F.transform(lines, lambda x: F.filter(F.split(F.rtrim(F.regexp_replace(x, "[\\s\\x0B]+$", "")), "\t"), lambda f: f != ""))
    four = lambda f: (F.size(f) == 4) & (F.get(f, 3) != "--")
    five = lambda f: (F.size(f) == 5) & (F.length(F.get(f, 3)) == 1) & (F.length(F.get(f, 4)) == 1) & ~((F.get(f, 3) == "-") & (F.get(f, 4) == "-"))
    kept = F.filter(fields, lambda f: four(f) | five(f))
    return F.transform(kept, lambda f: F.struct(F.get(f, 1).alias("chrom"), F.get(f, 2).alias("pos"), F.concat(F.get(f, 3), F.coalesce(F.get(f, 4), F.lit(""))).alias("alleles")))


def feature_set(features: Column, unique: bool = True) -> Column:
    """Sorted features without zeros (no feature hashes to 0)."""
    kept = F.filter(features, lambda f: f != 0)
    return F.array_sort(F.array_distinct(kept) if unique else kept)


def explode_text(text: Column, delimiter: str) -> Column:
    """Parts between delimiters, without an empty last one."""
    parts = F.split(text, re.escape(delimiter))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lenient_points(raw: Column) -> Column:
    """Code points from 128 of any bytes (a text's own, if it is a string), as ``decode_lenient`` gives them."""

    def point(form: Column) -> Column:
        byte = lambda i: F.ascii(F.substring(form, i, F.lit(1)))
        first = reduce(lambda rest, step: F.when(byte(F.lit(1)) < step[0], byte(F.lit(1)).bitwiseAND(step[1])).otherwise(rest), reversed(_KEPT_BITS[:-1]), byte(F.lit(1)))
        more = lambda v, i: F.when(i <= F.length(form), F.shiftleft(v, 6).bitwiseOR(byte(i).bitwiseAND(0x3F))).otherwise(v)
        return F.aggregate(F.array(*map(F.lit, range(2, 7))), first, more)

    found = F.transform(F.regexp_extract_all(latin1(raw), F.lit(FORM), F.lit(0)), point)
    return F.filter(found, lambda v: v >= 0x80)


def decode_lenient(raw: bytes) -> list[int]:
    """Code points from 128 of any bytes.

    A byte whose leading ones number two to six begins a form of as many bytes; a
    form that breaks off gives what it had.  Any other byte stands for itself.
    """
    out = []
    for form in _FORM.findall(raw):
        value = form[0] & next(bits for limit, bits in _KEPT_BITS if form[0] < limit)
        for byte in form[1:]:
            value = value << 6 | byte & 0x3F
        if value >= 0x80:
            out.append(value)
    return out


def shortest(value: float, digits: tuple[int, ...] = (15, 16, 17)) -> str:
    """Fewest significant digits that read back as the same number."""
    return next((s for d in digits if float(s := f"{value:.{d}g}") == value), f"{value:.{digits[-1]}g}")
