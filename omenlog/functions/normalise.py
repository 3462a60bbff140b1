"""Raw log lines to masked templates, as chains of regular expressions.

A dialect whose patterns RE2 knows (no look-around) runs over Arrow batches, the others run inside the JVM.

In the patterns ``\\d``, ``\\w``, ``\\s`` and ``.`` have their Unicode meaning; ``portable``
spells those classes out, so Java (and any RE2 engine) matches the same text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from omenlog.functions.binding import bound

# The masks of each log dialect, in the order in which they apply:
# (pattern, replacement, text without which the pattern cannot match).
BLOCK_ID = r"blk_-?\d+"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?"
# "a digit, and a letter, further on in the line": looking for the first one forwards
# instead of the last one backwards, and only in front of a colon or hyphen.
AHEAD = r"(?=[^0-9\n]*[0-9])(?=[^a-zA-Z\n]*[a-zA-Z])"
BGL_MASKS = (
    (IP, " IP ", "."),
    (r"\d{1,4}\-\d{1,2}\-\d{1,2}-\d{1,2}.\d{1,2}.\d{1,2}.\d+", " TIME ", "-"),
    (r"\d{1,4}\.\d{1,2}\.\d{1,2}", " TIME ", "."),
    (r".\S+(?=.[0-9a-zA-Z])(?=[/]).\S+", " PATH ", "/"),
    (r"\S+(?=[:]+)" + AHEAD + r"\S+", " SERVER ", ":"),
    (r"\S+(?=[-])" + AHEAD + r"\S+", " SERVER ", "-"),
    (r"[A-Z0-9]{28}", " ECID ", ""),
    (r"[a-zA-Z0-9]{48}", " SERIAL ", ""),
    (r"0[xX][0-9a-fA-F]\S+", " MEMORY ", "0"),
    (r"[0-9a-fA-F]{8}", " IAR ", ""),
    (r"(\d+)", " NUM ", ""),
)
GENERIC_MASKS = ((BLOCK_ID, "BLK", "blk_"), (IP, "IP", "."), (r"\d+", "NUM", ""))
HDFS_MASKS = ((r"blk_.\d+", "BLK", "blk_"), (IP, "IP", "."), (r"\d*\d", "NUM", ""))
# The look-ahead only spares the alternation where no month can start.
MONTHS = (
    "(?=[JFMASOND])(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?"
    "|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
SIGNS = r"""[-=+,#/\?:^$.@*\"※~&%ㆍ!』\\‘|\(\)\[\]`'…》]"""
THUNDERBIRD_MASKS = (
    (r"\d{1,4}\.\d{1,2}\.\d{1,2}", "DATE", "."),
    (MONTHS + r"\s+(\d{1,2})\s+", "DATE ", ""),
    (r"\d{1,2}\:\d{1,2}\:\d{1,2}", "TIME", ":"),
    (r"(\w+[\w\.]*)@(\w+[\w\.]*)\-(\w+[\w\.]*)", "ACCOUNT", "@"),
    (r"(\w+[\w\.]*)@(\w+[\w\.]*)", "ACCOUNT", "@"),
    (r"(\w+[\w\.]*-\w+[\w\.]*)", "ID", "-"),
    (r"DATE\s\w+[\w\.]*", "DATE ID", "DATE"),
    (r"[0-9a-fA-F]{10}", "IAR", ""),
    (r"(\[\d+\])", " NUM ", "["),
    (r"\s" + SIGNS, "", ""),
    (SIGNS + r"\s", " ", ""),
    (SIGNS, " ", ""),
)
# "Neither a letter nor an angle": written as one class, ``[^a-zA-Z<>]+``, Java takes ten times as long.
LETTERS_AND_ANGLES = r"(?:(?![<>])[^a-zA-Z])+"
LETTERS = r"[^a-zA-Z]+"
#: The same class for RE2, and what a pattern may begin with only to spare time.
PLAIN_CLASSES, SPARING = {LETTERS_AND_ANGLES: r"[^a-zA-Z<>]+"}, "(?=[JFMASOND])"

# White space other than the blank and the newline; it is turned into blanks first.
ASCII_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
SPACES = ASCII_SPACES + "\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + (
    "    　"
)
ANY_ASCII_SPACE = r"[\t\x0b-\r\x1c-\x1f]"
ANY_SPACE = r"[\t\x0b-\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNICODE = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": r" \n"}
_ASCII = {"d": "0-9", "w": "A-Za-z0-9_", "s": r" \n"}


def portable(pattern: str, *, ascii_only: bool = False) -> str:
    """The pattern with its classes spelled out and ``.`` excluding only the newline.

    Meant for text whose white space is blanks and newlines (see ``blanks``).
    """
    classes = _ASCII if ascii_only else _UNICODE
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            name = pattern[i + 1]
            if name in classes:
                out.append(classes[name] if inside else f"[{classes[name]}]")
            elif name == "S":
                out.append(f"[^{classes['s']}]")
            else:
                out.append(c + name)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "." and not inside:
            c = r"[^\n]"
        if not (inside and ascii_only and not c.isascii()):
            out.append(c)
        i += 1
    return "".join(out)


def blanks(text: Column, *, ascii_only: bool = False) -> Column:
    """Every kind of white space but the newline as a blank."""
    spaces, some = (ASCII_SPACES, ANY_ASCII_SPACE) if ascii_only else (SPACES, ANY_SPACE)
    return bound(
        text, lambda t: F.when(t.rlike(some), F.translate(t, spaces, " " * len(spaces))).otherwise(t)
    )


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def _masked(pattern: str, name: str, needs: str) -> Callable[[Column], Column]:
    def step(text: Column) -> Column:
        done = F.regexp_replace(text, F.lit(pattern), F.lit(name))
        return F.when(F.contains(text, F.lit(needs)), done).otherwise(text) if needs else done

    return step


def _chain(text: Column, masks: tuple, ascii_only: bool) -> Column:
    if any(space in pattern for pattern, _, _ in masks for space in (r"\s", r"\S")):
        text = blanks(text, ascii_only=ascii_only)
    for pattern, name, needs in masks:
        text = bound(text, _masked(portable(pattern, ascii_only=ascii_only), name, needs))
    return text


def mask(text: Column, masks: tuple) -> Column:
    """Replace every match of each pattern, one pattern after the other.

    ASCII lines take patterns with ASCII classes, which match the same text much faster.
    """
    return bound(
        text,
        lambda t: F.when(is_ascii(t), _chain(t, masks, True)).otherwise(_chain(t, masks, False)),
    )


@cache
def _folding() -> tuple[str, str]:
    """Characters whose decomposition is one base letter plus marks, and bare marks."""
    from_, to, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        parts = unicodedata.normalize("NFD", c)
        if parts == c:
            continue
        base = "".join(x for x in parts if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            from_.append(c)
            to.append(base)
    return "".join(from_) + "".join(marks), "".join(to)


def fold_letters(text: Column) -> Column:
    """Accents dropped from letters, without leaving the JVM.

    Equal to ``fold_accents`` except for syllables that decompose into several base
    characters; the profiles below turn those into blanks either way.
    """
    source, target = _folding()
    return bound(text, lambda t: F.when(is_ascii(t), t).otherwise(F.translate(t, source, target)))


def fold_accents(text: Column) -> Column:
    """Canonical decomposition without non-spacing marks, exact for every script.

    Only texts with other than ASCII characters go to Python.
    """

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        def one(s):
            return s and "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")

        return values.map(one)

    plain = is_ascii(text)
    return F.when(plain, text).otherwise(fold(F.when(~plain, text)))


def re2(pattern: str) -> str | None:
    """The pattern for RE2; none if it looks around."""
    pattern = PLAIN_CLASSES.get(pattern, pattern.removeprefix(SPARING))
    return None if any(look in pattern for look in ("(?=", "(?!", "(?<")) else portable(pattern)


def _where(texts: pa.Array, chosen: pa.Array, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``change`` for the chosen texts only."""
    chosen = pc.fill_null(chosen, False)
    if not pc.any(chosen).as_py():
        return texts
    return pc.replace_with_mask(texts, chosen, change(texts.filter(chosen)))


def _masked_batch(texts: pa.Array, masks: tuple) -> pa.Array:
    if any(space in pattern for pattern, _, _ in masks for space in (r"\s", r"\S")):
        texts = pc.replace_substring_regex(texts, ANY_SPACE, " ")
    for pattern, name, needs in masks:
        found = pc.match_substring(texts, needs) if needs else texts.is_valid()
        texts = _where(texts, found, lambda some, p=re2(pattern), n=name: pc.replace_substring_regex(some, p, n))
    return texts


#: Texts that are folded at once, and what stands for a character that goes.
FOLDED, GONE = 256, 0xFFFFFFFF


@cache
def _folds() -> np.ndarray:
    """``_folding`` by code point."""
    source, target = _folding()
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    out[[ord(c) for c in source]] = GONE
    out[[ord(c) for c in source[:len(target)]]] = [ord(c) for c in target]
    return out


def _folded_texts(texts: list[str]) -> pa.Array:
    """Texts by ``_folds``, all their characters at once."""
    codes = _folds()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    kept = codes != GONE
    ends = np.cumsum([0, *map(len, texts)])
    ends = np.concatenate([[0], np.cumsum(kept)])[ends]
    codes = codes[kept]
    sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)  # bytes of UTF-8
    ends = np.concatenate([[0], np.cumsum(sizes)])[ends].astype(np.int32)
    data = codes.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data))


def _folded_batch(texts: pa.Array, lower: bool) -> pa.Array:
    def other(some: pa.Array) -> pa.Array:
        some = [t.lower() if lower else t for t in some.to_pylist()]
        return pa.concat_arrays([_folded_texts(some[i:i + FOLDED]) for i in range(0, len(some), FOLDED)])

    texts = pc.ascii_lower(texts) if lower else texts
    return _where(texts, pc.invert(pc.string_is_ascii(texts)), other)


def _readable(texts: pa.Array) -> pa.Array:
    """Bytes that are no UTF-8 as replacement characters, as the JVM reads them."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([b if b is None else b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()], pa.string())


@dataclass(frozen=True)
class Profile:
    """A log dialect: its masks in order, and what is done around them.

    ``raw_masks`` look at the line as written, ``masks`` at its folded (and, with ``lower``,
    lower-cased) letters.  What is no ``letters`` then becomes a blank, and the first
    ``skip`` words go.  A dialect without one of its masks is ``replace(profile, masks=...)``.
    """

    masks: tuple[tuple[str, str, str], ...] = ()
    raw_masks: tuple[tuple[str, str, str], ...] = ()
    letters: str = LETTERS
    lower: bool = True
    skip: int = 0
    skip_chars: int = 0

    def in_batches(self) -> bool:
        """Whether RE2 knows all patterns."""
        return all(re2(p) for p in (self.letters, *[m[0] for m in (*self.raw_masks, *self.masks)]))

    def batch(self, raw: pa.Array) -> pa.Array:
        """``template`` of a batch of lines."""
        text = _readable(raw)
        text = pc.utf8_slice_codeunits(text, self.skip_chars) if self.skip_chars else text
        text = _masked_batch(text, self.raw_masks) if self.raw_masks else text
        text = _folded_batch(text, self.lower)
        text = _masked_batch(text, self.masks) if self.masks else text
        text = pc.utf8_trim(pc.replace_substring_regex(text, re2(self.letters), " "), " ")
        if self.skip <= 0:
            return text
        words = pc.list_slice(pc.split_pattern(text, " "), self.skip)
        return pc.binary_join(words, " ")

    def template(self, raw: Column) -> Column:
        body = F.substr(raw, F.lit(self.skip_chars + 1)) if self.skip_chars else raw
        text = mask(body, self.raw_masks) if self.raw_masks else body
        text = fold_letters(F.lower(text) if self.lower else text)
        text = mask(text, self.masks) if self.masks else text
        text = F.trim(F.regexp_replace(text, F.lit(self.letters), F.lit(" ")))
        if self.skip <= 0:
            return text
        words = F.split(text, " ")
        return F.array_join(F.slice(words, F.lit(self.skip + 1), F.size(words)), " ")


PROFILES: dict[str, Profile] = {
    "generic": Profile(GENERIC_MASKS),
    "bgl": Profile(raw_masks=BGL_MASKS, letters=LETTERS_AND_ANGLES),
    "hdfs": Profile(HDFS_MASKS),
    "thunderbird": Profile(raw_masks=THUNDERBIRD_MASKS, letters=LETTERS_AND_ANGLES, skip_chars=2),
}


def normalise(raw: Column, profile: str | Profile = "generic") -> Column:
    """A raw line as a template of words; empty when nothing is left.

    ``profile`` names a dialect or is one of the caller's own.
    """
    if isinstance(profile, str):
        if profile not in PROFILES:
            raise ValueError(f"unknown profile: {profile} (one of {sorted(PROFILES)})")
        profile = PROFILES[profile]
    if not profile.in_batches():
        return profile.template(raw)
    return F.arrow_udf(lambda lines: profile.batch(lines), "string")(raw)


def marker_label(raw: Column, marker: str = "-") -> Column:
    """0 for lines that start with the marker, 1 for all others."""
    return F.when(F.substring(raw, 1, 1) == marker, 0).otherwise(1)


def word_label(word: Column) -> Column:
    """Labels written as 0/1, as words, or by the marker rule; null when blank."""
    w = F.trim(word)
    return (
        F.when(w == "", None)
        .when(w.isin("1", "anomaly", "Anomaly", "abnormal"), 1)
        .when(w.isin("0", "normal", "Normal"), 0)
        .otherwise(marker_label(w))
    )


def block_id(raw: Column, pattern: str = BLOCK_ID) -> Column:
    """First block id of a line, null when there is none."""
    found = F.regexp_extract(raw, portable(pattern), 0)
    return F.when(found != "", found)


def block_ids(raw: Column, pattern: str = BLOCK_ID) -> Column:
    """Distinct block ids of a line in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(portable(pattern)), F.lit(0)))
