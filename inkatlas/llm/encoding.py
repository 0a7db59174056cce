"""Garbled text from wrong character encoding (problem 8).

The clean words of the corpus are garbled along every chain of encodings; the documents' words meet this table in a
hash join, so a word is suspect if it is what some known word becomes. A suspect passage is then decoded backwards as a
whole: it is repaired only if every one of its characters beyond ASCII takes part, which a sound sentence that quotes a
garbled character does not. What was lost on the way is taken from the known word. Where control characters were stripped
or no-break spaces turned into blanks, the passage is decoded word by word and known words must confirm it.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkatlas.operators.parallel import spread
from inkatlas.operators.skew import lookup
from inkatlas.storage import Stored

#: Encodings as which UTF-8 is misread.
MISREAD = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp1253", "iso8859-7", "cp1254", "cp437", "cp850", "cp852", "cp866", "cp737", "mac_roman", "mac_cyrillic", "mac_greek", "mac_latin2")
#: Encodings of one byte a character that are taken for one another.
SINGLE = ("cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "cp1253", "iso8859-7", "cp737", "cp437", "cp850", "cp852", "mac_roman", "mac_cyrillic", "mac_greek", "mac_latin2")
#: Misreadings that also occur twice in a row.
TWICE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250")
LOST = "�"

#: Where a text is cut into passages, and what counts as a word: a run of letters and of anything beyond ASCII.
PASSAGE = r"(?<=[.?!])[ \n]+|\n+"
WORD = "[A-Za-z\u0080-\U0010ffff]+"
BEYOND = "[^\\x00-\\x7f]"


def chains() -> list[tuple[str, ...]]:
    """Every chain: ``(write, read)`` pairs in a row; ``utf-8 read as X``, the same twice, ``X read as Y``, and ``X read
    as utf-8`` with what is not valid marked as lost."""
    once = [("utf-8", s) for s in MISREAD]
    twice = [("utf-8", a, "utf-8", b) for a in TWICE for b in TWICE if a == b or {a, b} == {"cp1252", "latin-1"}]
    single = [(a, b) for a in SINGLE for b in SINGLE if a != b]
    lost = [(a, "utf-8") for a in ("cp1252", "cp1250")]
    return once + twice + single + lost


def _kept(kind: str, key: str, make):
    """A value made once in each process (a plain function, so that it can be sent to executors by value)."""
    kept = globals().setdefault("_KEPT", {}).setdefault(kind, {})
    if key not in kept:
        if len(kept) >= 100_000:  # words of a corpus; everything else is far fewer
            kept.clear()
        kept[key] = make()
    return kept[key]


def _table(name: str) -> tuple[dict[int, str], dict[str, int], frozenset[int]]:
    """Byte to character, character to byte, and the undefined bytes, which pass as control characters."""
    return _kept("table", name, lambda: _make_table(name))


def _make_table(name: str) -> tuple[dict[int, str], dict[str, int], frozenset[int]]:
    forth: dict[int, str] = {}
    undefined = set()
    for b in range(128, 256):
        try:
            forth[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            forth[b] = chr(b)
            undefined.add(b)
    return forth, {c: b for b, c in forth.items()}, frozenset(undefined)


def _bare(name: str) -> frozenset[int]:
    """The bytes a cleaning may take away: undefined ones and those read as control characters."""
    forth, _, undefined = _table(name)
    return _kept("bare", name, lambda: undefined | {b for b, c in forth.items() if c < "\xa0"})


def _write(text: str, name: str) -> bytes:
    """Bytes of a text; in an encoding of one byte, a character it lacks becomes a question mark if letters are left."""
    if name == "utf-8":
        return text.encode("utf-8", "replace")
    back = _table(name)[1]
    return bytes(ord(c) if c < "\x80" else back.get(c, 63) for c in text)


#: Stands for a byte that is taken out; no text holds this noncharacter.
_OUT = "\uffff"


def _charmap(name: str, mode: str = "pass", bare: str | None = None, blank: bool = False) -> str:
    """All 256 characters of an encoding of one byte. Undefined bytes pass, are marked as lost or (``drop``) as to be
    taken out; ``bare`` replaces all bytes a cleaning may take away, ``blank`` the no-break space by a blank."""

    def make() -> str:
        forth, _, undefined = _table(name)
        swap = {"pass": {}, "drop": dict.fromkeys(undefined, _OUT), "mark": dict.fromkeys(undefined, LOST)}[mode]
        if bare is not None:
            swap = dict.fromkeys(_bare(name), bare)
        if blank:
            swap = swap | {b: " " for b, c in forth.items() if c == "\xa0"}
        return "".join(swap.get(b, forth.get(b, chr(b))) for b in range(256))

    return _kept("charmap", f"{name} {mode} {bare} {blank}", make)


def _decoded(data: bytes, charmap: str) -> str:
    text = codecs.charmap_decode(data, "strict", charmap)[0]
    return text.replace(_OUT, "") if _OUT in text else text


def _read(data: bytes, name: str, mode: str) -> str:
    """Characters of bytes; undefined bytes pass as control characters, are dropped or are marked as lost."""
    if name == "utf-8":
        return data.decode("utf-8", "replace")
    return _decoded(data, _charmap(name, mode))


def garble(word: str, chain: tuple[str, ...], mode: str = "pass") -> str:
    for write, read in zip(chain[::2], chain[1::2]):
        word = _read(_write(word, write), read, mode)
    return word


def strip_forms(word: str, chain: tuple[str, ...]) -> Iterator[str]:
    """What a cleaning leaves of a word misread as UTF-8: control characters dropped or marked, no-break space a blank."""
    write, read = chain[-2:]
    start = garble(word, chain[:-2]) if len(chain) > 2 else word
    data = _write(start, write)
    blanks = _kept("blanks", read, lambda: frozenset(b for b, c in _table(read)[0].items() if c == "\xa0"))
    has_bare, has_blank = not _bare(read).isdisjoint(data), not blanks.isdisjoint(data)
    for bare in (None, _OUT, LOST) if has_bare else (None,):
        if bare is not None:
            yield _decoded(data, _charmap(read, bare=bare))
        if has_blank:
            yield _decoded(data, _charmap(read, bare=bare, blank=True))


_SEQUENCE = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


#: First bytes of the characters that Latin, Greek and Cyrillic text and its punctuation are made of.
_LEADS = frozenset(range(0xC2, 0xC6)) | {0xCE, 0xCF, 0xD0, 0xD1, 0xE2}


def _sequences(data: bytes, gaps: bool, loose: bool = False) -> tuple[str, int] | None:
    """Strict UTF-8, or with ``gaps`` also sequences that lack one byte or hold a lost one (0xff); (text, lost ones).

    With ``loose`` a sequence may lack any number of tail bytes; one that lacks all must begin with a common first byte.
    """
    try:
        return data.decode("utf-8"), 0
    except UnicodeDecodeError:
        if not gaps:
            return None
    out, lost, i = [], 0, 0
    while i < len(data):
        m = _SEQUENCE.match(data, i)
        if m:
            try:
                out.append(m.group().decode("utf-8"))
            except UnicodeDecodeError:
                return None
            i = m.end()
            continue
        lead = data[i]
        need = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
        j = i + 1
        while j < len(data) and j - i <= need and (0x80 <= data[j] <= 0xBF or data[j] == 0xFF):
            j += 1
        tail = data[i + 1 : j]
        short = loose and (len(tail) > 0 or lead in _LEADS)
        if not need or not (len(tail) == need or short or len(tail) == need - 1 and 0xFF not in tail):
            return None
        out.append(LOST)
        lost += 1
        i = j
    return "".join(out), lost


def _steps_back(chain: tuple[str, ...]) -> list[tuple]:
    """Each round of a chain, last first: what wrote and read it, the reader's encoding table, bytes the writer never
    sends and its characters (null for UTF-8)."""
    out = []
    for write, read in zip(chain[-2::-2], chain[::-2]):
        plain = write != "utf-8"
        out.append((write, read, None if read == "utf-8" else codecs.charmap_build(_charmap(read)), _table(write)[2] if plain else frozenset(), _charmap(write) if plain else None))
    return out


def ungarble(text: str, chain: tuple[str, ...], loose: bool = False) -> tuple[str, int] | None:
    """The text before the chain, with the number of characters lost on the way; None if it cannot have come from it.

    ``loose`` admits characters of which any number of tail bytes is gone; known words must then confirm the result.
    """
    lost = 0
    for write, read in zip(chain[-2::-2], chain[::-2]):
        if read == "utf-8":
            return None
        _, back, undefined = _table(read)
        if LOST not in text:
            try:
                sent = codecs.charmap_encode(text, "strict", _kept("encoding", read, lambda: codecs.charmap_build(_charmap(read))))[0]
            except UnicodeEncodeError:
                return None
            if write != "utf-8":
                if not _table(write)[2].isdisjoint(sent):
                    return None
                text = _decoded(sent, _charmap(write))
                continue
            try:
                text = sent.decode("utf-8")
                continue
            except UnicodeDecodeError:
                pass
        data = bytearray()
        for c in text:
            if c < "\x80":
                data.append(ord(c))
            elif c in back:
                data.append(back[c])
            elif c == LOST and (undefined or lost or loose):
                data.append(0xFF)
            else:
                return None
        if write == "utf-8":
            got = _sequences(bytes(data), bool(undefined) or lost > 0 or loose, loose)
            if got is None:
                return None
            text, more = got
            lost += more
        else:
            forth, _, never = _table(write)
            if never & {b for b, c in zip(data, text) if c != LOST}:
                return None
            text = "".join(LOST if c == LOST else forth.get(b, chr(b)) for b, c in zip(data, text))
            lost += text.count(LOST)
    return text, lost


def _by_utf8(chain: tuple[str, ...]) -> bool:
    return chain[0] == "utf-8"


def looks_garbled(word: str) -> bool:
    """True if the word cannot be a clean word: it holds lost or control characters or decodes as misread UTF-8 to
    letters of Europe or symbols (’é reads as an Armenian letter written in mac_roman and is sound)."""
    if LOST in word or any("\x7f" < c < "\xa0" for c in word):
        return True
    if sum(c > "\x7f" for c in word) < 2:
        return False
    read = [ungarble(word, ("utf-8", s)) for s in MISREAD]
    return any(all(c < "\u0530" or "\u1e00" <= c < "\u3000" or c == LOST for c in r[0]) for r in read if r is not None)


#: Marks that sound text sets next to letters.
_MARKS = frozenset("‘’‚‛“”„‟‹›«»–—―…·•¿¡°§¶№′″‐‑\xa0\xad\u200b\u2009\u202f")


def _script(c: str) -> str:
    """Script of a letter, ``mark`` for anything that goes with any, ``odd`` for other signs."""
    if c in _MARKS or unicodedata.category(c)[0] in "MN" and c not in "²³¹¼½¾":
        return "mark"
    if not c.isalpha() or c in "ªºµ":
        return "odd"
    return unicodedata.name(c, "odd").split(" ")[0]


def oddness(text: str) -> int:
    """How little the words look like any language: signs among letters, mixed scripts, capitals after small letters, long
    runs of accented Latin letters. It is told from the text alone, so copies do not move it."""
    return sum(_kept("odd", word, lambda word=word: _odd_word(word)) for word in re.findall(WORD, text) if not word.isascii())


def _odd_word(word: str) -> int:
    kinds = [_kept("script", c, lambda c=c: _script(c)) for c in word]
    letters = Counter(k for k in kinds if k not in ("mark", "odd"))
    if not letters:
        return 0
    odd = kinds.count("odd") + sum(letters.values()) - max(letters.values())
    odd += sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
    return odd + sum(len(run) >= 4 for run in "".join("x" if k == "LATIN" and c > "\x7f" else " " for k, c in zip(kinds, word)).split())


def _plans() -> tuple[list, dict[str, list]]:
    """The chains that begin with UTF-8, and of the others, by the encoding that writes, ``(number, read, undefined bytes
    of read, its characters in each mode)``."""
    wide, single = [], {}
    for number, chain in enumerate(chains_kept()):
        if _by_utf8(chain):
            wide.append((number, chain))
        else:
            read = chain[1]
            maps = () if read == "utf-8" else tuple(_charmap(read, mode) for mode in ("pass", "drop", "mark"))
            single.setdefault(chain[0], []).append((number, read, frozenset() if read == "utf-8" else _table(read)[2], maps))
    return wide, single


def forms_of(word: str) -> Iterator[tuple[str, int]]:
    """``(garbled form, chain number)`` of a clean word. Letters of one byte need a word of three letters to be told.

    A form in which a no-break space became a blank holds that blank. A word is written once in each encoding and the
    bytes are read in every other; how undefined bytes are treated matters only where there are any.
    """
    wide, single = _kept("plans", "", _plans)
    for number, chain in wide:
        seen = {word}
        for form in (*(garble(word, chain, mode) for mode in ("pass", "drop", "mark")), *strip_forms(word, chain)):
            if form not in seen and not form.isascii():
                seen.add(form)
                yield form, number
    letters = sum(c.isalpha() for c in word)
    ours = [c for c in word if c > "\x7f"]
    if letters < 3:
        return
    for first, reads in single.items():
        back = _table(first)[1]
        there = sum(c in back for c in ours)
        if there * 2 <= len(ours):
            continue
        data = _write(word, first)
        for number, read, undefined, maps in reads:
            if read == "utf-8":
                if there == len(ours) and letters >= 2 + len(ours):
                    form = data.decode("utf-8", "replace")
                    if form != word:
                        yield form, number
                continue
            seen = {word}
            for charmap in maps[:1] if undefined.isdisjoint(data) else maps:
                form = _decoded(data, charmap)
                if form not in seen and not form.isascii():
                    seen.add(form)
                    yield form, number


def chains_kept() -> tuple[tuple[str, ...], ...]:
    return _kept("chains", "", lambda: tuple(chains()))


#: Length of the longest form of one character: 4 bytes, each misread as a character of up to 3 bytes, misread again.
LONGEST_FORM = 4 * 3


def _words_first(known: list[tuple[str, str]]) -> dict[str, str]:
    """Form to original; where a form may be a word or a mark, the word."""
    return dict(sorted(known, key=lambda k: any(c.isalpha() for c in k[1])))


_ALONG = "[A-Za-z\u0080-\U0010ffff]"


def _fill(passage: str, chain: tuple[str, ...], known: list[tuple[str, str]]) -> str | None:
    """A passage some of whose bytes were stripped, word by word; None unless known words confirm it.

    Every word beyond ASCII must be a known form or decode. Those that lost characters and are not known may be no more
    than a third, and at least one word must tell: known with three letters, or decoded without loss. Where a form may
    be a word or a mark, it is the mark between two numbers and the word elsewhere.
    """
    originals = _words_first(known)
    marks = {w: o for w, o in known if not any(c.isalpha() for c in o)}
    spaced = sorted((f for f in originals if " " in f), key=len, reverse=True)
    # A form that ends in a blank stands before another blank or a mark, not before a word or number.
    forms = "".join(f"(?<!{_ALONG}){re.escape(f)}(?!{_ALONG}|[0-9])|" for f in spaced)
    parts = re.split(f"({forms}{WORD})", passage)
    sure = unsure = 0
    tells = False
    for i in range(1, len(parts), 2):
        part = parts[i]
        if not any(c > "\x7f" for c in part):
            continue
        if part in originals:
            before, after = parts[i - 1].rstrip(" "), parts[i + 1].lstrip(" ")
            between = before[-1:].isdigit() and after[:1].isdigit()
            parts[i] = marks.get(part, originals[part]) if between else originals[part]
            sure += 1
            tells = tells or sum(c.isalpha() for c in parts[i]) >= 3
            continue
        one = ungarble(part, chain, loose=True)
        if one is None:
            return None
        parts[i] = one[0]
        if one[1]:
            unsure += 1
        else:
            sure += 1
            tells = True
    return "".join(parts) if tells and sure >= 2 * unsure else None


def repair_passage(passage: str, options: list[tuple[int, list[tuple[str, str]], float]]) -> tuple[str, int, int] | None:
    """A suspect passage repaired: ``(text, chain used, characters lost for good)``; None if it is sound.

    ``options``: ``(chain, [(word, original)], weight)``. A passage is decoded by the chain of largest weight among those
    that decode it wholly; a chain of single bytes also needs known originals for at least half of the passage's words
    beyond ASCII, must not leave it odder, and among several the least odd result counts. If none does, bytes may have
    been stripped: the chain that loses least is taken. Known originals stand wherever the table has one.
    """
    words = [w for w in re.findall(WORD, passage) if not w.isascii()]
    ordered = sorted(options, key=lambda o: (-o[2], o[0]))
    singles = []
    for rank, (chain_number, known, _) in enumerate(ordered):
        chain = chains_kept()[chain_number]
        originals = _words_first(known)
        if _by_utf8(chain):
            got = ungarble(passage, chain)
            if got is None:
                continue
            fixed, lost = got
            if lost and LOST not in passage and not any(c > "\x7f" and c != LOST for c in fixed) and not any(sum(c.isalpha() for c in originals.get(w, "")) >= 3 for w in words):
                continue  # a quoted sign that could be the rest of anything
            gone = 0
            if lost:
                swapped = re.sub(WORD, lambda m: originals.get(m.group(), m.group()), passage)
                parts = re.split(f"({WORD})", swapped)
                for i in range(1, len(parts), 2):
                    if parts[i] not in originals.values():
                        one = ungarble(parts[i], chain)
                        parts[i] = one[0] if one else parts[i]
                fixed = "".join(parts)
                gone = fixed.count(LOST)
            if not singles:
                return fixed, chain_number, gone
            break
        sure = sum(w in originals for w in words)
        if 2 * sure < len(words) or not sure:
            continue
        parts = re.split(f"({WORD})", passage)
        whole = True
        for i in range(1, len(parts), 2):
            if parts[i].isascii():
                continue
            if parts[i] in originals:
                parts[i] = originals[parts[i]]
            elif chain[1] != "utf-8":
                one = ungarble(parts[i], chain)
                whole = whole and one is not None
                parts[i] = one[0] if one else parts[i]
        if not whole:
            continue
        fixed = "".join(parts)
        odd = oddness(fixed)
        if odd <= oddness(passage):
            singles.append((odd, rank, fixed))
    else:
        filled = [] if singles else [(f.count(LOST), rank, f) for rank, o in enumerate(ordered) if _by_utf8(chains_kept()[o[0]]) and (f := _fill(passage, chains_kept()[o[0]], o[1])) is not None]
        if filled:
            lost, rank, fixed = min(filled)
            return fixed, ordered[rank][0], lost
    if singles:
        _, rank, fixed = min(singles)
        return fixed, ordered[rank][0], fixed.count(LOST)
    return None


def _byte_classes() -> tuple[np.ndarray, ...]:
    """Classes of the bytes of UTF-8: what a word is made of, blanks, ends of sentences."""

    def of(values) -> np.ndarray:
        out = np.zeros(256, bool)
        out[list(values)] = True
        return out

    return of([*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]), of(b" \n"), of(b".?!")


def words_beyond(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Every word beyond ASCII of a column of strings: ``(row, passage, word)``, found on the bytes of all texts at once.

    Passages are numbered as ``re.split(PASSAGE, text)`` numbers them.
    """
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if text.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    in_word, in_blank, ends = _kept("bytes", "classes", _byte_classes)
    high = np.flatnonzero(data > 127)
    outside = ~in_word[data]
    # Words are found from their bytes beyond ASCII: from behind the last other byte to the next, within their text.
    upto = np.cumsum(outside, dtype=np.int32)[high]
    other = np.r_[-1, np.flatnonzero(outside), len(data)]
    row = np.searchsorted(offsets, high, side="right") - 1
    starts, stops = np.maximum(other[upto] + 1, offsets[row]), np.minimum(other[upto + 1], offsets[row + 1])
    new = np.r_[True, starts[1:] != starts[:-1]] if len(starts) else np.zeros(0, bool)
    row, starts, stops = row[new], starts[new], stops[new]
    # Passages end before blanks that follow the end of a sentence, and before line ends.
    at = np.flatnonzero(ends[data[:-1]] & in_blank[data[1:]])
    at = at[np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + 1, side="right")] + 1
    lines = np.flatnonzero(data == 10)
    if len(lines):
        begin = offsets[np.searchsorted(offsets, lines, side="right") - 1]
        solid = np.maximum.accumulate(np.where(in_blank[data], -1, np.arange(len(data))))[lines]
        first = (lines == begin) | (data[lines - 1] != 10)
        lines = lines[first & ~((solid >= begin) & ends[data[solid]])]
        at = np.sort(np.r_[at, lines])
    passage = np.searchsorted(at, starts) - np.searchsorted(at, offsets[row])
    lens = stops - starts
    ends_at = np.r_[0, np.cumsum(lens)]
    picked = data[np.arange(ends_at[-1]) + np.repeat(starts - ends_at[:-1], lens)]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(picked)))
    return row, passage, words.cast(pa.string())


def word_counts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, word, n)``: every distinct word beyond ASCII of every text, with the number of passages that hold it."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, passage, word = words_beyond(batch.column(1))
            if not len(row):
                continue
            coded = word.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            words = len(coded.dictionary)
            key = np.unique((row * (int(passage.max()) + 1) + passage) * words + code)
            pair, n = np.unique(key // words // (int(passage.max()) + 1) * words + key % words, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair // words)), coded.dictionary.take(pa.array(pair % words)), pa.array(n)], names=["id", "word", "n"])

    return spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {id_type}, word string, n bigint")


def passages_of(texts: DataFrame) -> DataFrame:
    """``(id, passage, text, words)``: the passages with a word beyond ASCII of ``(id, text)``, with those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, parts, words = [], [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, part in enumerate(re.split(PASSAGE, text)):
                    if not part.isascii():
                        ids.append(id_)
                        numbers.append(number)
                        parts.append(part)
                        words.append(sorted({w for w in re.findall(WORD, part) if not w.isascii()}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(parts, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["id", "passage", "text", "words"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, passage int, text string, words array<string>")


def suspect_words(counts: DataFrame, tasks: int) -> DataFrame:
    """``(word, options)``: the corpus words ``(word, n)`` that some clean word becomes along some chain of encodings.

    An option holds the chain, the whole form (a form with a blank is found by its parts), its original (null for a rare
    symbol known by its start only) and how often that occurs, whether the original is less odd, whether the option is
    firm, and whether it tells a garbled passage. A single character is what is left of too many others to tell; it helps
    where other words do.
    """
    chars = counts.select(F.explode(F.array_distinct(F.filter(F.split("word", ""), lambda c: c.rlike(BEYOND)))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                rows = []
                for word, n, alone in zip(pdf["word"].iloc[i : i + 500], pdf["n"].iloc[i : i + 500], pdf["alone"].iloc[i : i + 500]):
                    if alone or not looks_garbled(word):
                        for form, chain in forms_of(word):
                            # The blank in a form ends a word of the text; each of its parts finds the form.
                            parts = {p for p in re.findall(WORD, form) if not p.isascii()} if " " in form else (form,)
                            rows += [(part, form, word, chain, n, alone, _by_utf8(chains_kept()[chain])) for part in parts]
                yield pd.DataFrame(rows, columns=["form", "whole", "word", "chain", "n_word", "alone", "utf8"])

    clean = counts.select("word", "n", F.lit(False).alias("alone")).unionByName(chars.select("word", "n", F.lit(True).alias("alone")))
    forms = Stored(clean.repartition(tasks).mapInPandas(table, "form string, whole string, word string, chain int, n_word bigint, alone boolean, utf8 boolean"))
    met = counts.withColumnRenamed("word", "form").join(forms.df.where("NOT alone"), "form").select(F.col("form").alias("word"), "chain", "whole", F.col("word").alias("original"), "n_word", "n", "utf8")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            odd = {w: oddness(w) for w in {*pdf["word"], *pdf["original"]}}
            pdf["gain"] = [odd[w] - odd[o] for w, o in zip(pdf["word"], pdf["original"])]
            yield pdf.drop(columns="n")[pdf["gain"] >= 0].assign(firm=(pdf["gain"] > 0) | (pdf["n_word"] > pdf["n"]))

    # A form of single bytes is suspect if its original is less odd; one as odd if it is the commoner word, or beside one less odd.
    judged = met.where("NOT utf8").mapInPandas(compare, "word string, chain int, whole string, original string, n_word bigint, utf8 boolean, gain int, firm boolean")
    whole = met.where("utf8").select("word", "chain", "whole", "original", "n_word", F.lit(0).alias("gain"), F.lit(True).alias("firm")).unionByName(judged.drop("utf8"))
    # Words beyond the corpus vocabulary (rare symbols in quotes): the start of the garbled run is a known character's form.
    run = F.regexp_extract("form", r"([\x{80}-\x{10ffff}]{2,})", 1)
    starts = counts.withColumnRenamed("word", "form").select("form", run.alias("run")).where(F.length("run") >= 2)
    starts = starts.select("form", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.length("run"), F.lit(LONGEST_FORM))), lambda i: F.substring("run", F.lit(1), i))).alias("start"))
    begun = starts.join(forms.df.where("alone AND utf8 AND length(form) >= 2 AND form = whole").select(F.col("form").alias("start"), "chain"), "start").select(F.col("form").alias("word"), "chain", F.col("form").alias("whole"), F.lit(None).cast("string").alias("original"), F.lit(0).cast("bigint").alias("n_word"), F.lit(0).alias("gain"), F.lit(True).alias("firm"))
    per_chain = whole.unionByName(begun).groupBy("word", "chain", "whole", F.coalesce(F.col("original").rlike(r"\p{L}"), F.lit(False)).alias("_letters")).agg(F.max(F.struct("firm", "n_word", "original", "gain")).alias("b"))
    option = F.struct("chain", "whole", F.col("b.original").alias("original"), F.col("b.n_word").alias("n_word"), (F.col("b.gain") > 0).alias("less"), F.col("b.firm").alias("firm"), (F.col("b.firm") & (F.length("word") > 1)).alias("tells"))
    return per_chain.groupBy("word").agg(F.collect_list(option).alias("options"))  # a few entries for each chain


#: Ids of suspect texts are broadcast up to this number (about 16 MB), joined by shuffle beyond it.
MOST_BROADCAST = 1_000_000


def repair_passages(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Garbled passages of distinct texts: ``(fixed, members, texts)``.

    ``fixed``: ``(rep, passage, fixed, chain, lost)``; ``members``: ``(id, rep)``, every text beyond ASCII and the
    smallest id that holds a copy of it; ``texts``: ``(id, text)`` of the suspect representatives.
    """
    spark = documents.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Each distinct text counts once, however many ids hold a copy of it.
    beyond = F.octet_length("text") > F.length("text")
    keyed = Stored(given.where(beyond).select("id", F.concat_ws(":", F.xxhash64("text"), F.crc32("text"), F.length("text")).alias("key"))).df
    members = Stored(lookup(keyed, keyed.groupBy("key").agg(F.min("id").alias("rep")), "key", "inner").select("id", "rep")).df
    firsts = members.where("id = rep").select("id")
    seen = Stored(word_counts(given, "id", "text").join(firsts, "id", "left_semi")).df
    counts = Stored(seen.groupBy("word").agg(F.sum("n").alias("n"))).df
    suspects = Stored(suspect_words(counts, tasks)).df
    telling = suspects.where(F.exists("options", lambda o: o["tells"])).select("word")
    touched = Stored(lookup(seen.select("id", "word"), telling, "word", "inner").select("id").distinct()).df
    few = touched.count() <= MOST_BROADCAST
    texts = Stored(given.join(F.broadcast(touched) if few else touched, "id")).df
    passages = Stored(passages_of(texts.repartition(tasks))).df
    hits = lookup(passages.select("id", "passage", F.explode("words").alias("word")), suspects, "word", "inner").select("id", "passage", "word", F.explode("options").alias("o"))
    # A suspect word weighs more the commoner its original is; one known by its start only weighs least.
    weight = F.lit(1.0) + F.log2(F.lit(1.0) + F.col("o.n_word"))
    known = F.when(F.col("o.original").isNotNull(), F.struct(F.col("o.whole").alias("word"), "o.original", "o.firm"))
    votes = hits.groupBy("id", "passage", "o.chain").agg(F.collect_list(known).alias("known"), F.sum(weight).alias("votes"), F.max("o.less").alias("less"), F.max("o.tells").alias("tells")).where("tells")
    votes = votes.withColumn("known", F.filter("known", lambda k: F.col("less") | k["firm"]))
    listed = votes.groupBy("id", "passage").agg(F.collect_list(F.struct("chain", "votes", F.coalesce("known", F.array()).alias("known"))).alias("s"))
    known_of = F.flatten(F.col("s")["known"])
    # Plain lists, as structs within lists reach Python slowly.
    per_passage = listed.select("id", "passage", F.col("s")["chain"].alias("chain"), F.col("s")["votes"].alias("votes"), F.transform(F.col("s")["known"], F.size).alias("sizes"), known_of["word"].alias("word"), known_of["original"].alias("original"))

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (text, chain, votes, sizes, word, original) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("text", "chain", "votes", "sizes", "word", "original")])):
                known = zip(word, original)
                got = repair_passage(text, [(c, list(islice(known, n)), v) for c, v, n in zip(chain, votes, sizes)])
                if got is not None:
                    rows.append(i)
                    found.append(got)
            kept = pa.array(rows, pa.int64())
            fixed, chain, lost = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(kept), batch.column("passage").take(kept), pa.array(fixed, pa.string()), pa.array(chain, pa.int32()), pa.array(lost, pa.int32())], names=["rep", "passage", "fixed", "chain", "lost"])

    id_type = given.schema["id"].dataType.simpleString()
    fixed = passages.select("id", "passage", "text").join(per_passage, ["id", "passage"]).mapInArrow(fix, f"rep {id_type}, passage int, fixed string, chain int, lost int")
    return Stored(fixed).df, members, texts


def garbled_ids(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id)`` of every document of which a passage is garbled."""
    fixed, members, _ = repair_passages(documents, id_col, text_col)
    return lookup(members, fixed.select("rep").distinct(), "rep", "inner").select("id")


def repair(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Garbled documents with their text restored: ``(id, restored, passages, chains, lost)``, one row for each.

    ``passages`` is the number of repaired passages, ``chains`` names the encodings in use, ``lost`` counts characters
    that no known word could bring back (left as U+FFFD). Documents without a garbled passage, null and empty texts
    give no row. Repeated texts are repaired once and each id gets the result; ids must be unique.
    """
    fixed, members, texts = repair_passages(documents, id_col, text_col)
    per_text = fixed.groupBy("rep").agg(F.collect_list(F.struct("passage", "fixed", "chain", "lost")).alias("fixed"))  # at most a text's passages

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rep, text, fixed in zip(pdf["rep"], pdf["text"], pdf["fixed"]):
                pieces = re.split(f"({PASSAGE})", text)
                for f in fixed:
                    pieces[2 * f["passage"]] = f["fixed"]
                rows.append((rep, "".join(pieces), len(fixed), sorted({" > ".join(chains_kept()[f["chain"]]) for f in fixed}), sum(f["lost"] for f in fixed)))
            yield pd.DataFrame(rows, columns=["rep", "restored", "passages", "chains", "lost"])

    id_type = members.schema["id"].dataType.simpleString()
    restored = texts.withColumnRenamed("id", "rep").join(per_text, "rep").mapInPandas(put_together, f"rep {id_type}, restored string, passages int, chains array<string>, lost int")
    return lookup(members, Stored(restored).df, "rep", "inner").select("id", "restored", "passages", "chains", "lost")
