"""What a text looks like, in numbers: characters, words and lines, counted over whole batches of texts at once.

The texts of a batch are laid end to end as code points; a table gives each code point's
classes, so counts of characters, words and runs are array operations. Lines are classed once
each. Batches are cut to about a million characters, so memory doesn't grow with the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex

STATS = ("word_count", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")
EXTRA = ("lines", "words_a_line", "marked", "cells", "short", "ends_a_word", "broken", "mixed", "long_token", "hex", "no_vowel", "hard", "foreign", "digits", "letters", "lower_start", "even", "readable")

#: Characters that are worked on at once, if no text is longer.
PIECE = 1 << 20
#: A run of so many characters without a break is no word.
LONG = 30

# The classes of characters and the marks that begin an entry.
SPACES = " \t\n\x0b\x0c\r"
ENDS, CLOSERS = ".!?…。！？", "\"»”’)]"
MARKED = re.compile(r"[ \t\xa0]*(?:> ?)*(?:[-*+•·–—▪◦‣○●∙]|\[[ xX✓]?\]|[☐☑✓✗]|\(?[0-9]{1,3}[.)\]:]|#[0-9]{1,3}|[0-9]{1,3} [-–]|\([a-zA-Z]\)|[a-zA-Z][.)])[ \t]+[^ \t\n\x0b\f\r]")
COLUMNS = re.compile(r"[ \t]*+[^ \t\x0b\f\r]++(?: [^ \t\x0b\f\r]++){0,4}+(?:(?: {2,}+[^ \t\x0b\f\r]++(?: [^ \t\x0b\f\r]++){0,4}+){2,}+| {3,}+[^ \t\x0b\f\r]++(?: [^ \t\x0b\f\r]++){0,4}+)[ \t]*+")
RULE = re.compile(r"[ \t]*+(?:[+|][-=+|: ]{3,}+|[-=]{3,}+(?:[ +|]++[-=]{3,}+)++[ \t]*+)")
PLACE = re.compile(r"[0-9]{3} (?:[^\W\d_]| ){0,39}$")
HEX = re.compile(r"(?m)^[0-9a-fA-F]{4,16}:? +(?:[0-9a-fA-F]{2,4} ?){6,}|\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b")
HEX_LINE = re.compile(r"[0-9a-fA-F]{4,16}:? ")

# Bits of a code point's classes.
LETTER, MARK, NUMBER, SPACE, BLANK, LOWER, UNSEEN, JOIN, END, AFTER, SMALL, CAPITAL, DIGIT, CONSONANT, HEX_DIGIT, SIGN, C1, CLOSING = (1 << i for i in range(18))


def class_table() -> np.ndarray:
    """The classes of every code point, and in the upper byte what it is first of all (0 symbol, 1 Latin letter, 2 other letter, 3 number, 4 mark, 5 space)."""
    table = np.zeros(0x110000, np.uint32)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, bits in ((r"\p{L}", LETTER), (r"\p{M}", MARK), (r"\p{N}", NUMBER), (r"\p{Ll}", LOWER), (r"[\p{White_Space}\p{Cf}]", UNSEEN)):
        for m in regex.finditer(pattern + "+", every):
            table[np.fromiter(map(ord, m.group()), np.int64)] |= bits
    for chars, bits in (
        (SPACES, SPACE), (" \t", BLANK), ("'’-", JOIN), (ENDS, END), (SPACES + '"»”)', AFTER), ("abcdefghijklmnopqrstuvwxyz", SMALL), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", CAPITAL), ("0123456789", DIGIT),
        ("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ", CONSONANT), ("0123456789abcdef", HEX_DIGIT), ("+/=%{}&_|", SIGN), (')"»', CLOSING),
    ):
        table[[ord(c) for c in chars]] |= bits
    table[0x80:0xA0] |= C1
    table[0x85] &= ~np.uint32(C1)
    kind = np.zeros(len(table), np.uint32)
    kind[(table & LETTER) > 0] = 2
    for m in regex.finditer(r"[\p{L}&&\p{Script=Latin}]+", every, regex.V1):
        kind[np.fromiter(map(ord, m.group()), np.int64)] = 1
    kind[(table & NUMBER) > 0], kind[(table & MARK) > 0] = 3, 4
    space = (table & SPACE) > 0
    space[0x85] = True
    for m in regex.finditer(r"\p{Z}+", every):
        space[np.fromiter(map(ord, m.group()), np.int64)] = True
    kind[space] = 5
    return table | kind << np.uint32(24)


_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def word_numbers(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One number for each word of `lengths` code points that lie end to end in `codes`."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    return np.add.reduceat(codes.astype(np.uint64) * _WEIGHTS[np.minimum(place, 63)], starts) + lengths.astype(np.uint64)


def is_row(line: str) -> bool:
    """Whether a line is a row of columns or a rule between them."""
    if "|" in line and line.count("|") > 1:
        return True
    if "\t" in line and line[line.index("\t") + 1 :].strip(SPACES):
        return True
    if ";" in line:
        i = line.index(";")
        j = line.find(";", i + 1)
        if line[i + 1 : i + 2] != " ":
            rest = line[i + 1 :]
            if j > 0 and line[j + 1 : j + 2] != " " or i <= 40 and rest and j < 0 and " " not in rest:
                return True
    if "," in line:
        parts = line.split(",")
        if len(parts) > 2 and max(map(len, parts)) <= 40 and line[-1] not in ".!?" and not any(p[:1] == " " for p in parts[1:]) and not PLACE.search(line):
            return True
    if "  " in line and COLUMNS.fullmatch(line):
        return True
    return line.lstrip(" \t")[:1] in ("+", "|", "-", "=") and RULE.fullmatch(line) is not None


def is_short(line: str) -> bool:
    """Whether a line is one to six words without a mark at its end."""
    if line[-1] in ".!?…,":
        return False
    bare = line.strip(" \t")
    words = bare.split(" ", 40)
    return sum(map(bool, words)) <= 6 and len(bare) > 0 and (len(words) < 41 or len([w for w in bare.split(" ") if w]) <= 6) and not any(c in bare for c in "\t\x0b\x0c")


def _ends_in_mark(line: str) -> bool:
    bare = line.rstrip(" \t").rstrip(CLOSERS)
    return bool(bare) and bare[-1] in ENDS


def _greedy(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of spans in order those that a search from left to right takes, none into another."""
    keep = np.ones(len(starts), bool)
    close = np.flatnonzero(starts[1:] < ends[:-1]) + 1
    if len(close):
        last, s, e = -1, starts.tolist(), ends.tolist()
        before = -2
        for i in close.tolist():
            if before != i - 1:
                last = e[i - 1]
            if s[i] < last:
                keep[i] = False
            else:
                last = e[i]
            before = i
    return keep


def normal_lines(text: str) -> str:
    """`text` with every end of line as one line feed."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() else text.replace("\u2028", "\n").replace("\u2029", "\n").replace("\x85", "\n")


def _laid(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, each followed by a line feed, and where each text begins."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return codes, np.cumsum(size) - size


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def profile(texts: Sequence[str], table: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """STATS and EXTRA of every text as rows, and whether it has a visible character. `common`: sorted word_numbers."""
    n_docs = len(texts)
    texts = [normal_lines(t) for t in texts]
    x, begin = _laid(texts)
    c = table[x]
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff([*begin, len(x)]))
    count = lambda at: np.bincount(doc[at], minlength=n_docs).astype(float)
    kinds = np.bincount(doc * 8 + (c >> 24).astype(np.int32), minlength=8 * n_docs).reshape(n_docs, 8).astype(float)
    chars = np.diff([*begin, len(x)]).astype(float) - 1
    seen = np.logical_or.reduceat((c & UNSEEN) == 0, begin)

    # words
    lowered = [t.lower() for t in texts]
    y, low_begin = _laid(lowered)
    k = table[y]
    body = (k & (LETTER | MARK | NUMBER)) > 0
    inner = np.flatnonzero((k[1:-1] & JOIN) > 0) + 1
    inner = inner[body[inner - 1] & body[inner + 1]]
    body[inner] = True
    edge = np.flatnonzero(np.diff(body.view(np.int8), prepend=np.int8(0)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    of = np.searchsorted(low_begin, starts, "right") - 1
    words = np.bincount(of, minlength=n_docs).astype(float)
    in_words = np.bincount(of, weights=lengths, minlength=n_docs)
    known = np.zeros(n_docs)
    if len(common) and len(starts):
        numbers = word_numbers(y[body], lengths)
        at = np.minimum(np.searchsorted(common, numbers), len(common) - 1)
        known = np.bincount(of[common[at] == numbers], minlength=n_docs).astype(float)

    # lines
    feeds = np.flatnonzero(x == 10)
    first = np.concatenate([[0], feeds[:-1] + 1])
    owner = doc[first]
    size = feeds - first
    solid = (c & SPACE) == 0
    filled = np.logical_or.reduceat(solid, first)
    lines = np.bincount(owner[filled], minlength=n_docs).astype(float)
    widest = np.zeros(n_docs, np.int64)
    np.maximum.at(widest, owner, size)
    strings = [s for t in texts for s in t.split("\n")]
    shown = np.flatnonzero(filled)
    own = owner[shown]
    shown_strings = [strings[i] for i in shown.tolist()]
    of_lines = lambda test: np.bincount(own[np.fromiter(map(test, shown_strings), bool, len(shown_strings))], minlength=n_docs).astype(float)
    marked, cells, short, punct = of_lines(lambda s: MARKED.match(s) is not None), of_lines(is_row), of_lines(is_short), of_lines(_ends_in_mark)
    lead = first.copy()
    while len(indented := np.flatnonzero((c[lead] & BLANK) > 0)):
        lead[indented] += 1
    lower_start = count(lead[(c[lead] & LOWER) > 0])

    # pairs and runs of characters
    c1, c2 = c[1:], c[2:]
    sentence = np.flatnonzero((c1[:-1] & END) > 0)
    sentence = sentence[((c[sentence] & (LETTER | NUMBER | CLOSING)) > 0) & ((c[sentence + 2] & AFTER) > 0)]
    odd = np.flatnonzero((x == 0xC3) | (x == 0xC2) | (x == 0xFFFD) | ((c & C1) > 0))
    pair = (c[odd] & C1 > 0) & np.isin(x[np.maximum(odd - 1, 0)], (0xC3, 0xC2)) & (odd > 0)
    odd = odd[~pair]
    euro = np.flatnonzero(x[:-1] == 0xE2)
    broken = count(odd) + count(euro[x[euro + 1] == 0x20AC])
    small, cap, digit = (c & SMALL) > 0, (c & CAPITAL) > 0, (c & DIGIT) > 0
    plain = small | cap
    two = np.flatnonzero((small[:-1] & cap[1:]) | (plain[:-1] & digit[1:]) | (digit[:-1] & plain[1:]))
    three = np.flatnonzero((c1[:-1] & SIGN) > 0)
    three = three[((c[three] & LETTER) > 0) & ((c2[three] & (LETTER | NUMBER)) > 0)]
    spans = np.concatenate([np.stack([two, two + 2]), np.stack([three, three + 3])], axis=1)
    spans = spans[:, np.argsort(spans[0], kind="stable")]
    mixed = count(spans[0][_greedy(spans[0], spans[1])])
    unbroken = solid & (x != 45)
    edge = np.flatnonzero(np.diff(unbroken.view(np.int8), prepend=np.int8(0)))
    run, width = edge[::2], edge[1::2] - edge[::2]
    long_token = np.bincount(doc[run[width >= LONG]], weights=width[width >= LONG], minlength=n_docs)
    hard = (c & CONSONANT) > 0
    edge = np.flatnonzero(np.diff(hard.view(np.int8), prepend=np.int8(0)))
    run, stop = edge[::2], edge[1::2]
    run, stop = run[stop - run >= 4], stop[stop - run >= 4]
    hard_words = count(run)
    wordy = ((c & (LETTER | NUMBER | MARK)) > 0) | (x == 95)
    no_vowel = count(run[~wordy[stop] & ((run == 0) | ~wordy[np.maximum(run - 1, 0)])])
    hexed = (c & HEX_DIGIT) > 0
    edge = np.flatnonzero(np.diff(hexed.view(np.int8), prepend=np.int8(0)))
    wide = edge[::2][edge[1::2] - edge[::2] >= 8]
    hexes = np.zeros(n_docs)
    for i in np.unique(np.concatenate([doc[wide], own[np.fromiter((HEX_LINE.match(s) is not None for s in shown_strings), bool, len(shown_strings))]])).tolist():
        hexes[i] = sum(1 for _ in HEX.finditer(texts[i]))

    letters = kinds[:, 1] + kinds[:, 2]
    foreign = _ratio(kinds[:, 2], chars)
    share = _ratio(known, words)
    # each text's last line feed was added
    stats = [words, _ratio(in_words, words), _ratio(kinds[:, 0], chars), _ratio(punct, lines), share]
    extra = [
        lines, _ratio(words, lines), _ratio(marked, lines), _ratio(cells, lines), _ratio(short, lines), _ratio(count(sentence), words), _ratio(broken, chars), _ratio(mixed, words), _ratio(long_token, chars),
        _ratio(hexes, lines), _ratio(no_vowel, words), _ratio(hard_words, words), foreign, _ratio(kinds[:, 3], chars), _ratio(letters, chars), _ratio(lower_start, lines), _ratio(chars, lines * widest), np.maximum(share, foreign),
    ]
    return np.stack([*stats, *extra], axis=1), seen


def pieces(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in lists of about PIECE characters, null as empty; a longer text is a list of its own."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > PIECE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def profiler(shared):
    """Batches of (key, text) to (key, STATS, EXTRA) of the texts with a visible character. `shared`: a broadcast (class_table, common)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, common = shared.value
        for b in batches:
            rows, seen = zip(*[profile(p, table, common) for p in pieces(b.column(1).to_pylist())]) if len(b) else ((np.zeros((0, len(STATS) + len(EXTRA))),), (np.zeros(0, bool),))
            rows, seen = np.concatenate(rows), np.concatenate(seen)
            keys = b.column(0).filter(pa.array(seen))
            kept = rows[seen]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(kept[:, i]) for i in range(kept.shape[1]))], names=[b.schema.names[0], *STATS, *EXTRA])

    return run


def common_numbers(words: Iterable[str]) -> np.ndarray:
    """word_numbers of the words, sorted."""
    words = sorted({w.lower() for w in words if w})
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return np.sort(word_numbers(codes, np.fromiter(map(len, words), np.int64, len(words))))
