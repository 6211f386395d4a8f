"""Cut texts into the pretokens of a byte-level tokenizer, each distinct one found once.

The splitting pattern never joins a visible character with a blank behind it, so a text may be
cut into units before its blanks, except inside runs of white space. Units are coded by number,
and only the distinct ones are cut further, by the classes of neighbouring characters.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skein.llm.common import flat_bytes, gather, ragged

_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE = range(5)

#: White space for finding runs that must not be cut; a few signs more than the pattern's do no harm.
_RUN = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"

#: Contractions of the splitting pattern, fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _longs(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(np.int64)


def cut_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Unit numbers of all texts in order, units per text, and the units: a blank and what
    follows it; the first unit of a text has no blank. A text with a blank between white space
    and white space (or the end) is one unit."""
    parts = pc.split_pattern(texts, " ")
    coded = pa.concat_arrays([parts.flatten()]).dictionary_encode()
    words, numbers, counts = coded.dictionary, _longs(coded.indices), _longs(pc.list_value_length(parts))
    heads = np.cumsum(counts) - counts
    empty = _flags(pc.equal(pc.binary_length(words), 0))
    ends = _flags(pc.match_substring_regex(words, _RUN + r"\z"))
    begins = empty | _flags(pc.match_substring_regex(words, r"\A" + _RUN))
    before = (ends | empty)[numbers]
    before[heads] = ends[numbers[heads]]
    inner = np.ones(len(numbers), bool)
    inner[heads] = False
    bad = np.flatnonzero(before[:-1] & begins[numbers[1:]] & inner[1:]) + 1
    whole = np.zeros(len(counts), bool)
    whole[np.searchsorted(heads, bad, side="right") - 1] = True
    if whole.any():
        stay = np.repeat(~whole, counts)
        numbers, inner = numbers[stay], inner[stay]
        counts = np.where(whole, 1, counts)
    head = np.flatnonzero(~inner)
    first, first_of = np.unique(numbers[head], return_inverse=True)
    numbers[head] = len(words) + first_of
    with_blank = pc.binary_join_element_wise(pa.scalar(""), words, " ")
    units = pa.concat_arrays([with_blank, words.take(pa.array(first)), texts.filter(pa.array(whole))])
    if whole.any():
        out = np.empty(int(counts.sum()), np.int64)
        in_whole = np.repeat(whole, counts)
        out[~in_whole] = numbers
        out[in_whole] = len(words) + len(first) + np.arange(int(whole.sum()))
        numbers = out
    return numbers, counts, units


def character_classes() -> np.ndarray:
    """The class of every code point under the splitting pattern."""
    import regex

    classes = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    step = 1 << 14
    for at in range(0, sys.maxunicode + 1, step):  # in parts: the strings are short-lived
        if 0xD800 <= at < 0xE000:
            continue
        every = "".join(map(chr, range(at, min(at + step, 0xD800 if at < 0xD800 else sys.maxunicode + 1))))
        for pattern, number in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
            found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)
            classes[found] = number
    classes[0x20] = _BLANK
    return classes


def pretoken_starts(points: np.ndarray, kind: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where pretokens start, for concatenated units: code points, their classes, and whether a
    unit starts there. White space at the end of a unit is at the end of its text or stands
    before a blank that belongs to what follows, so it is one run."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    space = kind >= _BLANK
    tail = np.append(head[1:], True)  # the last character of a unit
    before = np.concatenate([[_OTHER], kind[:-1]])
    space_before = np.concatenate([[False], space[:-1]]) & ~head
    start = head | (kind != before)
    start[space & space_before] = False  # inside a run
    start |= space & ~tail & ~np.append(space[1:], False)  # the last of a run with something behind it
    start[1:] &= ~((kind[:-1] == _BLANK) & ~space[1:] & ~head[1:])  # what follows a blank joins it
    quote = np.flatnonzero(points == 0x27)
    # a quote starts a pretoken unless a sign or a blank stands before it
    quote = quote[head[quote] | (before[quote] != _OTHER) & (before[quote] != _BLANK)]
    taken = np.zeros(n, bool)
    next_head, letter = np.append(head, [True] * 3), np.append(points, [0] * 3)
    for word in CONTRACTIONS:
        fits = ~taken[quote]
        for k, c in enumerate(word, 1):
            fits &= (letter[quote + k] == ord(c)) & ~next_head[quote + k]
        at = quote[fits]
        taken[at] = True
        for k in range(1, len(word) + 1):
            start[at + k] = False
        after = at + len(word) + 1
        start[after[after < n]] = True
    return start


@dataclass
class Pretokens:
    """Texts as numbers of units, units as numbers of pretokens, and the distinct pretokens."""

    numbers: np.ndarray  # units of all texts in order
    counts: np.ndarray  # units of each text
    parts: np.ndarray  # pretokens of all units in order
    part_counts: np.ndarray  # pretokens of each unit
    values: pa.Array  # bytes of the distinct pretokens

    def per_text(self, of_pretoken: np.ndarray) -> np.ndarray:
        """Sums of a number of each pretoken over the texts: a prefix scan over their units."""
        inside = np.concatenate([[0], np.cumsum(of_pretoken[self.parts])])
        ends = np.cumsum(self.part_counts)
        of_unit = inside[ends] - inside[ends - self.part_counts]
        scan = np.concatenate([[0], np.cumsum(of_unit[self.numbers])])
        ends = np.cumsum(self.counts)
        return scan[ends] - scan[ends - self.counts]


class Splitter:
    """Made once in a task, with the character classes of the driver if it has sent them."""

    def __init__(self, special: list[str], classes: np.ndarray | None = None):
        self.classes, self.special = character_classes() if classes is None else classes, special

    def split(self, texts: pa.Array) -> Pretokens:
        numbers, counts, units = cut_units(texts)
        data, ends = flat_bytes(units)
        joined = data[: ends[-1]].tobytes()
        points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        size = _longs(pc.utf8_length(units))
        head = np.zeros(len(points), bool)
        head[(np.cumsum(size) - size)[size > 0]] = True
        starts = np.flatnonzero(pretoken_starts(points, self.classes[points], head))
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(width)])
        cuts = np.append(place[starts], place[-1]).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(joined)]
        ).dictionary_encode()
        owner = np.searchsorted(np.cumsum(size), starts, side="right")
        return Pretokens(numbers, counts, _longs(found.indices), np.bincount(owner, minlength=len(units)), found.dictionary)

    def cut_special(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts cut at special strings, which are tokens of their own: pieces, pieces per text."""
        pieces, owner = texts, np.arange(len(texts))
        for content in self.special:
            parts = pc.split_pattern(pieces, content)
            owner = np.repeat(owner, _longs(pc.list_value_length(parts)))
            pieces = pa.concat_arrays([parts.flatten()])
        return pieces, np.bincount(owner, minlength=len(texts))


def id_tables(vocabulary: str) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    """What an ``IdEncoder`` works out from its vocabulary: special tokens, bytes of each token and
    character classes. The driver makes them once and sends them to the tasks."""
    from tokenizers import Tokenizer

    return _id_tables(Tokenizer.from_file(vocabulary))


def _id_tables(library) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    added = library.get_added_tokens_decoder()
    if len(added) > 1:
        raise ValueError("more than one special token")
    special = [(t.content, k) for k, t in added.items()]
    # byte-level vocabularies write each byte as one letter
    by_id = sorted((k, len(token)) for token, k in library.get_vocab(False).items())
    width = np.zeros(by_id[-1][0] + 1, np.int64)
    width[[k for k, _ in by_id]] = [n for _, n in by_id]
    return special, width, character_classes()


class IdEncoder:
    """Ids of whole texts as the tokenizers library gives them, each distinct pretoken encoded once."""

    #: Pretokens that the library gets in one string.
    GROUP = 2000

    def __init__(self, vocabulary: str, tables: tuple | None = None, remember: bool = False, known: tuple | None = None):
        """With ``remember``, pretokens of earlier calls are not encoded again: for a bounded run of
        texts. ``known`` are such pretokens to begin with, from ``common_pretokens``."""
        # a task has one core; the library's threads would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.special, self.width, classes = tables or _id_tables(self.library)
        self.splitter = Splitter([content for content, _ in self.special], classes)
        # first bytes of characters among which there is no white space
        self.visible = np.ones(256, bool)
        self.visible[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
        self.remember, self.known = remember, None
        if known is not None:
            self.known, self.pool, self.spans = known

    def _pretoken_ids(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pretokens one after another, and where each one's start.

        Visible pretokens with a blank in front stay apart when they stand side by side, so many
        share one string; the ids are dealt out by the bytes they stand for.
        """
        data, ends = flat_bytes(values)
        size = np.diff(ends)
        blank = np.zeros(len(values), bool)
        blank[size > 1] = data[ends[:-1][size > 1]] == 0x20
        second = np.where(size > 1, data[np.minimum(ends[:-1] + 1, len(data) - 1)], 0x20)
        joint = blank & self.visible[second]  # what follows the blank is surely visible
        rows = [np.flatnonzero(joint), np.flatnonzero(~joint)]
        groups = []
        for at in range(0, len(rows[0]), self.GROUP):
            part = rows[0][at : at + self.GROUP]
            groups.append(data[ragged(ends[part], size[part])].tobytes().decode())
        raw = data.tobytes()
        groups += [raw[ends[i] : ends[i + 1]].decode() for i in rows[1]]
        found = [e.ids for e in self.library.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate([np.array(f, np.uint32) for f in found]) if found else np.zeros(0, np.uint32)
        # both in the order of the rows that were sent
        order = np.concatenate(rows)
        until = np.cumsum(size[order])
        behind = np.searchsorted(np.cumsum(self.width[ids]), until, side="right")
        lengths = np.diff(behind, prepend=0)
        start = np.empty(len(values), np.int64)
        length = np.empty(len(values), np.int64)
        start[order], length[order] = behind - lengths, lengths
        return ids, np.stack([start, length])

    def _known_ids(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_pretoken_ids``, for values of which some may have been met before."""
        if not self.remember:
            return self._pretoken_ids(values)
        if self.known is None:
            self.known, self.pool, self.spans = values, *self._pretoken_ids(values)
            return self.pool, self.spans
        place = pc.index_in(values, value_set=self.known)
        fresh = _flags(place.is_null())
        place = _longs(pc.fill_null(place, 0))
        if fresh.any():
            new = values.filter(pa.array(fresh))
            pool, spans = self._pretoken_ids(new)
            spans[0] += len(self.pool)
            place[fresh] = len(self.known) + np.arange(len(new))
            self.pool, self.spans = np.concatenate([self.pool, pool]), np.concatenate([self.spans, spans], axis=1)
            self.known = pa.concat_arrays([self.known, new])
        return self.pool, self.spans[:, place]

    def common_pretokens(self, texts: pa.Array, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The commonest pretokens of the texts, at most ``most``, with their ids: what other encoders
        may know from the start. It saves time and changes no id."""
        found = self.splitter.split(self.splitter.cut_special(texts)[0])
        times = np.repeat(np.bincount(found.numbers, minlength=len(found.part_counts)), found.part_counts)
        count = np.bincount(found.parts, times, minlength=len(found.values))
        kept = np.argsort(-count, kind="stable")[:most]
        values = found.values.take(pa.array(np.sort(kept[count[kept] > 0])))
        if not len(values):
            return values, np.zeros(0, np.uint32), np.zeros((2, 0), np.int64)
        return values, *self._pretoken_ids(values)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each text."""
        pieces, per = self.splitter.cut_special(texts)
        found = self.splitter.split(pieces)
        if len(found.values):
            pool, (start, length) = self._known_ids(found.values)
        else:
            pool, start, length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the ids of each unit in a row, then those of each text
        pool = gather(pool, start[found.parts], length[found.parts])
        unit = np.concatenate([[0], np.cumsum(length[found.parts])])
        ends = np.cumsum(found.part_counts)
        begin, stop = unit[ends - found.part_counts], unit[ends]
        ids = gather(pool, begin[found.numbers], (stop - begin)[found.numbers])
        counts = found.per_text(length)
        if len(pieces) > len(texts):
            behind = np.cumsum(counts)
            last = np.cumsum(per) - 1
            cut = np.ones(len(pieces), bool)
            cut[last] = False
            ids = np.insert(ids, behind[cut], self.special[0][1])
            counts = counts + cut
            counts = np.bincount(np.repeat(np.arange(len(texts)), per), counts, minlength=len(texts)).astype(np.int64)
        return ids, counts
