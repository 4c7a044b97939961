"""Texts cut at single blanks, so that what a tokenizer gives for a word is found once and kept.

The usual pre-token pattern never joins characters across a blank that has a non-blank on either side, except that the blank
goes to what follows. So a text is a first field and fields with a leading blank, each tokenized on its own. A text
in which a field is empty or begins or ends with white space is tokenized whole; results are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fields that a Python worker keeps at most, and their longest length; beyond, only those stay that are met again.
KEPT_FIELDS = 300_000
KEPT_LENGTH = 64
#: Characters whose new fields are encoded in one call.
AT_ONCE = 1 << 21
#: Characters whose fields are looked up together, and fields encoded as one text, where ids are arrays.
GROUP = 1 << 23
JOINED = 50


class Units:
    """Encodes texts to bytes by an encode function for a list of strings, which it asks for each new field only."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[str], bool] = lambda text: False, kept: int = KEPT_FIELDS):
        self.encode, self.whole, self.kept = encode, whole, kept
        self.first: dict[str, bytes | None] = {}
        self.rest: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _learn(self, store: dict, fields: set[str], lead: str) -> dict[str, bytes | None]:
        """Puts fields that are not in the store there; gives those that are too long to be kept."""
        new = fields.difference(store)
        if store and len(store) + len(new) > self.kept // 2:
            if store is self.rest:
                self.old = dict(store)  # from which those that are met again come back
            store.clear()
            new = fields
        if store is self.rest and self.old:
            back = {f: self.old[f] for f in new if f in self.old}
            store.update(back)
            new = new.difference(back)
        found: dict[str, bytes | None] = dict.fromkeys(new)
        good = [f for f in new if f and not f[0].isspace() and not f[-1].isspace()]
        found.update(zip(good, self.encode([lead + f for f in good]), strict=True))
        long = {f: found.pop(f) for f in new if len(f) > KEPT_LENGTH}
        store.update(found)
        return long

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        split = [None if not t or self.whole(t) else t.split(" ") for t in texts]
        heads = {f[0] for f in split if f}
        long_heads = self._learn(self.first, heads, "")
        long = self._learn(self.rest, set().union(*[f[1:] for f in split if f]), " ")
        first, rest = self.first, self.rest
        for text, fields in zip(texts, split, strict=True):
            if fields is None:
                yield self.encode([text])[0] if text else b""
                continue
            head = fields[0]
            parts = [first[head] if head in first else long_heads[head]]
            try:
                parts += [rest[f] for f in fields[1:]]
            except KeyError:
                parts += [rest[f] if f in rest else long[f] for f in fields[1:]]
            try:
                yield b"".join(parts)
            except TypeError:  # a field that does not stand alone
                yield self.encode([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        for group in grouped(texts, AT_ONCE):
            yield from self._group(group)


def grouped(texts: Iterable[str], size: int) -> Iterator[list[str]]:
    """The texts in lists of about so many characters."""
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= size:
            yield group
            group, chars = [], 0
    if group:
        yield group


class _Kept:
    """Fields with one lead and their ids, one after the other."""

    def __init__(self):
        self.fields, self.ends, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.met = np.zeros(0, bool)

    def add(self, fields: pa.Array, ends: np.ndarray, ids: np.ndarray) -> None:
        self.fields = pa.concat_arrays([self.fields, fields])
        self.ends = np.concatenate([self.ends, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(ends), bool)])

    def leave(self) -> None:
        """Keeps those only that were met again since the last time."""
        met, n = self.met, np.diff(self.ends, prepend=0)
        self.fields, self.ids, self.ends = self.fields.filter(pa.array(met)), self.ids[np.repeat(met, n)], np.cumsum(n[met])
        self.met = np.zeros(len(self.ends), bool)


class IdUnits:
    """Encodes texts to ids as arrays, by an encode function for a list of strings, which it asks for each new field only.

    A group's fields are found, told apart and put together by Arrow and numpy, with no object for a field. lengths: bytes of each id's
    token. joins: whether fields with their blank may be encoded as one text, which is cut where their bytes end."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], lengths: np.ndarray, joins: bool, whole: Callable[[str], bool] = lambda text: False, kept: int = KEPT_FIELDS):
        self.encode, self.lengths, self.joins, self.whole, self.kept = encode, lengths, joins, whole, kept
        self.stores = {"": _Kept(), " ": _Kept()}

    def _new(self, fields: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The fields' ids, one after the other, and where each ends."""
        if lead and self.joins:
            cuts = pa.array([*range(0, len(fields), JOINED), len(fields)], pa.int32())
            texts = [lead + t for t in pc.binary_join(pa.ListArray.from_arrays(cuts, fields), lead).to_pylist()] if len(fields) else []
        else:
            texts = [lead + f for f in fields.to_pylist()]
        found = self.encode(texts) if texts else []
        ids = np.concatenate([np.zeros(0, "<u4"), *[np.array(x, "<u4") for x in found]])
        if lead and self.joins:
            size = pc.binary_length(fields).to_numpy(zero_copy_only=False).astype(np.int64) + len(lead)
            return ids, np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(size)) + 1
        return ids, np.cumsum([len(x) for x in found], dtype=np.int64)

    def _looked_up(self, fields: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, and of each of the distinct fields where its ids begin and end there, and whether it stands alone."""
        store = self.stores[lead]
        at = pc.index_in(fields, value_set=store.fields).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        store.met[at[at >= 0]] = True
        rest = np.flatnonzero(at < 0)
        new = fields.take(pa.array(rest))
        alone = pc.and_(pc.greater(pc.binary_length(new), 0), pc.equal(pc.utf8_trim_whitespace(new), new))
        rest, new = rest[alone.to_numpy(zero_copy_only=False).astype(bool)], new.filter(alone)
        ids, ends = self._new(new, lead)
        at[rest] = len(store.ends) + np.arange(len(rest))
        every = np.concatenate([store.ends, ends + len(store.ids)])
        begins, both = np.concatenate([[0], every]), np.concatenate([store.ids, ids])
        found = both, np.where(at < 0, 0, begins[at]), np.where(at < 0, 0, begins[at + 1]), at >= 0

        short = pc.less_equal(pc.binary_length(new), KEPT_LENGTH).to_numpy(zero_copy_only=False).astype(bool)
        if len(store.ends) + short.sum() > self.kept:
            store.leave()
        if len(store.ends) + short.sum() <= self.kept:
            n = np.diff(ends, prepend=0)
            store.add(new.filter(pa.array(short, pa.bool_())), np.cumsum(n[short]), ids[np.repeat(short, n)])
        return found

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        apart = [not t or self.whole(t) for t in texts]
        split = pc.split_pattern(pa.array([t for t, a in zip(texts, apart, strict=True) if not a], pa.string()), " ")
        starts, fields = split.offsets.to_numpy(), split.values
        first = np.zeros(len(fields), bool)
        first[starts[:-1]] = True
        ids, begins, n, alone = np.zeros(0, "<u4"), np.zeros(len(fields), np.int64), np.zeros(len(fields), np.int64), np.zeros(len(fields), bool)
        for lead, places in (("", first), (" ", ~first)):
            encoded = fields.filter(pa.array(places, pa.bool_())).dictionary_encode()
            codes = encoded.indices.to_numpy()
            found, begin, end, good = self._looked_up(encoded.dictionary, lead)
            begins[places], n[places], alone[places] = begin[codes] + len(ids), (end - begin)[codes], good[codes]
            ids = np.concatenate([ids, found])
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(begins - ends[:-1], n)
        place += np.arange(len(place))
        ids, bounds = ids[place], ends[starts].tolist()
        before = np.concatenate([[0], np.cumsum(alone)])[starts]
        good, k = (np.diff(before) == np.diff(starts)).tolist(), 0
        for text, a in zip(texts, apart, strict=True):
            if not a and good[k]:
                yield ids[bounds[k] : bounds[k + 1]]
            else:  # a field does not stand alone, or the text is not cut
                yield np.array(self.encode([text])[0] if text else [], "<u4")
            k += not a

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for group in grouped(texts, GROUP):
            yield from self._group(group)
