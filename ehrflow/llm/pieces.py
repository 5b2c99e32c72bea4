"""SentencePiece encoding that keeps offsets, and decoding (BPE models).

A text is normalised as the model's file says: at each place the longest
prefix that the compiled character map knows is replaced (one byte is, by
U+FFFD, where the text is no UTF-8), white space is trimmed if the model asks
for it, a space is put before the text and spaces are written as U+2581. Every
byte of the normalised text keeps the place in the source it came from, so the
bounds of a piece there are bounds in the original bytes. Pieces never reach
over a word's first U+2581 unless the vocabulary has such pieces, so the
distinct words of a chunk are merged once each, side by side and best score
first, and the chunk's ids are gathered from them.

Span rules: a piece covers the source bytes from where its first normalised
byte came from to where the byte after it came from. Of one source character
that gave several pieces, all but the last are empty; so are the byte pieces
of a character that is not in the vocabulary, but for the last.

Defined results: a null text is empty; an empty text has the end id alone,
with the span (0, 0), and decodes to the empty text; repeated rows and null
ids of documents are encoded each; null ids decode to null; an empty table
gives no rows. Models of another kind than BPE, and those with pieces given by
the user or out of use, are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ehrflow.llm import _text

SPACE = "▁".encode()
BAD = "�".encode()
ROWS = (1, 4, 6, 8, 10, 12, 16, 24, 40)    # words of up to so many characters are merged side by side; longer ones by themselves
ROWS_AT_ONCE = 1 << 14
SYMBOLS = 1 << 31
NEVER = np.iinfo(np.int32).max
KNOWN_WORDS, KNOWN_BYTES = 1 << 18, 64    # a task remembers so many words of up to so many bytes
CHUNK_BYTES = 1 << 20               # of texts that are encoded together
CHUNK_IDS = 1 << 18                 # that are decoded together
# kinds of pieces in the model file (fixed values)
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    costs: dict[str, float]         # of the pieces that text is merged to: less is merged earlier
    ids: dict[str, int]
    surface: list[bytes]            # what an id is decoded to
    kind: np.ndarray
    bytes_of: list[int] | None      # the ids of single bytes, if the model falls back to them
    unknown: int
    end: int
    dummy_prefix: bool
    trims: bool
    escapes: bool
    suffix: bool                    # spaces end words
    by_word: bool                   # no piece reaches over the start of a word
    units: np.ndarray               # the character map: a double array, and what its values point to
    rules: bytes
    _begins: np.ndarray | None = field(default=None, repr=False)
    _merges: Merges | None = field(default=None, repr=False)
    _known: tuple | None = field(default=None, repr=False)


def load(path: str) -> Model:
    """The model in a file, read on the driver."""
    with open(path, "rb") as f:
        return parsed(f.read())


def parsed(content: bytes) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(content)
    trainer, norm, pieces = proto.trainer_spec, proto.normalizer_spec, proto.pieces
    if trainer.model_type != trainer.BPE or any(p.type in (_USER, _UNUSED) for p in pieces):
        raise ValueError("only BPE models without user-defined or unused pieces can be used")
    texts = {p.piece: i for i, p in enumerate(pieces) if p.type == _NORMAL}
    space = SPACE.decode()
    single = {int(p.piece[1:-1], 16): i for i, p in enumerate(pieces) if p.type == _BYTE}
    surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else trainer.unk_surface.encode() if p.type == _UNKNOWN
               else p.piece.replace(space, " ").encode() for p in pieces]
    named = {p.piece: i for i, p in enumerate(pieces)}
    blob = norm.precompiled_charsmap
    cut = struct.unpack_from("<I", blob)[0] + 4 if blob else 0
    suffix = trainer.treat_whitespace_as_suffix
    return Model(
        costs={p: -pieces[i].score for p, i in texts.items()}, ids=texts, surface=surface, kind=np.array([p.type for p in pieces], np.int8),
        bytes_of=[single[b] for b in range(256)] if trainer.byte_fallback else None, unknown=next(i for i, p in enumerate(pieces) if p.type == _UNKNOWN),
        end=named[trainer.eos_piece], dummy_prefix=norm.add_dummy_prefix, trims=norm.remove_extra_whitespaces, escapes=norm.escape_whitespaces,
        suffix=suffix, by_word=norm.escape_whitespaces and not suffix and not any(space in p.lstrip(space) for p in texts),
        units=np.frombuffer(blob[4:cut], "<u4").astype(np.int64) if blob else np.zeros(0, np.int64), rules=blob[cut:])


# ---- normalisation ----

def _step(units: list[int] | np.ndarray, node: int, byte: int) -> tuple[int, int]:
    """From a node over one byte: the next node (-1: none), and the value of
    the key that ends there (-1: none does)."""
    at = node ^ byte
    unit = int(units[at]) if at < len(units) else -1
    if unit < 0 or unit & 0x800000FF != byte:
        return -1, -1
    after = at ^ (unit >> 10 << ((unit & 0x200) >> 6))
    return after, int(units[after]) & 0x7FFFFFFF if unit >> 8 & 1 else -1


def _root(units: np.ndarray) -> int:
    unit = int(units[0])
    return unit >> 10 << ((unit & 0x200) >> 6)


def _rule_begins(model: Model) -> np.ndarray:
    """Which two bytes a key of the character map can begin with (a key of
    one byte: with any second one)."""
    if model._begins is None:
        begins = np.zeros((256, 256), bool)
        for a in range(256):
            node, value = _step(model.units, _root(model.units), a)
            if node >= 0:
                begins[a] = value >= 0 or [_step(model.units, node, b)[0] >= 0 for b in range(256)]
        model._begins = begins.ravel()
    return model._begins


def _longest(data: bytes, at: int, end: int, model: Model) -> tuple[int, bytes]:
    """The longest key of the character map that the bytes begin with: its
    length (0: none) and what replaces it."""
    node, length, found = _root(model.units), 0, -1
    for i in range(at, end):
        node, value = _step(model.units, node, data[i])
        if node < 0:
            break
        if value >= 0:
            length, found = i - at + 1, value
    return length, model.rules[found:model.rules.index(b"\0", found)] if length else b""


def _replaced(data: np.ndarray, offsets: np.ndarray, model: Model) -> list[tuple[int, int, bytes]]:
    """Places, lengths and replacements, in order and without overlap."""
    raw, out = data.tobytes(), []
    if len(model.units):
        pair = data.astype(np.int64) << 8
        pair[:-1] |= data[1:]
        ends = offsets[1:][offsets[1:] > offsets[:-1]]
        pair[ends - 1] &= 0xFF00
        places = np.flatnonzero(_rule_begins(model)[pair])
        stops = offsets[np.searchsorted(offsets, places, "right")]
        done = 0
        for at, end in zip(places.tolist(), stops.tolist()):
            if at >= done:
                length, text = _longest(raw, at, end, model)
                if length:
                    out.append((at, length, text))
                    done = at + length
    for a, b in _malformed(raw, offsets):
        at = a
        for c in raw[a:b].decode("utf-8", "surrogateescape"):
            if "\udc80" <= c <= "\udcff":
                out.append((at, 1, BAD))
                at += 1
            else:
                at += len(c.encode())
    return sorted(out)


def _malformed(raw: bytes, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """The texts that are no UTF-8."""
    def valid(part: bytes) -> bool:
        try:
            part.decode()
            return True
        except UnicodeDecodeError:
            return False

    if not valid(raw) or (np.frombuffer(raw, np.uint8)[offsets[:-1][offsets[:-1] < len(raw)]] & 0xC0 == 0x80).any():
        bounds = offsets.tolist()
        yield from ((a, b) for a, b in zip(bounds, bounds[1:]) if not valid(raw[a:b]))


def normalised(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes of all texts, each text's offsets there, and the
    place in ``data`` of each byte, with one place more at every text's end."""
    n = len(data)
    length, first, lead = np.ones(n, np.int64), np.ones(n, bool), data == 0x20
    replaced = _replaced(data, offsets, model)
    for at, taken, text in replaced:
        length[at:at + taken] = 0
        length[at] = len(text)
        first[at + 1:at + taken] = False
        lead[at] = text == b" "
    begin = np.concatenate(([0], np.cumsum(length)))
    came = np.repeat(np.arange(n), length)
    stream = data[came]
    for at, _, text in replaced:
        stream[begin[at]:begin[at] + len(text)] = np.frombuffer(text, np.uint8)
    bounds, ends = begin[offsets], offsets[1:].copy()
    leading, some = offsets[:-1], offsets[1:] > offsets[:-1]
    if model.trims:
        solid = np.append(np.flatnonzero(first & ~lead), n)
        leading = np.minimum(solid[np.searchsorted(solid, offsets[:-1])], offsets[1:])
        some = leading < offsets[1:]
        unit = begin[came]                                                            # where the byte's unit begins
        inner = np.zeros(len(stream), bool)                                           # not in the unit's leading spaces
        for at, _, text in replaced:
            inner[begin[at] + len(text) - len(text.lstrip(b" ")):begin[at] + len(text)] = True
        start = np.zeros(len(stream) + 1, bool)
        start[bounds] = True
        spaced = start[unit] | (stream[np.maximum(unit - 1, 0)] == 0x20)
        keep = ~((stream == 0x20) & ~inner & spaced)
        kept = np.concatenate(([0], np.cumsum(keep)))
        stream, came, bounds, ends = _trimmed(stream[keep], kept[bounds], came[keep], ends, model)
        if not model.suffix:                                                          # the space before a text that is all spaces goes, too
            ends, some = np.where(some & (bounds[1:] == bounds[:-1]), leading, ends), some & (bounds[1:] > bounds[:-1])
    if model.dummy_prefix:
        at = (bounds[1:] if model.suffix else bounds[:-1])[some]
        stream, came = np.insert(stream, at, 0x20), np.insert(came, at, (ends if model.suffix else leading)[some])
        bounds = bounds + np.concatenate(([0], np.cumsum(some)))
    wide = np.where(stream == 0x20, len(SPACE), 1) if model.escapes else np.ones(len(stream), np.int64)
    to = np.concatenate(([0], np.cumsum(wide)))
    out, came, spaces = np.repeat(stream, wide), np.repeat(came, wide), to[:-1][stream == 0x20]
    if model.escapes:
        for k, byte in enumerate(SPACE):
            out[spaces + k] = byte
    bounds = to[bounds]
    return out, bounds, np.insert(came, bounds[1:], ends)


def _trimmed(stream: np.ndarray, bounds: np.ndarray, came: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Without the spaces at the ends of the texts, written ones included."""
    raw, keep, ends = stream.tobytes(), np.ones(len(stream), bool), ends.copy()
    spaces = (b" ", SPACE) if model.escapes else (b" ",)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        c = b
        while (size := next((len(x) for x in spaces if raw.endswith(x, a, c)), 0)):
            c -= size
        if c < b:
            keep[c:b] = False
            ends[k] = came[c]
    return stream[keep], came[keep], np.concatenate(([0], np.cumsum(keep)))[bounds], ends


# ---- merging ----

def merged(text: str, costs: dict[str, float]) -> list[str]:
    """Neighbours are put together while their union is a piece, the best of
    all such pairs first, the leftmost of equals."""
    parts, n = list(text), len(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(costs[p], i, 2) for i in range(n - 1) if (p := text[i:i + 2]) in costs]
    heapify(heap)
    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue                                    # one of the two has been put to another since
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                union = parts[a] + parts[b]
                if union in costs:
                    heappush(heap, (costs[union], a, len(union)))
    return [p for p in parts if p]


class Merges:
    """A model's pairs as sorted arrays. A symbol is the id of a piece, or
    for a character that is none the number of ids plus its code point."""

    def __init__(self, model: Model):
        self.ids, self.vocabulary = model.ids, len(model.surface)
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.vocabulary
        for piece, i in model.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.order = np.full(self.vocabulary + 1, NEVER, np.int32)                  # equal costs have equal places; the last entry: no piece
        self.order[list(model.ids.values())] = np.unique([model.costs[p] for p in model.ids], return_inverse=True)[1]
        pairs = {}
        for piece, i in model.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.of(piece[:cut]), self.of(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * SYMBOLS + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.unions = np.array([pairs[k] for k in self.keys.tolist()] + [self.vocabulary], np.int64)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)

    def of(self, part: str) -> int | None:
        return int(self.symbol[ord(part)]) if len(part) == 1 else self.ids.get(part)

    def union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What two symbols make (the number of ids: nothing)."""
        key = np.where((left >= 0) & (right >= 0), left * SYMBOLS + right, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.unions[at], self.vocabulary)

    def rows(self, symbols: np.ndarray, widths: np.ndarray) -> None:
        """Merge each row's symbols (-1: none, at the end of a row) in place;
        widths are added up."""
        full, full_widths, todo = symbols, widths, np.arange(len(symbols))
        union = self.union(symbols[:, :-1], symbols[:, 1:])
        cost, cols = self.order[union], np.arange(symbols.shape[1])
        while True:
            at = cost.argmin(1)
            go = np.flatnonzero(cost[np.arange(len(cost)), at] < NEVER)
            if len(go) < len(cost):                                                  # rows that are done leave
                full[todo], full_widths[todo] = symbols, widths
                if not len(go):
                    return
                symbols, widths, union, cost, todo, at = symbols[go], widths[go], union[go], cost[go], todo[go], at[go]
            row = np.arange(len(symbols))
            symbols[row, at] = union[row, at]
            widths[row, at] += widths[row, at + 1]
            source = np.minimum(cols + (cols > at[:, None]), len(cols) - 1)
            symbols, widths = np.take_along_axis(symbols, source, 1), np.take_along_axis(widths, source, 1)
            symbols[:, -1], widths[:, -1] = -1, 0
            source = source[:, :-1] - (source[:, :-1] == len(cols) - 1)
            source[:, 1:] = np.where(cols[1:-1] > at[:, None], np.minimum(cols[1:-1] + 1, len(cols) - 2), cols[1:-1])
            union = np.take_along_axis(union, source, 1)
            union[:, -1] = self.vocabulary
            union[row, at] = self.union(symbols[row, at], symbols[row, np.minimum(at + 1, len(cols) - 1)])
            left = np.maximum(at - 1, 0)
            union[row, left] = np.where(at > 0, self.union(symbols[row, left], symbols[row, at]), union[row, left])
            cost = self.order[union]


def _words(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    """For normalised words: how many ids each has; all ids, and their bounds
    in their word."""
    if model._merges is None:
        model._merges = Merges(model)
    merges, raw = model._merges, data.tobytes()
    place = np.flatnonzero(data & 0xC0 != 0x80)
    chars = merges.symbol[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)]
    wide = np.diff(np.append(place, len(data)))
    first = np.searchsorted(place, offsets)
    length = np.diff(first)
    count, found = length.copy(), []                                                 # found: words, rows of symbols, rows of widths
    low = 0
    for high in ROWS:
        of = np.flatnonzero((length > low) & (length <= high))
        low = high
        for some in np.array_split(of, -(-len(of) // ROWS_AT_ONCE)) if len(of) else ():
            inside = np.arange(high) < length[some][:, None]
            at = np.minimum(first[some][:, None] + np.arange(high), len(chars) - 1)
            symbols, widths = np.where(inside, chars[at], -1), np.where(inside, wide[at], 0)
            if high > 1:
                merges.rows(symbols, widths)
            count[some] = (symbols >= 0).sum(1)
            found.append((some, symbols[symbols >= 0], widths[symbols >= 0]))
    for word in np.flatnonzero(length > low).tolist():
        parts = merged(raw[offsets[word]:offsets[word + 1]].decode(), model.costs)
        count[word] = len(parts)
        found.append((np.array([word]), np.array([merges.of(p) for p in parts]), np.array([len(p.encode()) for p in parts])))
    start = np.cumsum(count) - count
    symbols, widths = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
    for of, s, w in found:
        to = _ragged(start[of], count[of])
        symbols[to], widths[to] = s, w
    word = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(widths) - widths - offsets[word]
    stop = begin + widths
    absent = symbols >= merges.vocabulary
    if model.bytes_of is None:
        return count, [np.where(absent, model.unknown, symbols), begin, stop]
    again = np.where(absent, widths, 1)
    if absent.any():
        nth = _ragged(np.zeros(len(again), np.int64), again)
        symbols, word, begin, stop, absent, widths = (np.repeat(x, again) for x in (symbols, word, begin, stop, absent, widths))
        at = offsets[word] + begin + nth
        symbols = np.where(absent, np.array(model.bytes_of)[data[np.minimum(at, len(data) - 1)]], symbols)
        stop = np.where(absent & (nth < widths - 1), begin, stop)
        count = np.bincount(word, minlength=len(count))
    return count, [symbols, begin, stop]


def _segmented(words: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For distinct normalised words: where their ids begin in the tables of
    ids and bounds, how many there are, and the tables. The first words a task
    sees are remembered, so frequent ones are merged once."""
    if model._known is None:
        model._known = pa.array([], pa.large_binary()), np.zeros(0, np.int64), [np.zeros(0, np.int32)] * 3
    known, many, tables = model._known
    at = pc.index_in(words, value_set=known)
    absent = at.is_null()
    fresh = words.filter(absent)
    count, own = _words(*_text.flat(fresh), model)
    both = [np.concatenate((t, o.astype(np.int32))) for t, o in zip(tables, own)]
    every = np.concatenate((many, count))
    first = np.cumsum(every) - every
    place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    place[np.asarray(absent)] = len(many) + np.arange(len(fresh))
    if len(known) + len(fresh) <= KNOWN_WORDS:
        short = pc.less_equal(pc.binary_length(fresh), KNOWN_BYTES)
        kept = np.flatnonzero(np.asarray(short))
        held = _ragged((np.cumsum(count) - count)[kept], count[kept])
        model._known = (pa.concat_arrays([known, fresh.filter(short)]), np.concatenate((many, count[kept])),
                        [np.concatenate((t, o[held].astype(np.int32))) for t, o in zip(tables, own)])
    return first[place], every[place], both


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)


def encode_flat(data: np.ndarray, offsets: np.ndarray, model: Model, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts, the span of each in the bytes of its own text, and
    the texts' offsets among them."""
    norm, bounds, came = normalised(data, offsets, model)
    texts = len(offsets) - 1
    opens = np.zeros(len(norm) + 1, bool)
    if model.by_word and len(norm) > 2:
        space = np.flatnonzero((norm[:-2] == SPACE[0]) & (norm[1:-1] == SPACE[1]) & (norm[2:] == SPACE[2]))
        opens[space[:1]] = True
        opens[space[1:]] = np.diff(space) != len(SPACE)                              # the first of several spaces
    opens[bounds[:-1]] = True
    starts = np.flatnonzero(opens[:-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(norm)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(norm))]).dictionary_encode()
    first, count, table = _segmented(words.dictionary, model)
    which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held = _ragged(first[which], count[which])
    ids, at = table[0][held], np.repeat(starts, count[which])
    begin, stop = at + table[1][held], at + table[2][held]
    text = np.searchsorted(bounds, begin, "right") - 1
    if model.bytes_of is None and len(ids):             # neighbours that are not in the vocabulary are one piece
        same = np.zeros(len(ids), bool)
        same[1:] = (ids[1:] == model.unknown) & (ids[:-1] == model.unknown) & (text[1:] == text[:-1])
        last = np.append(np.flatnonzero(~same)[1:], len(ids)) - 1
        ids, begin, stop, text = ids[~same], begin[~same], stop[last], text[~same]
    spans = [came[begin + text] - offsets[text], came[stop + text] - offsets[text]]
    to = np.searchsorted(text, np.arange(texts + 1))
    if end:
        size = offsets[1:] - offsets[:-1]
        ids, spans = np.insert(ids, to[1:], model.end), [np.insert(s, to[1:], size) for s in spans]
        to = to + np.arange(texts + 1)
    return ids.astype(np.int32), spans[0].astype(np.int32), spans[1].astype(np.int32), to


def decode_flat(ids: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The decoded bytes of all lists of ids, and their offsets."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(model.surface):
        raise ValueError("ids outside of the vocabulary")
    size = np.array([len(s) for s in model.surface], np.int64)
    table, first = np.frombuffer(b"".join(model.surface), np.uint8), np.cumsum(size) - size
    ids = ids.astype(np.int64)
    length, begin = size[ids], first[ids]
    if model.dummy_prefix or model.trims:
        kind, bounds = model.kind[ids], offsets.tolist()
        for a, b in zip(bounds, bounds[1:]):
            while a < b and kind[a] == _CONTROL:
                a += 1
            while a < b and kind[a] == _NORMAL and table[begin[a]] == 0x20:           # the space that was put before the text
                begin[a] += 1
                length[a] -= 1
                if not model.trims or length[a]:
                    break
                a += 1
                while a < b and kind[a] == _CONTROL:
                    a += 1
    to = np.concatenate(([0], np.cumsum(length)))[offsets]
    data = table[_ragged(begin, length)]
    single, silent = model.kind[ids] == _BYTE, model.kind[ids] == _CONTROL
    parted = np.flatnonzero(single[:-1] & silent[1:])                                 # single bytes on both sides of a piece without a text are no character
    odd = {int(np.searchsorted(to, a, "right")) - 1 for a, _ in _malformed(data.tobytes(), to)} | set((np.searchsorted(offsets, parted, "right") - 1).tolist())
    if odd:
        raw, bounds, texts = data.tobytes(), offsets.tolist(), []
        for k, (a, b) in enumerate(zip(to.tolist(), to[1:].tolist())):
            if k in odd:
                own = slice(bounds[k], bounds[k + 1])
                texts.append(_runs(table, begin[own].tolist(), length[own].tolist(), single[own].tolist()))
            else:
                texts.append(raw[a:b])
        to = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        data = np.frombuffer(b"".join(texts), np.uint8)
    return data, to


def _runs(table: np.ndarray, begin: list[int], length: list[int], single: list[bool]) -> bytes:
    """One list of ids: single bytes next to each other are read as UTF-8,
    each that is none as U+FFFD."""
    parts, run = [], b""
    for a, n, byte in zip([*begin, 0], [*length, 0], [*single, False]):
        text = table[a:a + n].tobytes()
        if byte:
            run += text
            continue
        if run:
            parts.append("".join("�" if "\udc80" <= c <= "\udcff" else c for c in run.decode("utf-8", "surrogateescape")).encode())
        run = b""
        parts.append(text)
    return b"".join(parts)


# ---- DataFrames ----

def _strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def encoded(docs: DataFrame, model: Model, end: bool = True, decode: bool = False) -> DataFrame:
    """doc_id, ids, and starts and ends: the byte span of every piece in the
    UTF-8 of the document's text. With ``decode`` also ``decoded``, the text
    of the ids, made in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches, limit=CHUNK_BYTES):
            *columns, to = encode_flat(*_text.flat(batch.column("text")), model, end)
            out = [pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(c)) for c in columns]
            if decode:
                out.append(_strings(*decode_flat(columns[0], to, model)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], names=names)

    names = ["doc_id", "ids", "starts", "ends", *(["decoded"] if decode else [])]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, starts array<int>, ends array<int>" + (", decoded string" if decode else ""))


def decoded(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "decoded") + ", decoded string"
    kept = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            length = pc.fill_null(whole.column("ids").value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, at = np.concatenate(([0], np.cumsum(length))), 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK_IDS, "right")) - 1)
                batch = whole.slice(at, to - at)
                lists = batch.column("ids")
                data, ends = decode_flat(lists.flatten().to_numpy(zero_copy_only=False), total[at:to + 1] - total[at], model)
                text = _strings(data, ends, ~np.asarray(lists.is_null()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), text], names=[*kept, "decoded"])
                at = to

    return rows.mapInArrow(run, schema)
