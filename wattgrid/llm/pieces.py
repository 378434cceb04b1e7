"""SentencePiece encoding with seeded merge dropout, and decoding.

A merge-type (BPE) model joins neighbouring symbols, best score first. With dropout, a candidate
merge is skipped if a hash keyed by seed, document, occurrence, unit, place and piece falls below the rate, so
the same text has many segmentations, each repeatable and each decoding to the text again. A unit is a run of
spaces with what follows up to the next space; no piece reaches over its edge. Each occurrence of a
unit makes its own draws and is segmented on its own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import give_back, quoted, text_batches, text_of, without

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units of up to so many characters are solved together in grids of these widths, longer ones each by a heap.
WIDTHS = (6, 10, 16, 32)
ROWS_AT_ONCE = 16_384
#: Bytes of texts whose units are gone through at once, and texts that are decoded at once.
BYTES_AT_ONCE = 1_000_000
TEXTS_AT_ONCE = 500
NONE = -(1 << 31)
MASK = (1 << 64) - 1


@dataclass
class Vocabulary:
    """The pieces of a merge-type model, spaces written as spaces."""

    text: list[bytes]  # what each id decodes to
    of: dict[str, int]  # mergeable pieces
    byte: list[int]  # ids of single bytes, -1 where the model has none
    unknown: int
    pairs: np.ndarray  # sorted left * size + right
    joined: np.ndarray  # the piece of each pair
    worth: np.ndarray  # pieces by score: larger is better, equal scores are equal
    _characters: np.ndarray | None = None
    _tables: list | None = None

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        byte, of, text = [-1] * 256, {}, []
        for i, name in enumerate(names):
            if model.is_byte(i):
                byte[int(name[3:5], 16)] = i
                text.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                text.append(b"")
            else:
                plain = name.replace(SPACE, " ")
                if re.search(r"[^ ] |\n", plain):
                    raise ValueError(f"piece {i} reaches over the edge of a unit")
                of[plain] = i
                text.append(plain.encode())
        pairs = sorted((of[p[:k]] * size + of[p[k:]], i) for p, i in of.items() for k in range(1, len(p)) if p[:k] in of and p[k:] in of)
        return cls(text, of, byte, model.unk_id(), np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64),
                   np.unique([model.get_score(i) for i in range(size)], return_inverse=True)[1].astype(np.int32))

    def characters(self) -> np.ndarray:
        """The piece of each single code point, or -1."""
        if self._characters is None:
            self._characters = np.full(0x110000, -1, np.int32)
            for piece, i in self.of.items():
                if len(piece) == 1:
                    self._characters[ord(piece)] = i
        return self._characters

    def spelled(self, char: str) -> list[int]:
        """A character that is no piece, byte by byte."""
        return [self.byte[b] if self.byte[b] >= 0 else self.unknown for b in char.encode("utf-8", "surrogatepass")]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_keys(codes: np.ndarray, heads: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A key for each unit; its code points lie from ``heads`` on, one unit after another."""
    start = np.arange(len(codes), dtype=np.uint64) - np.repeat(heads, lengths).astype(np.uint64)
    return np.add.reduceat(mixed(codes.astype(np.uint64) + (start << np.uint64(32))), heads) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & MASK)


def drawn_keys(keys: np.ndarray, ways: np.ndarray) -> np.ndarray:
    return mixed(keys ^ mixed(ways.astype(np.uint64) + np.uint64(1)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def skips(keys: np.ndarray, left: np.ndarray, right: np.ndarray, pieces: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidates (start of the left symbol, of the right symbol, piece) are skipped."""
    if rate <= 0:
        return np.zeros(len(keys), bool)
    place = (left.astype(np.uint64) << np.uint64(40)) ^ (right.astype(np.uint64) << np.uint64(20)) ^ pieces.astype(np.uint64)
    return (mixed(mixed(keys ^ place) + place) >> np.uint64(11)).astype(np.float64) < rate * 2.0 ** 53


SLOT_BITS = 20
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def slots(want: np.ndarray, factor: int) -> np.ndarray:
    return ((want.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def slot_tables(v: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs in tables by hash, each with those that the tables before had no place for, and the piece that they make."""
    out, left = [], np.arange(len(v.pairs))
    for factor in FACTORS:
        place = np.full(1 << SLOT_BITS, -1, np.int64)
        at = slots(v.pairs[left], factor)
        place[at] = left
        out.append((np.where(place >= 0, v.pairs[place], -1), np.where(place >= 0, v.joined[place], -1).astype(np.int32)))
        left = left[place[at] != left]
    if len(left):
        raise ValueError("the tables have no place for some pairs")
    return out


def candidates(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The piece that two symbols make, or -1."""
    if v._tables is None:
        v._tables = slot_tables(v)
    out = np.full(len(left), -1, np.int32)
    want = left.astype(np.int64) * len(v.text) + right
    look = np.flatnonzero((left >= 0) & (right >= 0))
    for (pairs, joined), factor in zip(v._tables, FACTORS):
        at = slots(want[look], factor)
        there = pairs[at]
        same = there == want[look]
        out[look[same]] = joined[at[same]]
        look = look[~same & (there >= 0)]  # an empty slot has turned no pair away
        if not len(look):
            break
    return out


def segment_one(v: Vocabulary, unit: str, key: np.uint64, rate: float) -> list[int]:
    """One unit by an agenda: the best candidate first, the leftmost of equals; skipped ones are not taken up again."""
    n = len(unit)
    symbol = [v.of.get(c, -1) for c in unit]
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    agenda: list[tuple[int, int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i < 0 or j >= n:
            return
        piece = int(candidates(v, np.array([symbol[i]]), np.array([symbol[j]]))[0])
        if piece >= 0 and not skips(np.array([key], np.uint64), np.array([i]), np.array([j]), np.array([piece]), rate)[0]:
            heapq.heappush(agenda, (-int(v.worth[piece]), i, j, symbol[i], symbol[j], piece))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, j, a, b, piece = heapq.heappop(agenda)
        if not (alive[i] and alive[j]) or after[i] != j or symbol[i] != a or symbol[j] != b:
            continue
        symbol[i], alive[j], after[i] = piece, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    out: list[int] = []
    for i in range(n):
        if alive[i]:
            out += [symbol[i]] if symbol[i] >= 0 else v.spelled(unit[i])
    return out


def segment_grid(v: Vocabulary, codes: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Many units as rows of a grid: in each round, every row that has a candidate left makes its best merge.

    ``codes``: rows x width code points. A symbol stands at the place of its first character;
    ``after`` and ``before`` link the places in use. Returns the grid of symbols and which are in use.
    """
    rows, width = codes.shape
    inside = np.arange(width) < lengths[:, None]
    symbol = np.where(inside, v.characters()[codes], -1).astype(np.int32)
    after = np.tile(np.arange(1, width + 1, dtype=np.int16), (rows, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int16), (rows, 1))  # one column more than places
    made = np.full((rows, width), -1, np.int32)
    worth = np.full((rows, width), NONE, np.int32)

    def offer(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Rate the candidates of the symbols at ``i`` and ``j``."""
        good = (i >= 0) & (j < width)
        r, i, j = r[good], i[good], j[good]
        piece = candidates(v, symbol[r, i], symbol[r, j])
        some = np.flatnonzero(piece >= 0)
        some = some[~skips(keys[r[some]], i[some], j[some], piece[some], rate)]
        r, i, piece = r[some], i[some], piece[some]
        made[r, i] = piece
        worth[r, i] = v.worth[piece]

    if width > 1:
        r, i = np.nonzero(inside[:, 1:])
        offer(r, i, i + 1)
    active = np.arange(rows)
    while len(active):
        at = worth[active].argmax(1)  # the leftmost of equals
        open_ = worth[active, at] > NONE
        active, at = active[open_], at[open_]
        right = after[active, at].astype(np.int64)
        follow = after[active, right].astype(np.int64)
        symbol[active, at] = made[active, at]
        after[active, at] = follow
        before[active, follow] = at
        inside[active, right] = False
        worth[active, right] = NONE
        worth[active, at] = NONE
        offer(active, at, follow)
        previous = before[active, at].astype(np.int64)
        back = previous >= 0
        worth[active[back], previous[back]] = NONE
        offer(active[back], previous[back], at[back])
    return symbol, inside


def written(v: Vocabulary, symbol: np.ndarray, used: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the symbols in use, row by row, and their number in each row; a character that is no piece goes byte by byte."""
    ids = symbol[used]
    bare = ids < 0
    if not bare.any():
        return ids, used.sum(1)
    chars, which = np.unique(codes[used][bare], return_inverse=True)
    spelled = [v.spelled(chr(c)) for c in chars]
    sizes = np.array([len(x) for x in spelled])
    each = np.ones(len(ids), np.int64)
    each[bare] = sizes[which]
    ends = np.cumsum(each)
    out = np.repeat(ids, each)
    within = np.arange(sizes[which].sum()) - np.repeat(np.cumsum(sizes[which]) - sizes[which], sizes[which])
    out[np.repeat(ends[bare] - each[bare], sizes[which]) + within] = np.concatenate(spelled)[np.repeat((np.cumsum(sizes) - sizes)[which], sizes[which]) + within]
    return out, np.bincount(np.nonzero(used)[0], each, len(used)).astype(np.int64)


def segment(v: Vocabulary, codes: np.ndarray, heads: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units (code points from ``heads`` on), one after another, and the number of ids of each."""
    counts = np.zeros(len(heads), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units, their counts of ids, the ids
    alone: dict[int, list[int]] = {}
    low = 0
    for width in WIDTHS:
        group = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        for k in range(0, len(group), ROWS_AT_ONCE):
            rows = group[k:k + ROWS_AT_ONCE]
            place = heads[rows, None] + np.minimum(np.arange(width), lengths[rows, None] - 1)
            symbol, used = segment_grid(v, codes[place], lengths[rows], keys[rows], rate)
            ids, counts[rows] = written(v, symbol, used, codes[place])
            found.append((rows, counts[rows], ids))
    for u in np.flatnonzero(lengths > WIDTHS[-1]):
        unit = codes[heads[u]:heads[u] + lengths[u]].tobytes().decode("utf-32-le", "surrogatepass")
        alone[int(u)] = segment_one(v, unit, keys[u], rate)
    for u, ids in alone.items():
        counts[u] = len(ids)
    begins = np.cumsum(counts) - counts
    out = np.empty(counts.sum(), np.int32)
    for rows, n, ids in found:
        out[np.repeat(begins[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    for u, ids in alone.items():
        out[begins[u]:begins[u] + len(ids)] = ids
    return out, counts


class Encoder:
    """Encodes texts some at a time. Each occurrence of a unit has its own draws, or one of ``variants`` if that is a number; at rate 0 units are segmented once."""

    def __init__(self, v: Vocabulary, rate: float, seed: int, variants: int | None = None) -> None:
        self.v, self.rate, self.seed, self.variants = v, rate, seed, variants

    def encode(self, texts: Iterable[str], documents: Iterable[int]) -> Iterator[pa.ListArray]:
        """Ids of the texts in order, some texts at a time; an empty text has none."""
        waiting: list[bytes] = []
        keys: list[int] = []
        size = 0
        for text, document in zip(texts, documents):
            waiting.append(b" " + text.encode("utf-8", "replace") if text else b"")
            keys.append(document & MASK)
            size += len(waiting[-1])
            if size >= BYTES_AT_ONCE:
                yield self.together(waiting, np.array(keys, np.uint64))
                waiting, keys, size = [], [], 0
        if waiting:
            yield self.together(waiting, np.array(keys, np.uint64))

    def encode_all(self, texts: pa.Array, documents: pa.Array) -> pa.Array:
        """Ids of the texts as one array."""
        parts = list(self.encode((t.as_py() for t in texts), (d.as_py() for d in documents)))
        out = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
        del parts
        give_back()
        return out

    def together(self, texts: list[bytes], documents: np.ndarray) -> pa.ListArray:
        data = b"".join(texts)
        if not data:
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        b = np.frombuffer(data, np.uint8)
        blank, line = b == 32, b == 10
        first = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
        opens = np.zeros(len(b) + 1, bool)
        opens[1:-1] = blank[1:] & ~blank[:-1] | line[1:] | line[:-1]
        opens[first] = True
        starts = np.flatnonzero(opens[:-1])
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(b)].astype(np.int32)), pa.py_buffer(data))
        coded = units.dictionary_encode()
        ends = np.r_[np.searchsorted(starts, first), len(starts)]
        number = np.diff(ends)
        within = np.arange(len(starts), dtype=np.uint64) - np.repeat(ends[:-1], number).astype(np.uint64)
        base = documents ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & MASK)
        ways = mixed(np.repeat(base, number) + within * np.uint64(0xD1B54A32D192ED03))
        if self.variants is not None:
            ways %= np.uint64(self.variants)
        which = coded.indices.to_numpy().astype(np.int64)

        _, offsets, letters = coded.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int32)[:len(coded.dictionary) + 1].astype(np.int64)
        letters = letters.to_pybytes()[:offsets[-1]]
        codes = code_points(letters.decode("utf-8"))
        before = np.r_[0, np.cumsum((np.frombuffer(letters, np.uint8) & 0xC0) != 0x80)]
        heads, lengths = before[offsets[:-1]], np.diff(before[offsets])
        keys, unit = unit_keys(codes, heads, lengths, self.seed), np.arange(len(heads))
        if self.rate > 0:
            keys, unit, which = drawn_keys(keys[which], ways), which, np.arange(len(which))
        values, counts = segment(self.v, codes, heads[unit], lengths[unit], keys, self.rate)

        each = counts[which]
        upto = np.r_[0, np.cumsum(each)]
        place = np.repeat((np.cumsum(counts) - counts)[which] - upto[:-1], each) + np.arange(upto[-1])
        return pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(values[place]))


def decoded(v: Vocabulary, ids: pa.ListArray) -> list[str]:
    """The text of each list of ids. Bytes that are no UTF-8 become replacement characters."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() >= len(v.text)):
        raise ValueError("an id that the vocabulary does not have")
    lengths = np.array([len(t) for t in v.text])
    begins = np.cumsum(lengths) - lengths
    each = lengths[flat]
    ends = np.r_[0, np.cumsum(each)]
    data = np.frombuffer(b"".join(v.text), np.uint8)[np.repeat(begins[flat] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
    counts = np.diff(ids.offsets.to_numpy() - ids.offsets[0].as_py())
    places = ends[np.r_[0, np.cumsum(counts)]]
    out = []
    for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
        out.append(data[a + (data[a:a + 1] == b" " and b > a):b].decode("utf-8", "replace"))
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary, rate: float = 0.1, seed: int = 1, variants: int | None = None, text: str = "text", doc_id: str = "doc_id", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in ``out``; other columns are kept, a former ``out`` is replaced.

    Null and empty texts have no ids. Rows alike in id and text get the same ids, in any run and
    partitioning; rate 0 gives the model's own segmentation. No shuffle.
    """
    text_batches(docs)

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return Encoder(vocabulary, rate, seed, variants).encode_all(texts, keys)

    return without(docs, out).withColumn(out, ids_of(text_of(text), F.xxhash64(quoted(doc_id))))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of an array of ids. Null gives null; an id that the model lacks is an error."""
    @F.arrow_udf("string")
    def text_of_ids(values: pa.Array) -> pa.Array:
        out: list[str] = []
        for k in range(0, len(values), TEXTS_AT_ONCE):
            out += decoded(vocabulary, values.slice(k, TEXTS_AT_ONCE).fill_null([]))
        return pa.array(out, pa.string())

    return F.when(ids.isNotNull(), text_of_ids(ids))
