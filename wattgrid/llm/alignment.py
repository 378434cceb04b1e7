"""Alignment of two tokenizers over the same text.

Both tokenizations of a text are laid over its bytes. Where a token of either ends at the same byte,
the text is cut; what lies between two cuts is a group of ids of each kind. The cuts are the
intersection of two dictionaries from cumulative end to index, held as arrays over the bytes of a few texts; the sorted
common ends slice both lists of ids, and the slices are expanded into links, the pairs of tokens whose bytes overlap.

Counts over the corpus are kept by block of rows: a block's distinct pairs are far fewer than its
links, so only those are shuffled to be counted, and only those come back to the block's rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import quoted, text_batches, text_of
from wattgrid.session import checkpointed

BYTES_PATH = "/opt/tokenizers/byte_bpe_50k.json"
PIECES_PATH = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how byte-level pre-tokenizers cut a text into words.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts, and their characters, worked on at once (a longer text alone), and rows of a block.
PART = 128
PART_LENGTH = 1 << 20
BLOCK_BITS = 12
#: Longer texts go through the other library, whose matching needs no stack for long runs.
LONG = 200_000


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    plain = [b for low, high in ((33, 126), (161, 172), (174, 255)) for b in range(low, high + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level BPE file; texts that hold a special token's string get plain ids."""

    def __init__(self, path: str = BYTES_PATH) -> None:
        with open(path, encoding="utf-8") as file:
            self.spec = file.read()
        found = json.loads(self.spec)
        special = {t["content"] for t in found["added_tokens"]}
        letters = byte_letters()
        self.ranks = {bytes(letters[c] for c in entry): i for entry, i in found["model"]["vocab"].items() if entry not in special}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for entry, i in self.ranks.items():
            self.bytes[i] = entry
        self._quick = self._patient = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_quick": None, "_patient": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._quick is None:
            import tiktoken

            self._quick = tiktoken.Encoding("bytes", pat_str=CUT, mergeable_ranks=self.ranks, special_tokens={})
        return [self._quick.encode_ordinary(t) if len(t) <= LONG else self._slowly(t) for t in texts]

    def _slowly(self, text: str) -> list[int]:
        if self._patient is None:
            from tokenizers import Tokenizer

            self._patient = Tokenizer.from_str(self.spec)
            self._patient.encode_special_tokens = True
        return self._patient.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a SentencePiece model, which adds the space before a text by itself."""

    def __init__(self, path: str = PIECES_PATH) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            self.proto = file.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self._model = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._model is None:
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        return self._model.encode(texts, num_threads=1)


def end_to_index(ends: np.ndarray, size: int) -> np.ndarray:
    """At each byte the index after the token that ends there, 0 where none does."""
    at = np.zeros(size + 1, np.int64)
    at[ends] = np.arange(1, len(ends) + 1)
    return at


def edges(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)].astype(np.int64)


def of_each(text_ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each text."""
    return np.diff(np.r_[0, np.searchsorted(places, text_ends, side="right")].astype(np.int64))


def taken(values: pa.Array, at: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
    """The values at these places, one after the other, and where each begins."""
    found = values.take(pa.array(at))
    _, offsets, data = found.buffers()
    begins = np.frombuffer(offsets, np.int32, len(at) + 1) if len(at) else np.zeros(1, np.int32)
    return begins, data if data is not None else pa.py_buffer(b"")


class Aligner:
    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.spelled = [pa.array(v.bytes, pa.binary()) for v in (a, b)]
        self.sizes = [np.array([len(x) for x in v.bytes]) for v in (a, b)]
        # Ids written out with what follows them: more of their group, the group's other kind, another group, nothing.
        self.ids = max(len(a.bytes), len(b.bytes))
        self.said = pa.array([f"{k}{after}" for after in (",", "|", ";", "") for k in range(self.ids)], pa.string())

    def __reduce__(self):
        return Aligner, (self.a, self.b)

    def align(self, texts: list[str]) -> pa.StructArray:
        """Of each text: tokens of either, groups, links, the groups written out, distinct pairs and how often each is linked.

        The texts are laid one after the other; each ends with a token of either kind, so no group or link crosses its end.
        """
        spaced = [" " + t if t else "" for t in texts]
        plain = [t.encode("utf-8", "surrogatepass") for t in spaced]
        good = np.array([len(p) > 0 for p in plain], bool)
        encoded = []
        for spelled, lists in zip(self.spelled, (self.a.encode(spaced), self.b.encode(texts))):
            n = np.array([len(x) for x in lists], np.int64)
            ids = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(x, np.int64, len(x)) for x in lists]])
            begins, data = taken(spelled, ids)
            at = begins[edges(n)].tolist()
            good &= np.array([data[i:j].to_pybytes() == p for i, j, p in zip(at, at[1:], plain)], bool)
            encoded.append((n, ids))
        (n_a, a), (n_b, b) = ((n * good, ids[np.repeat(good, n)]) for n, ids in encoded)
        text_ends = np.cumsum([len(p) if g else 0 for p, g in zip(plain, good)]).astype(np.int64)
        return self._aligned(n_a, a, n_b, b, text_ends)

    def _aligned(self, n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray, text_ends: np.ndarray) -> pa.StructArray:
        size = int(text_ends[-1]) if len(text_ends) else 0
        at_a, at_b = (end_to_index(np.cumsum(s[ids]), size) for s, ids in zip(self.sizes, (a, b)))
        common = np.flatnonzero((at_a > 0) & (at_b > 0))
        upto_a, upto_b = at_a[common], at_b[common]
        n_groups = of_each(text_ends, common)

        # A slice has a link for each byte where a token of either kind ends: the pair that covers the byte.
        ends = np.flatnonzero((at_a > 0) | (at_b > 0))
        n_links = of_each(text_ends, ends)
        last_a, last_b = at_a[ends] > 0, at_b[ends] > 0
        links = a[np.cumsum(last_a) - last_a] * len(self.b.bytes) + b[np.cumsum(last_b) - last_b]
        span = len(self.a.bytes) * len(self.b.bytes)
        keyed = np.sort(np.repeat(np.arange(len(text_ends)), n_links) * span + links)
        first = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]][:len(keyed)])
        times = np.diff(np.r_[first, len(keyed)]).astype(np.int32)
        of_text, pairs = np.divmod(keyed[first], span)
        starts = pa.array(edges(np.bincount(of_text, minlength=len(text_ends))).astype(np.int32))

        # A group's ids of A stand after all ids of B before the group, its ids of B after all of A up to its end.
        written = np.empty(len(a) + len(b), np.int64)
        said_a, said_b = a.copy(), b.copy()
        said_a[upto_a - 1] += self.ids
        said_b[upto_b - 1] += 2 * self.ids
        said_b[np.cumsum(n_b)[n_b > 0] - 1] += self.ids
        written[np.arange(len(a)) + np.repeat(np.r_[0, upto_b][:-1], np.diff(np.r_[0, upto_a]))] = said_a
        written[np.arange(len(b)) + np.repeat(upto_a, np.diff(np.r_[0, upto_b]))] = said_b
        begins, data = taken(self.said, written)
        groups = pa.StringArray.from_buffers(len(text_ends), pa.py_buffer(begins[edges(n_a + n_b)]), data)

        lists = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in (pairs, times)]
        return pa.StructArray.from_arrays([*map(pa.array, (n_a, n_b, n_groups, n_links)), groups, *lists], NAMES)


def parts_of(texts: list[str]) -> list[list[str]]:
    """The texts in order, a few at a time."""
    parts, length = [[]], 0
    for t in texts:
        if parts[-1] and (len(parts[-1]) == PART or length + len(t) > PART_LENGTH):
            parts.append([])
            length = 0
        parts[-1].append(t)
        length += len(t)
    return parts


NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
FOUND = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,pairs:array<bigint>,times:array<int>>"


def align(docs: DataFrame, a: ByteLevel, b: Pieces, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and, of the whole text: n_a, n_b, n_groups, n_links, ``groups`` written as ``a1,a2|b1;a3|b2``, ``pairs``, ``times``.

    ``pairs`` holds each distinct linked pair once (id of A times the size of B's vocabulary plus id of B),
    ``times`` the number of its links. Null and empty texts, and texts that either vocabulary can't spell byte for byte, have no
    tokens: zeros, an empty string and empty arrays. Every row is on its own, repeated ones too; other columns are not
    looked at. No shuffle.
    """
    text_batches(docs)
    aligner = Aligner(a, b)

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([aligner.align(part) for part in parts_of(texts.to_pylist())])

    return docs.select(quoted(doc_id).alias(doc_id), found(text_of(text)).alias("found")).select(quoted(doc_id), "found.*")


def weigh_links(aligned: DataFrame, size_b: int) -> DataFrame:
    """``aligned`` less ``pairs`` and ``times``, with ``n_best`` and ``count_sum``.

    A pair's count is the number of rows that hold it. ``n_best``: links whose count is the highest that any pair of the
    same A id has, ties included; ``count_sum``: the counts of all links together. Rows without links get 0.
    """
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = checkpointed(aligned.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
    local = checkpointed(rows.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("n")))
    counts = local.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("pair") / size_b))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    graded = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = local.select("block", "pair").join(graded, "pair")

    def weigh(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        table = right.sort_by("pair").combine_chunks()
        of, count, good = (table.column(c).to_numpy().astype(np.int64) for c in ("pair", "count", "best"))
        pairs, times = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in left.column(c).chunks] or [np.zeros(0, np.int64)]) for c in ("pairs", "times"))
        each = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in left.column("pairs").chunks] or [np.zeros(0, np.int64)])
        place = np.searchsorted(of, pairs)
        ends = np.r_[0, np.cumsum(each)].astype(np.int64)
        out = left.select(kept)
        for name, weight in (("n_best", good), ("count_sum", count)):
            total = np.r_[0, np.cumsum(times * weight[place])].astype(np.int64)
            out = out.append_column(name, pa.array(total[ends[1:]] - total[ends[:-1]]))
        return out

    schema = ", ".join([f"`{c}` {kind}" for c, kind in rows.select(*map(quoted, kept)).dtypes] + ["n_best bigint", "count_sum bigint"])
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(weigh, schema)
