"""Structure repair, exact search and tokenizer alignment against plain versions, and on awkward tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattgrid.llm import alignment, conversation_repair, vector_search

WHITE = " \t\n\x0b\x0c\r"

# ---------------------------------------------------------------- structure repair


def damaged_rows(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """(cost, audit, repaired text) by a best-first search over whole edit sequences."""
    agenda, done = [(0, "", "", 0, "")], set()  # cost, audit, initials, rows read, text
    while agenda:
        cost, audit, initials, i, text = heapq.heappop(agenda)
        state = "" if not initials else initials[-1]
        if (state, i) in done:
            continue
        done.add((state, i))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, text
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(agenda, (cost + 5, audit + "I", initials + due, i, f"{text}{name}:\n"))
        if i < len(rows):
            role, said, fault = rows[i]
            more = 5 if fault == "truncated" else 0
            heapq.heappush(agenda, (cost + 2, audit + "D", initials, i + 1, text))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(agenda, (cost + 1 + more, audit + "R", initials + due, i + 1, f"{text}{name}:{said}\n"))
                if role[:1] == due or role[:1] == "s" and state == "":
                    heapq.heappush(agenda, (cost + more, audit + "K", initials + role[:1], i + 1, f"{text}{role}:{said}\n"))


def plain_repair(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, found in by.items():
        found.sort()
        seen, marked = set(), []
        for _, _, role, text in found:
            solid = text.strip(WHITE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for there, t, _, _ in found if there]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        cost, audit, text = cheapest(marked)
        faults = Counter(m[2] for m in marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text[:-1].encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"


def as_dict(found):
    rows = found.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def some_turns(seed, n, conversations, turns):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Done. \t", "a. b", "x"]
    return [(draw.choice(conversations), draw.choice(turns), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "users"]), draw.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 12])
def test_repair_is_the_cheapest_and_least(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "STRIP_BITS", bits)
    rows = some_turns(1, 400, list(range(60)) + [None], [None, *range(6)]) + some_turns(2, 120, [77], list(range(40)))
    rows += [(88, 5, None, None), (89, None, "user", "é漢." * 20_000), (89, None, "user", "é漢." * 20_000), (90, 1, "user", None)]
    found = as_dict(conversation_repair.repair(spark.createDataFrame(rows, TURNS).repartition(3)))
    expected = plain_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert found == expected


def test_a_hot_conversation_lies_in_many_strips(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "STRIP_BITS", 4)
    rows = some_turns(3, 600, [1], list(range(500)))
    ranged = conversation_repair._ordered(spark.createDataFrame(rows, TURNS))
    assert ranged.groupBy("strip").count().agg(F.max("count")).first()[0] <= 16
    assert as_dict(conversation_repair.repair(spark.createDataFrame(rows, TURNS))) == plain_repair(rows)


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, r, x) for c in [*range(40), None] for t, r, x in [(0, "user", "Hi. There!"), (1, "assistant", None), (None, None, "Ok.")]] + [(1000 + c, 0, "user", "Hm.") for c in range(60)]
    turns = spark.createDataFrame(rows, TURNS)
    hurt = conversation_repair.damaged(turns)
    plain = list(damaged_rows(rows))
    assert sorted(map(str, map(tuple, hurt.collect()))) == sorted(map(str, plain))
    found = as_dict(conversation_repair.repair(hurt, turns))
    expected = plain_repair(plain)
    gone = set(r[0] for r in rows) - set(expected)
    assert gone and found == expected | {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone}


def test_repair_of_nothing_and_of_clashing_names(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair(conversation_repair.damaged(none), none).collect() == []
    rows = some_turns(4, 30, [1, 2], list(range(9)))
    named = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("own") for c in ("conv", "place", "strip", "key", "step", "uid", "cost", "kind", "copy")})
    assert as_dict(conversation_repair.repair(named)) == plain_repair(rows)


def test_least_audit_among_ties():
    node, label, to = (np.array(x) for x in ([0, 0, 1, 2, 3, 4], [3, 1, 2, 4, 3, 1], [1, 2, 3, 4, 5, 5]))
    ways = conversation_repair.least_audits(node, label, to, 6, [0, 1, 5])
    assert ["".join(conversation_repair.LABELS[x - 1] for x, _ in w) for w in ways] == ["DRD", "IK", ""]


# ---------------------------------------------------------------- exact search


VECTORS = "vec_id long, embedding array<float>, asks boolean"


def plain_search(rows, k):
    out = []
    good = [(i, v, a) for i, v, a in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    ints = [[int(np.floor(64.0 * float(np.float32(x)))) for x in v] for _, v, _ in good]
    for q, (query, _, asks) in enumerate(good):
        if asks:
            scored = sorted((-sum(x * y for x, y in zip(ints[q], ints[c])), good[c][0] is None, good[c][0] or 0) for c in range(len(good)) if c != q)[:k]
            out += [(query, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(scored)]
    return Counter(out)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.where(draw.random(8) < 0.4, 0, draw.normal(0, 0.05, 8))], i % 20 == 0) for i in range(300)]
    rows += [(i, [0.5] * 8, i % 20 == 0) for i in range(300, 420)]  # many ties
    rows += [(40, [0.1] * 8, True), (40, [0.1] * 8, True), (7, [0.2] * 8, False), (None, [0.5] * 8, None), (1000, None, True), (1001, [0.1, None], True), (1002, [float("nan")] * 8, True),
             (1003, [float("inf")] * 8, False), (1020, [], True), (1040, [0.3, 0.4], True), (1005, [0.01] * 20, False)]
    return rows


@pytest.mark.parametrize("blocks", [(8192, 1024), (50, 7)])
def test_search_equals_brute_force(spark, monkeypatch, vectors, blocks):
    monkeypatch.setattr(vector_search, "CANDIDATES", blocks[0])
    monkeypatch.setattr(vector_search, "QUERIES", blocks[1])
    table = spark.createDataFrame(vectors, VECTORS).repartition(4).withColumns({c: F.lit(1) for c in ("id", "row", "q", "c", "score", "rank", "query_id")})
    found = Counter(tuple(r) for r in vector_search.top_k(table, F.col("asks")).collect())
    assert found == plain_search(vectors, 20)


def test_search_of_few_none_and_huge_components(spark):
    few = [(0, [1.0, -2.0], True), (1, [3.0, 1.0], False)]
    assert [tuple(r) for r in vector_search.top_k(spark.createDataFrame(few, VECTORS), F.col("asks")).collect()] == [(0, 1, 1, 64 * 192 - 128 * 64)]
    assert vector_search.top_k(spark.createDataFrame([], VECTORS), F.col("asks")).collect() == []
    assert vector_search.top_k(spark.createDataFrame(few[:1], VECTORS), F.col("asks")).collect() == []
    huge = [(0, [1e9, 1e9], True), (1, [1e9, 1.0], False), (2, [-1e30, 0.0], False), (3, [1e30, 1e30], False)] + [(10 + i, [0.0, float(i)], False) for i in range(30)]
    found = [(r["vec_id"], r["score"]) for r in vector_search.top_k(spark.createDataFrame(huge, VECTORS), F.col("asks"), k=3).orderBy("rank").collect()]
    assert [i for i, _ in found] == [1, 3, 39] and found[0][1] == found[1][1] == vector_search.TOP


# ---------------------------------------------------------------- alignment


TEXTS = ["The quick brown fox, 42 times!", "the the the", " leading  spaces\n\nand lines\t.", "é漢字😀 naïve x\x00y", "<|endoftext|> </s> <s> <0x41> [INST]", "▁ literal", "", None, "a", "\n", "don't we'll",
         "The quick brown fox, 42 times!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ſtrange ﬁ ligatures", "   "]


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(alignment.BYTES_PATH), SentencePieceProcessor(model_file=alignment.PIECES_PATH)
    one.encode_special_tokens = True
    letters = alignment.byte_letters()
    name = {i: bytes(letters[c] for c in t) for t, i in one.get_vocab().items() if t != "<|endoftext|>"}
    piece = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    out, linked = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        if b"".join(name[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            a, b = [], []
        spans = []
        for ids, of in ((a, name.__getitem__), (b, piece)):
            at, spans_of = 0, []
            for i in ids:
                spans_of.append((at, at + len(of(i))))
                at += len(of(i))
            spans.append(spans_of)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, (_, e) in zip(ids, span) if low < e <= high) for ids, span in zip((a, b), spans)) for low, high in zip([0, *cuts], cuts)]
        links = [(i, j) for i, (s, e) in zip(a, spans[0]) for j, (t, u) in zip(b, spans[1]) if s < u and t < e]
        linked.append(links)
        out.append([len(a), len(b), len(groups), len(links), ";".join(groups)])
    counts = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(*row, sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links)) for row, links in zip(out, linked)]


@pytest.mark.parametrize("bits", [1, 12])
def test_alignment_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(alignment, "BLOCK_BITS", bits)
    a, b = alignment.ByteLevel(), alignment.Pieces()
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "the the the")], "doc_id long, text string").withColumns({c: F.lit("own") for c in ("pairs", "found", "block", "n_a", "count")}).repartition(2)
    found = alignment.weigh_links(alignment.align(docs, a, b), len(b.bytes))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    expected = plain_alignment([*TEXTS, "the the the"])
    assert sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in found.collect())) == sorted((i if i < len(TEXTS) else -1, *row) for i, row in enumerate(expected))


def test_both_libraries_cut_alike():
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(alignment.BYTES_PATH)
    one.encode_special_tokens = True
    draw = random.Random(6)
    texts = [" " + "".join(chr(draw.choice([draw.randrange(1, 128), draw.randrange(1, 0x3000), draw.randrange(0x3000, 0xD800), draw.randrange(0xE000, 0x20000)])) for _ in range(50)) for _ in range(3000)]
    assert alignment.ByteLevel().encode(texts) == [e.ids for e in one.encode_batch(texts, add_special_tokens=False)]


def test_alignment_of_very_long_texts_and_of_nothing(spark):
    a, b = alignment.ByteLevel(), alignment.Pieces()
    docs = spark.createDataFrame([(1, "lorem ipsum dolor " * 60_000), (2, " " * 300_000), (3, "x" * 300_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.weigh_links(alignment.align(docs, a, b), len(b.bytes)).collect()}
    assert all(r["n_a"] > 0 and r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in rows.values())
    assert alignment.weigh_links(alignment.align(docs.limit(0), a, b), len(b.bytes)).collect() == []


def test_alignment_lays_texts_together(monkeypatch):
    one = alignment.Aligner(alignment.ByteLevel(), alignment.Pieces())
    texts = [*TEXTS, "", "the the the", "\U0001f600 </s> x\x00y", "", "word " * 40]
    texts = [t or "" for t in texts]
    alone = [one.align([t]).to_pylist()[0] for t in texts]
    monkeypatch.setattr(alignment, "PART_LENGTH", 60)
    parts = alignment.parts_of(texts)
    assert [t for p in parts for t in p] == texts and 2 < len(parts) < len(texts)
    assert max(sum(map(len, p)) for p in parts if len(p) > 1) <= 60
    for together in ([one.align(p) for p in parts], [one.align(texts)]):
        assert [row for found in together for row in found.to_pylist()] == alone
    assert len(one.align([])) == 0
