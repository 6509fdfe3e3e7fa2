"""Conversation repair, hard negatives and piece encoding against brute force and the library."""

import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcast.llm import negatives, pieces, repair
from foldcast.llm.registry import QUERIES

BY_NAME = {f.__name__: f for f in QUERIES}
STEP = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
SPACE = " \t\n\x0b\f\r"


# --- op11 ------------------------------------------------------------------------

def cheapest(codes):
    """Least (cost, audit) over rows and states of the role automaton."""
    heap, best = [(0, "", 0, "0")], {}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in best:
            continue
        best[i, q] = (cost, audit)
        if i < len(codes):
            code = codes[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if code != "-":
                late = code.isupper()
                if (q, code.lower()) in STEP:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, STEP[q, code.lower()]))
                for role in "ua":
                    if (q, role) in STEP:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, STEP[q, role]))
        for role in "ua":
            if (q, role) in STEP:
                heapq.heappush(heap, (cost + 2, audit + "I", i, STEP[q, role]))
    return min(best[len(codes), q] for q in "0A" if (len(codes), q) in best)


def repaired_by_hand(rows):
    """The stated result of one conversation's rows ``(turn, role, text)`` before damage, by ``conv_id``."""
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    out = []
    for conv, own in by_conv.items():
        after = []
        for turn, role, text in own:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            if kind == 1:
                text = ""
            if kind == 2:
                text = "".join(c for c in text if c not in ".!?")
            if kind == 4:
                role = "user"
            after += [(turn, role, text)] * (1 + (kind == 3))
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, codes, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for turn, role, text in after:
            bare = text.rstrip(SPACE)
            code = role[:1] if role[:1] in set("sua") else "x"
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
                code = code.upper() if fault == "truncated" else "-"
            codes += code
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit = cheapest(codes)
        lines, rest, spoken = [], list(after), 0
        for edit in audit:
            role, text = (None, "") if edit == "I" else rest.pop(0)[1:]
            if edit == "D":
                continue
            role = ("user", "assistant")[spoken % 2] if edit in "IR" else role
            spoken += role[:1] in ("u", "a")
            lines.append(f"{role}:{text}")
        turns = {r[0] for r in after} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_parser_finds_the_cheapest_edits():
    rng, of = random.Random(5), repair.Repairer()
    for _ in range(3000):
        codes = "".join(rng.choice("suaxSUAX-ua") for _ in range(rng.randint(0, 12)))
        assert of.repair(codes) == cheapest(codes)
    assert of.repair("") == (0, "") and of.repair("sua") == (0, "KKK") and of.repair("su") == (2, "KKI")


def test_repair_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert tuples(BY_NAME["op11_glr_repair"](spark, folder)) == repaired_by_hand(rows)


@pytest.mark.parametrize("bounds", [{}, {"whole_rows": 3}, {"whole_chars": 50}])
def test_repair_of_odd_rows(spark, bounds, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 4)
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "", ""), (7, None, "user", "x"), (7, None, "user", "x"), (8, 0, None, " \t"), (9, 5, "system", "Long. " * 9000)]
    for conv in range(30):
        for _ in range(rng.randint(1, 40)):
            role = rng.choice(["user", "assistant", "system", "tool", "u", "", None])
            rows.append((conv, rng.choice([None, *range(12)]), role, rng.choice(["Yes.", "No", "", None, "What? ", "So\n", "Aye!", f"It {rng.random()}."])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"code": F.lit("z"), "n": F.lit(1)})
    assert tuples(repair.repair_damaged(df, **bounds)) == repaired_by_hand(rows)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_damaged(none).collect() == []
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(lost, 0, "user", "Hi.")], none.schema)
    assert tuples(repair.repair_damaged(gone)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- op12 ------------------------------------------------------------------------

def mined_by_hand(rows, every):
    own = [(v, label, [math.floor(256 * float(np.float32(x))) for x in e]) for v, label, e in rows
           if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for k, (v, label, x) in enumerate(own):
        if v % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), w, m == label) for j, (w, m, y) in enumerate(own) if j != k)
        for s, w, _ in [r for r in scored if r[2]][:5]:
            fit = [r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(v, w, n, r[1], -s, -r[0]) for n, r in enumerate(fit, 1)]
    return sorted(out)


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    return [(k, int(rng.integers(0, 4)), [float(x) for x in (centres[k % 6] + rng.normal(size=8) * 0.05).astype(np.float32)]) for k in range(n)]


VECTORS = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("tree_rows", [40, 1024])
def test_negatives_of_odd_rows(spark, tree_rows, monkeypatch):
    monkeypatch.setattr(negatives, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    rows = clustered(400)
    same = rows[12][2]
    rows += [(500 + k, k % 3, same) for k in range(60)] + [(12, 1, same), (12, 1, same), (20, 0, [0.0] * 8)]
    rows += [(None, 1, same), (600, None, same), (601, 1, None), (602, 1, [1.0, None]), (610, 1, [float("nan")] * 8), (611, 2, [float("inf")] * 8), (620, 2, []), (630, 2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit(1), "row": F.lit("r"), "tree": F.lit(0)})
    got = negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert tuples(got) == sorted(mined_by_hand(rows, 10), key=repr)


def test_negatives_of_few_rows(spark):
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]):
        got = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0)
        assert tuples(got) == mined_by_hand(rows, 100)


def test_trees_cover_and_prune():
    x = np.floor(256 * np.array([r[2] for r in clustered(900)]))
    top = float(np.sqrt(np.square(x).sum(axis=1)).max())
    z = negatives._augmented(x, top)
    tree = negatives.Tree(x, z)
    assert sorted(tree.order.tolist()) == list(range(900))

    def below(node):
        if tree.leaf[node]:
            return tree.order[tree.low[node] : tree.high[node]].tolist()
        return [r for c in range(tree.low[node], tree.high[node]) for r in below(c)]

    for node in range(len(tree.centre)):
        far = np.sqrt(np.square(z[below(node)] - z[tree.centre[node]]).sum(axis=1))
        assert far.max() <= tree.radius[node] + 1e-9
        children = [] if tree.leaf[node] else list(range(tree.low[node], tree.high[node]))
        assert all(tree.radius[c] <= tree.radius[node] / negatives.BASE + 1e-9 for c in children)
    place = np.argsort(tree.order)
    as_given = {"x": x[tree.order], "norm": top, "centre": place[tree.centre], "radius": np.array(tree.radius), "low": np.array(tree.low), "high": np.array(tree.high), "leaf": np.array(tree.leaf)}
    q = x[:20]
    found = negatives.Found(np.full((20, 1), -np.inf), np.full((20, 1), np.inf), np.full((20, 1, 5), -np.inf))
    _, computed = negatives.search(as_given, q, np.ones((20, 900), bool), found)
    assert np.array_equal(found.best[:, 0], np.sort(q @ x.T, axis=1)[:, -5:]) and computed < 0.5 * 20 * 900


# --- op13 ------------------------------------------------------------------------

ODD = ["", " ", "a", "  two  spaces ", "▁a▁b", "tab\tline\n\nend", "é ü 日本語のテキスト 😀\u0000", "<s> </s> <0x41> <unk>", "thequickbrownfox" * 400, "nospace" + "a" * 3000, "word " * 20_000, "﻿​́"]


def library_row(doc_id, text):
    from sentencepiece import SentencePieceProcessor

    of = SentencePieceProcessor(model_file=pieces.default_path())
    ids = of.encode(text or "", add_bos=True, add_eos=True)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(of.decode(ids).encode()).hexdigest()


def test_pieces_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert tuples(BY_NAME["op13_agenda_pieces"](spark, folder)) == sorted((library_row(*r) for r in docs), key=repr)


def test_pieces_of_odd_texts(spark):
    rows = [*enumerate(ODD), (None, "x"), (3, None), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "_text": F.lit("no"), "decoded": F.lit(2)})
    made = pieces.encode(df)
    both = made.unionByName(made.limit(0)).select("doc_id", "ids")
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in both.collect()), key=repr)
    from sentencepiece import SentencePieceProcessor

    of = SentencePieceProcessor(model_file=pieces.default_path())
    assert got == sorted(((d, of.encode(t or "", add_bos=True, add_eos=True)) for d, t in rows), key=repr)
    texts = sorted((r.decoded for r in pieces.decode(made).collect()))
    assert texts == sorted(of.decode(i) for _, i in got)
    assert pieces.encode(df.limit(0)).collect() == []


def test_agenda_equals_the_library_on_random_texts():
    rng, of = random.Random(4), pieces.encoder(pieces.default_path())
    parts = ["a", "the", "ing", " ", "  ", "\n", "▁", "é", "日", "\u0000", "😀", "<s>", "Ω", "́", "12", ".", "//", "퟿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    of.check(texts, [of.encode(t) for t in texts])
    with pytest.raises(ValueError, match="otherwise"):
        of.check(["abc"], [of.encode("abd")])
    assert all(of.merged(w) == of.merged_short(w) for t in texts for w in of.words(t))


def test_pieces_are_kept_as_bytes_and_checked():
    of = pieces.PieceEncoder(pieces.default_path())
    texts = ["a word, a word", "", "ünder 東京 \n\n  x" * 9]
    got = [of.encode(t) for t in texts]
    want = [list(i) for i in of.library.encode(texts, add_bos=True, add_eos=True)]
    assert all(isinstance(i, bytes) for i in [*got, *of.known.values()])
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == want == of.check(texts, got)
    with pytest.raises(ValueError, match="otherwise"):
        of.check(texts, [got[0][:-4], *got[1:]])
