"""Prefix trie, filter audit and SentencePiece coding against brute force and the library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from abstracta.llm import filter_audit, prefix_trie, sentence_pieces as sp
from abstracta.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- prefix trie --------------------------------------------------------------------------


def brute_trie(rows):
    """``rows`` of (conv, turn, role, text) to the node rows of the contract."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", sha(text or ""), text or ""))
    own = {c: [(role, text) for _, role, _, text in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        group = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(group, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = {}
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        words = lambda m: len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0
        saved = sum((len(members[m]) - 1) * words(m) for m in below)
        parent = min(members[node[:-1]]) if node else None
        out[min(convs), len(node)] = (
            parent, len(convs), len(kids), len(leaves), saved, sha(",".join(map(str, sorted(ends.get(node, [])))))
        )
    return out


def spark_trie(frame):
    rows = prefix_trie.trie(prefix_trie.grafted(prefix_trie.numbered(frame))).collect()
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}


def conversations(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return frame.withColumns({c: F.lit("x") for c in ("node", "parent", "place", "range", "n", "id", "child", "a", "words")})


def test_trie_of_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(None, 0, "user", "no id"), (None, None, None, None)]
    for c in (*range(0, 70), -1, -25, 1000, 3001, 3002):
        if c % 20 == 0 and c in (40,):
            continue  # an absent first conversation
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a b", "a", "", None, "long " * 30])))
    rows += [(3001, None, None, None), (3001, 2, "user", "tie"), (3001, 2, "user", "tie"), (3001, 2, "bot", "tie"), (3002, 1, "u", "q" * 3000)]
    frame = conversations(spark, rows)
    assert spark_trie(frame) == brute_trie(rows)
    assert spark_trie(frame.limit(0)) == {}


def test_trie_worked_on_in_ranges(spark, monkeypatch):
    """Conversations longer than a range, and a node with more ends than one."""
    monkeypatch.setattr(prefix_trie, "RANGE", 5)
    rows = [(c, t, "u", f"w{t % 3} x") for c in (7, 21, 22, 23, 24, 25) for t in range(23)]
    rows += [(c, 0, "u", "w0 x") for c in range(100, 140)] + [(22, 23, "u", "more")]
    assert spark_trie(conversations(spark, rows)) == brute_trie(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "caterpillar", "random", "forest"])
def test_subtree_totals(spark, shape):
    rng = random.Random(shape)
    n = 60
    parent = {
        "chain": lambda i: i - 1, "star": lambda i: 0, "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2),
        "random": lambda i: rng.randrange(i), "forest": lambda i: None if i % 20 == 0 else i - 1,
    }[shape]
    up = {0: None} | {i: parent(i) for i in range(1, n)}
    depth = {i: 0 for i in up}
    for i in up:
        depth[i] = 0 if up[i] is None else depth[up[i]] + 1
    weights = {i: (rng.randint(0, 9), rng.randint(-5, 5)) for i in up}
    totals = {i: list(weights[i]) for i in up}
    for i in sorted(up, reverse=True):
        if up[i] is not None:
            totals[up[i]][0] += totals[i][0]
            totals[up[i]][1] += totals[i][1]
    tree = spark.createDataFrame([(i, up[i], depth[i], *weights[i]) for i in up], "id long, parent long, depth long, w1 long, w2 long")
    assert {r.id: [r.t1, r.t2] for r in prefix_trie.subtree_totals(tree).collect()} == totals


def test_chains_contract_in_few_rounds(spark, monkeypatch):
    rounds = []
    compressed = prefix_trie._compressed
    monkeypatch.setattr(prefix_trie, "_compressed", lambda tree: rounds.append(1) or compressed(tree))
    n = 1000
    tree = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.col("id").alias("depth"), F.lit(1).cast("long").alias("w1"), F.col("id").alias("w2"))
    got = {r.id: (r.t1, r.t2) for r in prefix_trie.subtree_totals(tree).collect()}
    assert got == {i: (n - i, (n - 1 + i) * (n - i) // 2) for i in range(n)}
    assert len(rounds) <= 14


# ---- filter audit -------------------------------------------------------------------------


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    fails = []
    for doc_id, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > least[text],
        }
        fails.append((part or "", {f for f, yes in failed.items() if yes}, doc_id in good, doc_id in toxic))
    out, removed_by = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [(f, g, t) for p, f, g, t in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [(g, t) for f, g, t in mine if letter in f and not f & before]
                removed_by[part, letter] += len(here)
                out[part, "".join(order), step] = [
                    sum(1 for f, _, _ in mine if not f & (before | {letter})), len(here),
                    sum(1 for f, _, _ in mine if letter in f and f & before), sum(1 for f, _, _ in mine if f == {letter}),
                    sum(g for g, _ in here), sum(t for _, t in here),
                ]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def spark_audit(docs, labels):
    rows = filter_audit.audit(filter_audit.failed_sets(filter_audit.failures(docs), labels)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


def test_audit_of_awkward_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "é" * 30, "A" * 40, "word " * 60, " ".join(f"w{i}" for i in range(70)), "50 % off #1", "copy me"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(160)]
    docs += [(500 + i, "a hot text", "s") for i in range(300)] + [(None, "a hot text", "s")] * 20
    docs += [(900, "x" * 100_000 + " y" * 50_000, "t")]
    labels = [(rng.choice([None, *range(600)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    frame = frame.withColumns({c: F.lit("x") for c in ("part", "failed", "digest", "good", "toxic", "quality", "salt", "n")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    assert spark_audit(frame, marks) == brute_audit(docs, labels)
    assert spark_audit(frame, marks.limit(0)) == brute_audit(docs, [])
    assert spark_audit(frame.limit(0), marks) == {}


def test_potentials_are_those_of_the_removal_game(spark):
    sets = spark.createDataFrame([("p", m, m + 1, 0, 0) for m in range(32)], "part string, failed int, n long, good long, toxic long")
    game = filter_audit.coalitions(sets).head()
    value = {s: sum(m + 1 for m in range(32) if m & s) for s in range(32)}
    assert [v["n"] for v in game.value] == list(value.values())
    potential = {0: 0.0}
    for s in range(1, 32):
        members = [i for i in range(5) if s >> i & 1]
        potential[s] = (value[s] + sum(potential[s & ~(1 << i)] for i in members)) / len(members)
    factorial = [1, 1, 2, 6, 24, 120]
    assert game.potential == [round(potential[s] * factorial[s.bit_count()]) for s in range(32)]
    # The contributions of all filters share the grand coalition's value.
    assert sum(game.potential[31] - 5 * game.potential[31 & ~(1 << i)] for i in range(5)) == 120 * value[31]


# ---- SentencePiece ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces():
    return sp.vocabulary()


def texts():
    rng = random.Random(11)
    alphabet = "ab \n▁éß梦xyz.,0189  the'\"—“”²\t\r\x00😀"
    fixed = ["", " ", "  ", "a  b", "▁▁a ▁", "x\x00y", "q" * 700, " " * 40 + "x", " \n \n", "<s> <0x41> <unk> </s>", "m². (e.g.,", "梦想" * 400]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(1500)]


@pytest.mark.parametrize("long", [sp.LONG, 3])
def test_ids_equal_the_library(library, pieces, long, monkeypatch):
    monkeypatch.setattr(sp, "LONG", long)  # 3: tangled words go through the heap
    encoder = sp.Encoder(sp.merges(pieces))
    given = texts() + [" " * 5000, "é" * 3000 + " long " * 3000]
    ids, counts = encoder.encode(given)
    expected = library.encode(given)
    assert counts.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for one in expected for i in one]
    assert encoder.encode([])[0].tolist() == []
    # Once more from what is remembered, and after it was forgotten.
    monkeypatch.setattr(sp, "HELD", 10)
    assert encoder.encode(given)[0].tolist() == ids.tolist()


def test_words_may_cross_spaces_if_pieces_do(pieces):
    """A vocabulary with a piece over a space: words are no longer cut there."""
    more = [*pieces, ("a▁b", 1.0, "normal")]
    assert sp.word_pattern([p for p, _, k in more if k == "normal"]) == "(?s).+"
    ids, _ = sp.Encoder(sp.merges(more)).encode(["a b"])
    assert [more[i][0] for i in ids] == ["▁a", "▁b"]  # better: a▁b needs a▁ or ▁b first
    with_half = [*more, ("a▁", 2.0, "normal"), ("▁a▁b", 3.0, "normal")]
    ids, _ = sp.Encoder(sp.merges(with_half)).encode(["a b"])
    assert [with_half[i][0] for i in ids] == ["▁a▁b"]


def test_decoding_equals_the_library(library, pieces):
    rng = random.Random(2)
    decoder = sp.Decoder(pieces)
    lists = [[rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999), 29871]) for _ in range(rng.randint(0, 8))] for _ in range(4000)]
    expected = [library.decode(ids) for ids in lists]
    assert [decoder.decode(ids) for ids in lists] == expected
    flat, counts = np.array([i for ids in lists for i in ids], np.int32), np.array(list(map(len, lists)))
    assert decoder.decode_all(flat, counts).to_pylist() == expected
    given = library.encode(texts())
    flat, counts = np.array([i for ids in given for i in ids], np.int32), np.array(list(map(len, given)))
    assert decoder.decode_all(flat, counts).to_pylist() == [library.decode(ids) for ids in given]


def test_awkward_documents(spark, awkward, library):
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in sp.encode(awkward).collect()), key=repr)
    rows = [(r.doc_id, library.encode(r.text or "")) for r in awkward.collect()]
    assert got == sorted(((d, ids, library.decode(ids)) for d, ids in rows), key=repr)
    assert sp.encode(awkward.limit(0)).collect() == []


def test_query_equals_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = {}
    for r in docs:
        ids = library.encode(r.text or "")
        expected[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op13_sentence_pieces"](spark, sf_dir).collect()} == expected
