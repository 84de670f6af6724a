"""Brute force, round trips and held-out accuracy for the operators."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from abstracta.llm import chat, components, decontaminate, licenses, mixing, simhash, suffix, token_counts, topk, toxicity, warc
from abstracta.llm.common import stored
from abstracta.llm.queries import QUERIES, toxicity_model
from abstracta.session import table

# -- 1: top-k ------------------------------------------------------------------------------


def test_topk_shards_blocks_ties_and_bad_rows(spark):
    random.seed(1)
    rows = [(i, [random.choice([0.5, -0.25, 0.125]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(300)] + [(7, [0.5, 0.5, 0.5, 0.5])]
    rows += [(None, [1.0] * 4), (2000, None), (2050, [1.0, None, 0.0, 0.0]), (2100, [float("nan")] * 4), (2150, [1.0] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = topk.top_k(frame.repartition(3), F.col("id") % 50 == 0, 5, shard_rows=64, block_bytes=500).collect()
    good = [(i, np.floor(np.array(v) * 256)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for query in {i for i, _ in good if i % 50 == 0}:
        vector = next(v for i, v in good if i == query)
        best = sorted((-int(vector @ v), i) for i, v in good if i != query and len(v) == len(vector))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == query)
        assert [(-s, i) for _, i, s in mine] == best
    assert not [r for r in got if r["query_id"] in (2000, 2050, 2100)]


def test_topk_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame, F.col("id") % 50 == 0, 5).collect() == []


# -- 2: toxicity ---------------------------------------------------------------------------


def test_toxicity_restores_and_separates(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    costs = toxicity.letter_costs(toxicity.gram_counts(docs))
    decoder = toxicity.Decoder(costs)
    for said, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("iiidiooot", "idiot"), ("i d i o t", "idiot"), ("$tup!d", "stupid")):
        assert decoder.restored(f"so {said} he") == f"so {meant} he"
    assert decoder.restored("Plain text, left alone.") == "plain text, left alone."
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    rows = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    wrong = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.7 and sum(wrong) / len(wrong) < 0.05


def test_toxicity_reading_is_the_cheapest_of_all(spark):
    """Exhaustive search over the readings of short stretches."""
    costs = toxicity.letter_costs(toxicity.gram_counts(table(spark, "/root/testdata/sf0.001", "documents")))
    decoder, rng = toxicity.Decoder(costs), random.Random(12)
    stretches = ["1d10t", "a$$", "id10+", "i d 0 t", "y o u  a r", "sttt1", "$$$a", "m0 r"]
    stretches += ["".join(rng.choice("abet01!$3 .") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    for stretch in stretches:
        best = None
        for path in itertools.product(*decoder.lattice(stretch)):
            context, cost = 0, 0.0
            for piece, channel in path:
                context, spoken = decoder.spoken(context, piece)
                cost += channel + spoken
            cost += float(costs[context * toxicity.LETTERS])
            text = "".join(piece for piece, _ in path)
            if best is None or cost < best[0] - 1e-9:
                best = cost, {text}
            elif abs(cost - best[0]) <= 1e-9:
                best[1].add(text)
        assert decoder._decode(stretch) in best[1], stretch


def test_toxicity_reaches_disguise_anywhere_in_a_word(spark):
    costs = toxicity.letter_costs(toxicity.gram_counts(table(spark, "/root/testdata/sf0.01", "documents")))
    decoder = toxicity.Decoder(costs)
    assert decoder.restored("so idi0+ he") == "so idiot he"
    assert "$" not in decoder.restored("you a$$") and "5" not in decoder.restored("you dumba55 worthle55")
    assert decoder.restored("he said: y o u  a r e  s t u p i d") == "he said: you are stupid"
    drawn = "s" + "t" * 200 + "upid"  # no cut at 64 characters
    assert decoder.restored(drawn) == "stupid"
    spelled = " ".join("idiot") * 1
    assert decoder.restored("x" * 70 + " " + spelled + " " + "y" * 70).split()[1] == "idiot"
    assert decoder.restored("mp" + "3" + " stop! (see it)").endswith("stop! (see it)")


def test_toxicity_brute_force_scores(spark, sf_dir):
    """Scores are the prior and the weights of the distinct marks in the restored text, row by row."""
    import math

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_model(docs, labels)
    decoder = toxicity.Decoder(model.costs)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for row in docs.collect():
        found = toxicity.marks(decoder.restored(row["text"] or ""))
        odds = model.prior + sum(w for mark, w in sorted(model.weights.items()) if mark in found)
        assert math.isclose(got[row["doc_id"]], 1 / (1 + math.exp(-max(-50, min(50, odds)))), rel_tol=1e-9)
    kept = {r["doc_id"] for r in toxicity.kept(docs, model).collect()}
    assert kept == {d for d, score in got.items() if score < toxicity.THRESHOLD}


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels, F.lit(True))
    assert toxicity.score(awkward, model).count() == awkward.count()
    assert toxicity.kept(awkward, model).columns == awkward.columns
    none = toxicity.fit(awkward, labels.limit(0), F.lit(True))
    assert toxicity.kept(awkward, none).count() == awkward.count()
    assert toxicity.score(awkward.limit(0), toxicity.fit(awkward.limit(0), labels, F.lit(True))).collect() == []


# -- 3: token counts -----------------------------------------------------------------------


def test_token_trees_equal_full_encoding():
    encoder = token_counts.Encoder(token_counts.vocabulary())
    random.seed(2)
    signs = "ab 's'll\n\t  1!?éß'r"
    for _ in range(300):
        text = "".join(random.choice(signs) for _ in range(random.choice([0, 5, 40, 900, 3000])))
        tree = token_counts.TokenTree(text, encoder)
        for _ in range(4):
            start = random.randint(0, len(text))
            end = min(len(text), start + random.choice([0, 0, 1, 3, 50, 1000]))
            new = "".join(random.choice(signs) for _ in range(random.choice([0, 1, 2, 30, 600])))
            tree.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert [p for leaf in tree.pieces for p in leaf] == encoder.pattern.findall(text)
            assert tree.n_tokens == len(encoder.encoding.encode_ordinary(text)) and tree.n_chars == len(text)


def test_token_counts_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    encoding = token_counts.Encoder(token_counts.vocabulary()).encoding
    for row in table(spark, sf_dir, "documents").collect():
        text, n = row["text"], len(row["text"])
        got = rows[row["doc_id"]]
        assert got["n_tokens"] == len(encoding.encode_ordinary(text))
        text = text[: n // 2] + text.split("\n")[0] + text[n // 2 :]
        text = text[: n // 4] + text[n // 4 + 40 :]
        text = text[: max(0, n - 10)] + " 2nd edition, don't panic"
        assert (got["edited_tokens"], got["edited_chars"]) == (len(encoding.encode_ordinary(text)), len(text))
        assert got["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_token_counts_awkward(spark, awkward):
    edits = F.when(F.col("doc_id") == 1, F.expr("array(NULL, named_struct('start', -5, 'end', 99999, 'text', CAST(NULL AS STRING)))"))
    rows = token_counts.edited_counts(awkward.withColumn("edits", edits.cast(token_counts.EDITS))).collect()
    assert len(rows) == awkward.count() and next(r for r in rows if r["doc_id"] == 1)["edited_tokens"] == 0


# -- 4: suffix dedup -----------------------------------------------------------------------


def brute_kept(rows, length=100):
    """Rows in order of id and text, with which bytes of each go."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    first: dict = {}
    for number, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for at in range(len(data) - length + 1):
            first.setdefault(data[at : at + length], (number, at))
    for number, (doc_id, text) in enumerate(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if first[data[at : at + length]] != (number, at):
                gone[at : at + length] = b"\1" * length
        yield doc_id, data, gone


def brute_removed(rows, length=100):
    out = []
    for doc_id, data, gone in brute_kept(rows, length):
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_query_equals_brute_force(spark, sf_dir):
    want = brute_removed([(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()])
    assert sorted(map(tuple, QUERIES["op4_suffix_dedup"](spark, sf_dir).collect()), key=repr) == want


def test_suffix_overlapping_copies_runs_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix.strings, "__defaults__", (suffix.LENGTH, 4))  # string by string from 5 on
    random.seed(3)
    words = ["ab", "cde", "f", "ghij", "é", "x" * 40]
    base = " ".join(random.choice(words) for _ in range(300))
    rows = [(200, "q" * 500), (201, "q" * 150), (202, "ab" * 300)]
    for i in range(60):
        text = " ".join(random.choice(words) for _ in range(random.choice([0, 30, 100])))
        for _ in range(random.randint(0, 4)):
            start, at = random.randint(0, len(base) - 1), random.randint(0, len(text))
            text = text[:at] + base[start : start + random.randint(50, 400)] + text[at:]
        rows.append((random.choice([i, i, i, 5, None]), random.choice([text, text, text, text, None, ""])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffix.removed(frame).collect()), key=repr) == brute_removed(rows)


def test_suffix_family_levels_are_geometric():
    family, seen = suffix.SuffixFamily(), set()
    random.seed(4)
    for _ in range(50):
        keys = [b"%04d" % random.randint(0, 3000) for _ in range(64)]
        want = []
        for key in keys:
            want.append(key in seen)
            seen.add(key)
        assert family.add(np.array(keys, "S4")).tolist() == want
        sizes = [len(level) for level in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_suffix_awkward(spark, awkward):
    kept = suffix.deduplicated(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert suffix.deduplicated(awkward.limit(0)).collect() == []
    want = brute_removed([(r["doc_id"], r["text"]) for r in awkward.where("doc_id <> 6 OR doc_id IS NULL").collect()])
    assert sorted(map(tuple, suffix.removed(awkward.where("doc_id <> 6 OR doc_id IS NULL")).collect()), key=repr) == want


# -- 5: SimHash ----------------------------------------------------------------------------


def brute_fingerprint(text: str) -> int:
    import re

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect())
    prints = [brute_fingerprint(t) for _, t in docs]
    want = {(i, f"{p:016x}", docs[c][0]) for (i, _), p, c in zip(docs, prints, brute_components(prints, 4))}
    assert set(map(tuple, QUERIES["op5_simhash_near_dedup"](spark, sf_dir).collect())) == want


@pytest.mark.parametrize("group_rows", [4096, 12])
def test_golay_links_lose_nothing(spark, group_rows):
    random.seed(5)
    prints = [random.getrandbits(64) for _ in range(60)]
    for start in prints[:12]:
        for _ in range(6):
            start ^= sum(1 << b for b in random.sample(range(64), random.randint(1, 5)))
            prints.append(start)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    classes = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    parts = components.components(stored(simhash.links(classes, 4, group_rows), "test")).collect()
    part = {r["node"]: r["part"] for r in parts}
    want = brute_components([p % (1 << 64) for p in signed], 4)
    assert [part.get(p, p) for p in signed] == [signed[c] for c in want]


def test_simhash_awkward(spark, awkward):
    kept = simhash.deduplicated(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) == 2
    assert simhash.near_duplicates(awkward).count() == awkward.count()
    assert simhash.deduplicated(awkward.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (500, 500)], "a long, b long")
    got = {r["node"]: r["part"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500}


# -- 6: decontamination --------------------------------------------------------------------


def brute_distance(item, region):
    before = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(region, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def test_edit_distance_equals_brute_force():
    random.seed(6)
    for _ in range(500):
        item = [random.randint(0, 3) for _ in range(random.randint(1, 12))]
        region = [random.randint(0, 3) for _ in range(random.randint(0, 20))]
        assert decontaminate.edit_matches(item, region)[0] == brute_distance(item, region)


def test_decontamination_recall_at_the_largest_distance():
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(2000)]
    some = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, some(random.randint(15, 59))) for i in range(100)]
    index = decontaminate.Index([(i, " ".join(w)) for i, w in items], 0.2)
    texts = []
    for _, words in items:
        words = list(words)
        for _ in range(int(0.2 * len(words))):
            place = random.randrange(len(words))
            words[place : place + random.choice([0, 1, 1])] = random.choice([[], some(1)])
        texts.append(" ".join(some(30) + words + some(30)))
    found = decontaminate.matches(index, texts)
    assert sum(any(m[0] == i for m in mine) for (i, _), mine in zip(items, found)) >= 95
    assert not any(decontaminate.matches(index, [" ".join(some(500))])[0])


@pytest.mark.parametrize("kind", ["deletions", "insertions", "substitutions"])
@pytest.mark.parametrize("length", [15, 61, 150, 200, 400])
def test_decontamination_recall_by_length_and_kind(length, kind):
    """Planted at exactly the allowed distance; 0.95 asked for, see the README for the figures."""
    rng = random.Random(f"{length} {kind}")
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    n = 40
    items = [some(length) for _ in range(n)]
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)], 0.2)
    texts = []
    for words in items:
        words, edits = list(words), int(0.2 * length)
        places = rng.sample(range(length), edits)
        for place in sorted(places, reverse=True):
            words[place : place + (kind != "insertions")] = [] if kind == "deletions" else some(1)
        texts.append(" ".join(some(30) + words + some(30)))
    found = decontaminate.matches(index, texts)
    hits = sum(any(m[0] == i for m in mine) for i, mine in enumerate(found))
    print(f"recall {length} {kind} {hits / n:.3f}")
    assert hits >= 0.95 * n


def test_decontamination_of_items_too_short_for_an_edit():
    items = [(1, "one"), (2, "two words"), (3, "three small words"), (4, "now four small words"), (5, "")]
    index = decontaminate.Index(items, 0.2, least_words=1)
    found = decontaminate.matches(index, ["he said two words, not One", "three tiny words", "now four small words three small words", ""])
    assert [sorted(i for i, *_ in rows) for rows in found] == [[1, 2], [], [3, 4], []]
    assert decontaminate.Index(items, 0.2).items == []


def test_decontamination_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], decontaminate.words_of(r["text"])) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], decontaminate.words_of(r["text"])) for r in table(spark, sf_dir, "benchmark").collect()]
    want = set()
    for item_id, item in items:
        own = set(item)
        for doc_id, words in docs:
            if sum(w in own for w in words) >= 0.8 * len(item):
                distance = decontaminate.edit_matches(item, words)[0]
                if distance <= int(0.2 * len(item) + 1e-9):
                    want.add((doc_id, item_id, distance))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in QUERIES["op6_decontamination"](spark, sf_dir).collect()}
    assert got == want and want


def test_decontamination_awkward(spark, awkward):
    items = spark.createDataFrame([(1, "passage common20 passage common21 passage common22 passage"), (2, None), (None, "a b c d e"), (3, ""), (4, "too short")], "item_id long, text string")
    found = decontaminate.contamination(awkward, items).collect()
    assert sorted((r["doc_id"] or -1) for r in found) == [-1, 1, 2, 2] and {r["item_id"] for r in found} == {1}
    kept = decontaminate.decontaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
    assert decontaminate.decontaminated(awkward, items.limit(0)).count() == awkward.count()
    assert decontaminate.contamination(awkward.limit(0), items).collect() == []


def test_decontamination_of_long_items_in_small_steps(monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOW_WORDS", 6000)
    random = np.random.default_rng(5)
    item = [f"w{n}" for n in random.integers(0, 900, 300)]
    index = decontaminate.Index([(1, " ".join(item)), (2, " ".join(item[:40]))], decontaminate.SHARE)
    found = decontaminate.matches(index, [" ".join(["x"] * 50 + item + ["y"] * 50), " ".join(item[:40]), "x"])
    assert [sorted((i, d) for i, d, *_ in rows) for rows in found] == [[(1, 0), (2, 0)], [(2, 0)], []]


def test_decontamination_with_repeated_items_and_clashing_columns(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "nothing here"), (1, f"x {passage} y")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("item_id", "distance", "item_words")})
    items = spark.createDataFrame([(7, passage), (7, passage + " iota"), (7, passage), (8, passage)], "item_id long, text string")
    items = items.withColumns({c: F.lit("x") for c in ("doc_id", "n_chars", "lang")})
    found = [tuple(r)[:3] for r in decontaminate.contamination(docs, items).collect()]
    assert sorted(found) == [(1, 7, 0), (1, 7, 0), (1, 8, 0), (1, 8, 0)]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()] == [2]


# -- 7: chat -------------------------------------------------------------------------------


def test_chat_round_trip_and_attachments(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    turns = [
        (1, 0, "user", [part("text", "see <|image|> \\ <\\|x"), part("image", ref="a.png", units=1568.0), None, part("audio", ref="b.wav", units=2.0)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", units=3.0), part("text", "<|im_end|>\nok<")]),
        (1, 2, "odd\nrole\\", []),
        (None, None, None, None),
    ]
    frame = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    chunks = {(r["conv_id"], r["turn"]): r for r in chat.format_turns(frame).collect()}
    first = chunks[1, 0]
    assert (first["refs"], first["kinds"], first["tokens"]) == (["a.png", "b.wav"], ["image", "audio"], [2, 50])
    assert [first["chunk"][p : p + 6] for p in first["places"]] == ["<|imag", "<|audi"]
    assert chat.read_chunk(first["chunk"] + chunks[1, 2]["chunk"])[1] == ("odd\nrole\\", "")
    for text in ("<|im_end|>", "<\\|", "<\\\\|im|>", "a<", "<|<|"):
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    assert back[1]["n_turns"] == 3 and back[1]["media_tokens"] == 2 + 50 + 768 and back[None]["n_turns"] == 1
    assert back[1]["loss_sha256"] == hashlib.sha256("<|document|><|im_end|>\nok<".encode()).hexdigest()
    assert chat.read_back(chat.format_turns(frame.limit(0))).collect() == []
    cut = [(2, 0, "user", [part("text", "a<"), part("text", "|im_end|>\nb"), part("image", ref="i", units=1.0), part("text", "|")])]
    chunk = chat.format_turns(spark.createDataFrame(cut, frame.schema)).first()["chunk"]
    assert chat.read_chunk(chunk) == [("user", "a<|im_end|>\nb<|image|>|")]


def test_chat_typed_parts_come_back(spark):
    """Random parts: literal placeholders stay text, attachments keep kind, reference and order."""
    rng = random.Random(8)
    texts = ["<|image|>", "<|im_end|>\n", "<\\|audio|>", "<", "|image|>", "plain", "", None, "a\nb", "\\"]
    rows, want = [], {}
    for turn in range(300):
        parts, back = [], []
        for _ in range(rng.randint(0, 5)):
            kind = rng.choice(["text", "text", None, "image", "audio", "document", "video"])
            if kind in ("text", None):
                text = rng.choice(texts)
                parts.append((kind, text, None, None))
                if back and back[-1][0] == "text":
                    back[-1] = ("text", back[-1][1] + (text or ""), None)
                else:
                    back.append(("text", text or "", None))
            else:
                ref = rng.choice(["r1", "<|x|>", None])
                parts.append((kind, None, ref, 1000.0))
                back.append((kind if kind != "video" else "document", None, ref or ""))
        role = rng.choice(["user", "assistant", "odd\nrole\\<|im_end|>"])
        rows.append((1, turn, role, parts))
        want[turn] = role, [b for b in back if b[0] != "text" or b[1]]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    found = chat.read_turns(chat.format_turns(frame)).collect()
    assert {r["turn"]: (r["role"], [(p["kind"], p["text"], p["ref"]) for p in r["parts"]]) for r in found} == want
    assert {p["tokens"] for r in found for p in r["parts"] if p["kind"] == "image"} == {2}
    assert chat.read_turns(chat.format_turns(frame.limit(0))).collect() == []


# -- 8: WARC -------------------------------------------------------------------------------


def test_warc_archive_is_a_zstd_file(spark):
    import zstandard

    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>{'word ' * 40}{i % 7}</p>") for i in range(60)]
    rows += [(60, None, None), (61, None, ""), (62, "u", "x"), (63, "u", "x"), (None, "u", rows[0][2]), (0, "u", rows[0][2]), (64, "u", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    archive = stored(warc.write_archive(pages), "test")
    back = warc.read_archive(archive).collect()
    assert len(back) == len(rows)
    for file in {r["file"] for r in archive.select("file").collect()}:
        frames = [bytes(r["frame"]) for r in archive.where(F.col("file") == file).orderBy("seq").collect()]
        words = zstandard.ZstdCompressionDict(frames[0][8:])
        data = zstandard.ZstdDecompressor(dict_data=words).stream_reader(b"".join(frames[1:]), read_across_frames=True).read()
        assert data.count(b"WARC/1.1\r\n") == len(frames) - 1
    text = {i: h or "" for i, _, h in rows if i}
    for r in back:
        if r["page_id"]:
            assert r["payload_bytes"] == len(text[r["page_id"]].encode())
            assert r["refers_to"] == (None if r["page_id"] > 59 or r["page_id"] < 7 else r["page_id"] % 7)
            if r["record_type"] == "response":
                assert bytes(r["payload"]).decode() == text[r["page_id"]]
    assert [r["refers_to"] for r in back if r["page_id"] is None] == [0]
    assert warc.read_archive(stored(warc.write_archive(pages.limit(0)), "test")).collect() == []


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_warc_copies_by_both_ways(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast_bytes)
    page = lambda i: ["short", None, "a" * 100, "b" * 200, f"own {i} " * 30][i % 5]
    rows = [(None if i % 11 == 0 else i, f"https://x/{i}", page(i)) for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "salt", "first")})
    archive = stored(warc.write_archive(pages), "warc-both")
    got = [(r["url"], r["record_type"], r["refers_to"]) for r in warc.read_archive(archive).collect()]
    least = {}
    for page_id, _, html in rows:
        if page_id is not None and html and len(html) >= 100:
            least[html] = min(page_id, least.get(html, page_id))
    want = [(u, "revisit", least[h]) if h in least and sum(x[2] == h for x in rows) > 1 and i != least[h] else (u, "response", None) for i, u, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    plan = warc.write_archive(pages)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan or not broadcast_bytes


# -- 9: mixing -----------------------------------------------------------------------------


def test_mixing_schedules_and_awkward(spark, awkward):
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.5, 2.0), (1.0, 1.0))):
        shares = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
        frame = spark.createDataFrame([(s,) for s in shares], "s double")
        for s, row in zip(shares, frame.select(mixing.inverted(schedule, F.col("s")).alias("t")).collect()):
            knots = [k for k in schedule if k[0] < row["t"]]
            upto = mixing.integral([*knots, (row["t"], np.interp(row["t"], *zip(*schedule)))]) if knots else 0.0
            assert abs(upto - s * mixing.integral(schedule)) < 1e-9
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    taken: dict = {}
    for r in rows:
        taken.setdefault((r["source_size"], r["target"]), 0)
        taken[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(got - target) <= 1 for (_, target), got in taken.items())
    assert mixing.mix(awkward.limit(0)).collect() == []


def test_mixing_places_every_taken_pass(spark):
    rows = [(i, "w " * (i % 5 + 1), "small") for i in range(20)] + [(100 + i, "w " * 50, "t") for i in range(20)]
    even = (((0.0, 1.0), (1.0, 1.0)),)
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), even)
    small = [r for r in mixed.collect() if r["doc_id"] < 100]
    words = round(small[0]["target"])
    assert words == 3 * small[0]["source_size"] and all(len(r["positions"]) == 3 for r in small)
    passes = mixing.training_passes(mixed).collect()
    assert [r["position"] for r in passes] == sorted(r["position"] for r in passes)
    for got in ([r for r in passes if r["doc_id"] < 100], [r for r in passes if r["doc_id"] >= 100]):
        # Under an even schedule the passes fill 0 to 1 without gaps, one after the other.
        total, begin = sum(r["words"] for r in got), 0
        for r in got:
            assert abs(r["position"] - (begin + r["words"] / 2) / total) < 1e-9
            begin += r["words"]
    assert sum(r["words"] for r in passes) == sum(r["taken"] for r in mixed.collect())


def test_mixing_plan_is_native(spark, sf_dir):
    plan = mixing.training_order(mixing.mix(table(spark, sf_dir, "documents")))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# -- 10: licenses --------------------------------------------------------------------------


def test_license_filters_lose_nothing():
    random.seed(8)
    words = [w for text, _ in licenses.TEMPLATES for w in text.split()] + ["other", "words"]
    frequency = {w.encode(): random.randint(0, 50) for w in words}
    for text, label in licenses.TEMPLATES:
        template = licenses.Template(text, label, frequency, 0.8)
        own = {w.encode() for w in text.split()}
        for _ in range(200):
            block = {w for w in own if random.random() < 0.85} | {random.choice(words).encode() for _ in range(5)}
            share = len(block & own) / len(own)
            assert template.containment(block) == (share if len(block & own) >= template.least else 0.0)
            if share >= 0.8:
                assert block & set(template.prefix)


def test_license_sentences_wrapped_over_lines(spark):
    wrapped = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\n"
         "of this software and associated documentation files (the \"Software\"), to deal\n", "mit"),
        ("# you may not use this file except in compliance with the License.\n"
         "# You may obtain a copy of the License at\n", "apache-2"),
        ("Redistribution and use in source and binary forms, with or without\n"
         "modification, are permitted provided that the following conditions are met:\n", "bsd"),
        ("This program is free software: you can redistribute it and/or modify\n"
         "it under the terms of the GNU General Public License as published by\n", "gpl"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n"
         "License, v. 2.0. If a copy of the MPL was not distributed with this\n", "mpl-2"),
        # The same words far apart are no sentence.
        ("all of it\n" + "other words stand here\n" * 20 + "rights are kept\n" + "and more\n" * 20 + "reserved seats", ""),
    ]
    docs = spark.createDataFrame([(i, "Title\n\n" + text) for i, (text, _) in enumerate(wrapped)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(len(wrapped))] == [label for _, label in wrapped]
    assert all(got[i]["score"] >= 0.8 for i in range(5)) and got[5]["score"] == 0.0


def test_license_gpl_sentence(spark):
    text = "This work is licensed under the GNU General\nPublic License, version 3."
    docs = spark.createDataFrame([(1, text), (2, text.replace("\n", " "))], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    assert [(r["labels"], r["score"]) for r in rows] == [("gpl", 1.0)] * 2


def test_license_awkward(spark, awkward):
    rows = licenses.scan(awkward).collect()
    assert len(rows) == awkward.count()
    row = next(r for r in rows if r["doc_id"] == 8)
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (2, 0, 7, "apache-2,mit")
    assert licenses.scan(awkward.limit(0)).collect() == []
