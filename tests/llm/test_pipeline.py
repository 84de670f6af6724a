"""Every stage acts on what the one before kept; awkward rows pass."""

import math
import re

import corpus_pipeline
from abstracta.llm import decontaminate, toxicity
from abstracta.llm.common import stored
from abstracta.llm.queries import toxicity_model
from abstracta.session import table
from test_operators_llm import brute_components, brute_fingerprint, brute_kept


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] > counts[4] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_awkward_rows_pass_every_stage(spark, sf_dir, awkward):
    for docs in (awkward, awkward.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, sf_dir)
            assert name == "mixing" or kept.columns == awkward.columns
            docs = stored(kept, name)


def rows_of(frame):
    return sorted((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())


def test_every_stage_keeps_what_brute_force_keeps(spark, sf_dir):
    """Ids and whole texts after each filtering stage, from plain re-computations; then the mix."""
    stages = dict(corpus_pipeline.STAGES)

    def clean_rows(folder):
        docs = table(spark, folder, "documents")
        model = toxicity_model(docs, table(spark, folder, "labels"))
        decoder = toxicity.Decoder(model.costs)
        odds = lambda text: model.prior + sum(model.weights.get(m, 0.0) for m in toxicity.marks(decoder.restored(text or "")))
        return docs, [(i, t) for i, t in rows_of(docs) if 1 / (1 + math.exp(-odds(t))) < toxicity.THRESHOLD]

    larger = sf_dir.replace("0.001", "0.01")  # the smaller table has too few labels to learn from
    docs, clean = clean_rows(larger)
    assert rows_of(stages["toxicity"](spark, docs, larger)) == clean and len(clean) < docs.count()
    items = [(r["item_id"], decontaminate.words_of(r["text"])) for r in table(spark, sf_dir, "benchmark").collect()]

    docs, clean = clean_rows(sf_dir)
    docs = stored(stages["toxicity"](spark, docs, sf_dir), "brute")
    assert rows_of(docs) == clean

    parts = brute_components([brute_fingerprint(t or "") for _, t in clean], 4)
    single = [row for n, row in enumerate(clean) if parts[n] == n]
    docs = stored(stages["simhash_near_dedup"](spark, docs, sf_dir), "brute")
    assert rows_of(docs) == single and len(single) < len(clean)

    cut = sorted((i, bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")) for i, data, gone in brute_kept(single))
    docs = stored(stages["suffix_dedup"](spark, docs, sf_dir), "brute")
    assert rows_of(docs) == cut and cut != single

    def leaked(text):
        words = decontaminate.words_of(text)
        return any(decontaminate.edit_matches(item, words)[0] <= int(0.2 * len(item) + 1e-9) for _, item in items if len(item) >= 5)

    fair = [(i, t) for i, t in cut if not leaked(t)]
    docs = stored(stages["decontamination"](spark, docs, sf_dir), "brute")
    assert rows_of(docs) == fair and len(fair) < len(cut)

    order = {r["doc_id"]: r for r in stages["mixing"](spark, docs, sf_dir).collect()}
    assert sorted(order) == [i for i, _ in fair]
    for doc_id, text in fair:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert order[doc_id]["size"] == size and order[doc_id]["taken"] <= 3 * size
        assert len(order[doc_id]["positions"] or []) == -(-order[doc_id]["taken"] // size if size else 0)
