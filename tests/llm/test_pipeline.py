"""Each stage of the pipeline and all of them, against brute force on a small sample."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tallyline.llm.queries import tokenizer
from .test_decontaminate import brute_force as contaminated
from .test_hyperminhash import brute_force as groups

FOLDER = "/root/testdata/sf0.001"


def lines_left(docs):
    """Texts after line dedup, by definition; None where nothing is left."""
    seen, gone = set(), {}
    for i, text in sorted(docs):
        raw = text.split("\n")
        shown = [(at, line.strip(" \t\r")) for at, line in enumerate(raw) if line.strip(" \t\r")]
        for n in range(max(1, len(shown) - 2) if shown else 0):
            part = shown[n : n + 3]
            key = tuple(line for _, line in part)
            if key in seen:
                gone.setdefault(i, set()).update(range(part[0][0], part[-1][0] + 1))
            seen.add(key)
    out = {}
    for i, text in docs:
        kept = "\n".join(line for at, line in enumerate(text.split("\n")) if at not in gone.get(i, ()))
        if i not in gone or kept.strip():
            out[i] = kept
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            want = {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
            assert len(got) >= 0.99 * len(want) and got.items() <= want.items()
        elif name == "line_dedup":
            assert got == lines_left(list(texts.items()))
            assert all(r.n_chars == len(r.text) for r in docs.collect() if texts[r.doc_id] != r.text)
        elif name == "minhash_near_dedup":
            label = groups(list(texts.items()), 80)
            assert set(got) == {i for i, (_, c) in label.items() if i == c}
        else:
            assert set(got) == {i for i, t in texts.items() if not contaminated(t, items)[1]}
        docs, texts = spark.createDataFrame(docs.collect(), docs.schema), got
    assert 0 < len(texts) < 200
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    joined = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        joined[p.doc_id] = joined.get(p.doc_id, b"") + p.ids
    assert joined == {
        i: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t in texts.items()
    }


def test_stages_on_odd_documents(spark, odd, none):
    """Nulls, empty texts, repeated rows, clashing names and empty tables, stage by stage."""
    clashing = odd.selectExpr("*", "2 AS n_removed", "3 AS N_Lines", "4 AS kept", "5 AS spans", "6 AS found", "7 AS item")
    texts = {
        "language_id": lambda t: t and any(c.isalpha() for c in t),
        "line_dedup": lambda t: True, "minhash_near_dedup": lambda t: True, "decontamination": lambda t: True,
    }
    for docs in (odd, clashing, none, clashing.where("false")):
        rows = docs.collect()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, FOLDER)
            assert got.columns == docs.columns and got.schema.fieldNames() == docs.schema.fieldNames()
            kept = got.collect()
            left = {(r.doc_id, r.text) for r in kept}
            want = {(r.doc_id, r.text) for r in rows if texts[name](r.text)}
            if name == "minhash_near_dedup":
                want -= {(7, "the same words stand in each of these rows today")}
                assert len(kept) == len(want)
            elif name == "line_dedup":
                # The second document with the same line has nothing left.
                want -= {(7, "the same words stand in each of these rows today")}
            assert left == want
            if rows and "kept" in docs.columns:
                assert {(r.n_removed, r.N_Lines, r.kept, r.spans, r.found, r.item) for r in kept} == {(2, 3, 4, 5, 6, 7)}
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}
    assert corpus_pipeline.lines(spark, odd.drop("n_chars"), FOLDER).columns == odd.drop("n_chars").columns
