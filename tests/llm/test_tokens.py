"""Token counts and packing against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyline.llm import tokenizing
from tallyline.llm.packing import arranged, differencing, pack
from tallyline.llm.queries import tokenizer
from tallyline.llm.token_counts import count_tokens, frequent_lengths
from tallyline.llm.tokenizing import SAFE, Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = [
    "", " ", "\n\n a  b\t", "Don't we'll 'STOP ''s it's", "x<|endoftext|>y <|startoftext|>", "日本語 und Ελλάς ΑΣ", "été été",
    "1234 5,6 ²³½", "tab\tand no-break line", "emoji 😀😀 \x00\x1c\x1f\x85 end", "a" * 300, "-- !!  ?\r\n\r\n",
]


@pytest.mark.parametrize("name", FILES)
def test_same_ids_as_the_library(name):
    library = Tokenizer.from_file(tokenizer(name))
    encoder = Encoder(open(tokenizer(name), encoding="utf-8").read(), cached=10)
    # Every character that is cut here, in every kind of neighbourhood.
    probes = [
        "".join(f"a{c}1{c}!{c} '{c} {c}{c}Z\n{c}  {c}'s{c}" for c in map(chr, SAFE[i : i + 40])) for i in range(0, len(SAFE), 40)
    ]
    assert encoder.cut is not None and all(encoder.pieces(p) is not None for p in probes)
    for texts in (probes, TEXTS, TEXTS[::-1], probes):
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_counts(spark, odd, none):
    library = Tokenizer.from_file(tokenizer(FILES[0]))
    frame = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*TEXTS, None])], "doc_id int, text string, N_Bytes string")
    for known in (None, {}, {"a": 1}):
        rows = count_tokens(frame, tokenizer(FILES[0]), limit=10, known=known).collect()
        for r in rows:
            many = len(library.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), many, many > 10)
    got = count_tokens(odd, tokenizer(FILES[0])).collect()
    assert [r.n_tokens for r in got] == [len(library.encode(r.text or "").ids) for r in got]
    assert count_tokens(none, tokenizer(FILES[0])).collect() == []


def test_texts_of_other_scripts_are_counted_through_the_tables(spark):
    texts = ["東京都は日本の首都です。人口は約1400万人", "مرحبا بالعالم، كيف حالك؟", "שלום עולם 12", "한국어 문장입니다 😀🎉", "ภาษาไทย"]
    library = Tokenizer.from_file(tokenizer(FILES[0]))
    encoder = Encoder(open(tokenizer(FILES[0]), encoding="utf-8").read())
    assert all(encoder.pieces(t) is not None for t in texts)
    got = count_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), tokenizer(FILES[0])).collect()
    assert {r.text: r.n_tokens for r in got} == {t: len(library.encode(t).ids) for t in texts}


def test_the_table_has_pieces_of_the_vocabulary():
    content = open(tokenizer(FILES[0]), encoding="utf-8").read()
    library, found = Tokenizer.from_file(tokenizer(FILES[0])), frequent_lengths(content, 20_000)
    assert len(found) == 20_000 and {" the", "ing", ",", "\n"} < set(found)
    assert all(len(library.encode(piece).ids) == many for piece, many in found.items())
    assert "hello" in frequent_lengths(open(tokenizer(FILES[1]), encoding="utf-8").read())


def test_no_pre_token_is_shuffled(spark, odd, capsys):
    count_tokens(odd, tokenizer(FILES[0])).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_differencing():
    assert sorted(np.bincount(differencing([8, 7, 6, 5, 4], 2)[0], [8, 7, 6, 5, 4])) == [14, 16]
    rng = np.random.default_rng(1)
    for k in (1, 2, 7, 40):
        sizes = rng.integers(1, 900, 300).tolist()
        window, most = differencing(sizes, k)
        filled = np.bincount(window, sizes, minlength=k)
        assert filled.max() == most and len(filled) == k
        assert most - filled.min() <= 3 or k == 40


@pytest.mark.parametrize("sizes", [[1], [4096], [2500] * 50, [4095] * 9, [1] * 500, [4000, 90, 3, 3, 2000, 2096, 17]])
def test_windows_hold_what_they_can(sizes):
    pieces = arranged(sizes, 4096)
    filled, lengths = {}, dict.fromkeys(range(len(sizes)), 0)
    for item, start, length, window in sorted(pieces):
        assert start == lengths[item] and length > 0
        lengths[item] += length
        filled[window] = filled.get(window, 0) + length
    assert list(lengths.values()) == sizes and max(filled.values()) <= 4096
    assert len(filled) <= -(-sum(sizes) // 4096) * 1.02 + 1


def test_pieces_are_the_documents_ids(spark, odd, none):
    library = Tokenizer.from_file(tokenizer(FILES[1]))
    texts = [*TEXTS, None, "many words " * 5000] + [f"text number {i} " * (i % 90) for i in range(1500)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    rows = pack(frame, tokenizer(FILES[1])).collect()
    ids = [e.ids + [2] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    at, filled = dict.fromkeys(range(len(texts)), 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids[r.doc_id][r.start : at[r.doc_id]], "<u4").tobytes())
    assert list(at.values()) == [len(x) for x in ids]
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
    assert sum(filled.values()) > 0.95 * 4096 * (len(filled) - 3)
    assert sum(r.length for r in pack(odd, tokenizer(FILES[1])).collect()) == sum(
        len(library.encode(r.text or "").ids) + 1 for r in odd.collect()
    )
    assert pack(none, tokenizer(FILES[1])).collect() == []


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_windows_are_full_however_rows_are_split(spark, partitions):
    texts = [f"some words of number {i} " * (7 * i % 190 + 1) for i in range(200)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(partitions)
    rows = pack(frame, tokenizer(FILES[1])).collect()
    tokens = sum(r.length for r in rows)
    assert tokens / 4096 / len({r.sequence_id for r in rows}) > 0.95
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_near_texts_are_cut_as_others():
    near = "".join(map(chr, (c for c in tokenizing.SAFE if c < 0x10000 and ord(chr(c).lower()) < 0x10000)))
    mixed = " ".join(near[i : i + 7] for i in range(0, len(near), 7)) + " it's  we'll 12ab,\n\n x"
    for text in (near, mixed, near[::-1], mixed[::-1]):
        assert tokenizing._FAR.search(text) is None
        assert tokenizing.BYTE_LEVEL_NEAR.findall(text) == tokenizing.BYTE_LEVEL.findall(text)
        lower = text.lower()
        assert tokenizing._FAR.search(lower) is None
        assert tokenizing.WORD_ENDS_NEAR.findall(lower) == tokenizing.WORD_ENDS.findall(lower)
    assert tokenizing._FAR.search("a \U0001d400") and tokenizing._FAR.search("é")
