"""Source divergence against the definition, also for odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyline.llm import divergence as module
from tallyline.llm.divergence import divergence, joint_values


def found_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_force(rows, least, top):
    """(lang, source, part, item) -> (value, rank)."""
    times, often, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = found_terms(text)
        langs[lang].add(source)
        times[lang, source].update(found)
        often[lang].update(found)
        docs[lang].update(set(found))
    out = {}
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def price(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept}

        own, whole = {s: price(times[lang, s]) for s in sources}, price(often[lang])
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            above = [(own[s][t] - whole[t], t) for t in kept if times[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", above)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found[: top if part == "term" else None], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def result(frame):
    rows = frame.collect()
    found = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("part", [1, 7, 1000, 1 << 20])
def test_terms_of_any_text(monkeypatch, part):
    monkeypatch.setattr(module, "PART", part)
    text = "Ab_cd ÉTÉ-日本 [x]{y}\x00z\x7f9 " * 50
    for texts in ([text], [""], ["-"], ["a"], ["x" * 20], [text, "", "b a b", " z\t"]):
        batch = pa.record_batch([pa.array(["skipped", *texts])], ["text"]).slice(1)
        terms, row, code, n = module._of_slice(batch)
        got = {(r, terms[c].as_py()): k for r, c, k in zip(row.tolist(), code.tolist(), n.tolist(), strict=True)}
        want = Counter((r, t) for r, x in enumerate(texts) for t in found_terms(x))
        assert got == dict(want)


@pytest.mark.parametrize("tile", [1, 3, 16, 2048])
def test_joint_tables_give_the_sums(tile):
    rng = np.random.default_rng(tile)
    level = rng.poisson(2, (300, 7)) * rng.integers(0, 2, (300, 7))
    cost = 10 + level * rng.integers(1, 50, 7)
    want = np.abs(cost[:, :, None] - cost[:, None, :]).sum(0)
    assert (joint_values(level, cost, tile) == np.triu(want, 1)).all()


def test_groups_of_any_kind(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = np.array(["Alpha", "beta", "ça", "日本", "the", "Z", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]])
    rows = [
        (" ".join(rng.choice(words, rng.integers(0, 60), p=None)), ["en", "de", None][i % 3], f"s{rng.integers(0, 5)}" if i % 2 else "hot")
        for i in range(400)
    ]
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("1 2 3", "xx", None), ("once only", "yy", "a"), (None, None, None), (None, "en", "bare")]
    rows += [("the " * 20_000, "en", "s1")] * 2
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, p long, term string").repartition(3)
    monkeypatch.setattr(module, "ENTRIES", 64)
    monkeypatch.setattr(module, "HELD", 50)
    got = result(divergence(frame, least=20, top=7))
    assert got == brute_force(rows, 20, 7)
    assert ("xx", "a", "pair", "") in got and got["xx", "a", "pair", "b"] == (0, 2)


def test_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert result(divergence(odd, least=2)) == brute_force(rows, 2, 50)
    assert divergence(none).collect() == []
