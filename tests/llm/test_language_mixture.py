import random

import numpy as np

from tallyline.llm.language_mixture import PENALTY, held_out, identify, judge, keep_identified, learn, mixture
from tallyline.llm.queries import op6_language_mixture

SYLLABLES = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["krz", "szy", "owt", "chn"], "cc": ["æl", "øx", "jeg", "åp"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_mixtures_are_told_apart(spark, odd, none):
    rng = random.Random(3)
    train = [(lang, prose(rng, lang, 40)) for lang in SYLLABLES for _ in range(30)]
    frame = spark.createDataFrame([*train, (None, "x"), ("aa", None)], "lang string, text string")
    model = learn(frame)
    assert model.languages == ["aa", "bb", "cc"]
    cases = [("aa", prose(rng, "aa", 30)), ("bb", prose(rng, "bb", 70) + " " + prose(rng, "cc", 30)), ("cc", prose(rng, "cc", 1))]
    told = identify(spark.createDataFrame(cases, "score string, text string"), model).collect()
    assert [r.lang_pred for r in told] == ["aa", "bb", "cc"]
    assert [[x.lang for x in r.languages] for r in told] == [["aa"], ["bb", "cc"], ["cc"]]
    assert abs(told[1].score - 0.7) < 0.05 and told[0].score == 1
    rows = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in identify(odd, model).collect()}
    assert rows[1, None] == rows[2, ""] == rows[3, " \n\t "] == rows[8, "42 + 17 = 59!"] == ("und", 0.0)
    assert len(rows) == odd.distinct().count() and rows[7, odd.collect()[7].text][0] in SYLLABLES
    assert keep_identified(odd, model, least=0.1).count() == odd.count() - 4
    assert identify(none, model).collect() == []
    empty = learn(none)
    assert {r.lang_pred for r in identify(odd, empty).collect()} == {"und"}
    assert keep_identified(odd, empty).count() == odd.count() - 4


def test_shares_maximise_the_likelihood():
    rng = np.random.default_rng(0)
    logs = np.log(rng.uniform(0.01, 1, (400, 2)))
    (share,) = judge(logs, np.array([0, 400]))
    grid = np.linspace(0, 1, 1001)
    best = grid[np.argmax([np.log(np.exp(logs) @ [g, 1 - g]).sum() for g in grid])]
    assert abs(share[0] - best) < 0.02 or share.max() == 1


def test_as_many_languages_as_there_are():
    """Six languages with equal shares, each with words of its own."""
    rng = np.random.default_rng(1)
    logs = np.log(rng.uniform(0.001, 0.05, (600, 8)))
    logs[np.arange(600), np.arange(600) % 6] = 0
    (shares,) = judge(logs, np.array([0, 600]))
    assert (shares[:6] > 0.15).all() and shares[6:].max() < 0.01


def _all_shares(logs, first):
    (shares,), _ = mixture(np.exp(logs), first, np.full((1, logs.shape[1]), 1 / logs.shape[1]))
    return shares


def test_the_set_is_the_best_of_all_sets():
    """On two to four languages, no other set is better by as much as one language costs.

    Only sets of the languages with the greatest proportions are compared, not all of them.
    """
    rng = np.random.default_rng(2)
    for kinds in (2, 3, 4):
        for truth in range(1, kinds + 1):
            many = int(rng.integers(80, 300))
            logs = np.log(rng.uniform(0.01, 0.3, (many, kinds)))
            logs[np.arange(many), rng.integers(0, truth, many)] = 0
            first = np.array([0, many])
            value = {}
            for some in range(1, 1 << kinds):
                held = np.array([some >> k & 1 for k in range(kinds)], float)
                _, found = mixture(np.exp(logs), first, (held / held.sum())[None])
                value[some] = found[0] - (held.sum() - 1) * PENALTY / 2 * np.log(many)
            (shares,) = judge(logs, first)
            chosen = sum(1 << k for k in range(kinds) if shares[k] > 0)
            assert value[chosen] >= max(value.values()) - PENALTY / 2 * np.log(many)
            nested = [sum(1 << k for k in np.argsort(-_all_shares(logs, first))[:size]) for size in range(2, kinds + 1)]
            assert value[chosen] >= max(value[some] for some in (*nested, *(1 << k for k in range(kinds)))) - 0.05


def test_held_out_accuracy(spark):
    rows = op6_language_mixture(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    told = [r.lang_pred == labels[r.doc_id] for r in rows if r.held_out and labels[r.doc_id]]
    assert len(told) > 100 and sum(told) > 0.97 * len(told)


def test_held_out_documents(spark):
    import zlib

    rows = spark.range(100).select("id", held_out("id").alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
