import random
import re

from tallyline.llm.decontaminate import contamination, remove_contaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_force(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        told = words(item_text)
        for start in range(max(1, len(told) - window + 1) if told and item is not None else 0):
            part = told[start : start + window]
            for at in range(len(own) - len(part) + 1):
                if own[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["alpha", "beta", "gamma", "delta", "été", "x1", "straße", "omega"]

    def text(n, kinds=8):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(pool[:kinds]).title() for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30, 30])]
    items += [(10, items[9][1]), (11, ""), (12, None), (None, "alpha"), (11, text(12)), (13, "... !")]
    items[0] = (0, "zeta")
    docs = [(i, text(rng.randint(0, 60), rng.choice([2, 8]))) for i in range(60)]
    for i in range(0, 60, 3):
        item = rng.choice(items[3:10])[1]
        docs[i] = (i, docs[i][1] + "; " + item + " - " + docs[i][1])
    docs += [(60, "before zeta after zeta"), (61, None), (62, ""), (None, items[8][1]), (60, items[9][1]), (60, items[9][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "'x' AS item", "2 AS k1")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(
        ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in contamination(frame, benchmark).collect()), key=repr
    )
    want = sorted(((d, *brute_force(t, items)) for d, t in docs), key=repr)
    assert got == want
    assert sum(1 for w in want if w[2]) > 20
    kept = sorted((r.doc_id for r in remove_contaminated(frame, benchmark).collect()), key=repr)
    assert kept == sorted((w[0] for w in want if not w[2]), key=repr)


def test_odd_rows_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "a null id has these few words too"), (2, "one id")], "item_id int, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in contamination(odd, items).collect()}
    assert got[None, 8] == (8, ["1"]) and got[8, 5] == (2, ["2"]) and got[1, 0] == (0, []) and got[8, 3] == (0, [])
    assert remove_contaminated(odd, items).columns == odd.columns
    assert remove_contaminated(odd, items).count() == odd.count() - 2
    assert contamination(none, items).collect() == []
    assert all(r.n_hit == 0 for r in contamination(odd, items.limit(0)).collect())
