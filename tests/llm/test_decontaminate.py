import random
import re

import numpy as np

from wordloom.llm import decontaminate as D
from wordloom.llm import queries
from tests.llm.conftest import rows

ITEM = "what is the boiling point of water at the summit of the highest mountain in the western range of hills"


def search(text, items=((7, ITEM),), **kw):
    return D.Seeds(items, **kw).search([text])[0]


def test_whole_part_and_changed_words():
    pre, post = "some words before it ", " and some words after it"
    n = len(ITEM.split())
    assert search(pre + ITEM + post) == [(7, 4, 4 + n, n)]
    assert search(ITEM.upper().replace(" ", ", ")) == [(7, 0, n, n)]
    part = " ".join(ITEM.split()[3:15])
    assert search(pre + part + post)[0][3] == 12
    changed = ITEM.split()
    for i in (4, 10, 16):
        changed[i] = "zzz"
    hit = search(pre + " ".join(changed) + post)
    assert hit and hit[0][2] - hit[0][1] >= D.MIN_WORDS and hit[0][3] >= 0.8 * (hit[0][2] - hit[0][1])


def test_short_overlaps_and_short_items():
    assert search("a " + " ".join(ITEM.split()[:8]) + " b") == []
    assert search("so: red green blue white black.", ((1, "Red green blue white black"),)) == [(1, 1, 6, 5)]
    # items of a few words are found whole
    assert search("red green blue white", ((1, "Red green blue white"),)) == [(1, 0, 4, 4)]
    assert search("so red, green: blue", ((1, "Red green"), (2, "red blue"), (3, "..."))) == [(1, 1, 3, 2)]
    assert search("red green blue white pink", ((1, "Red green blue white black"),)) == []


def test_overlaps_do_not_cross_documents():
    w = ITEM.split()
    found = D.Seeds([(7, ITEM)]).search([" ".join(w[:7]), " ".join(w[7:14]), " ".join(w[14:])])
    assert found == [[], [], []]


def test_equal_items_count_as_the_smallest_id():
    assert search(ITEM, ((9, ITEM), (3, ITEM + "?")))[0][0] == 3


def test_any_tenth_word_changed_is_still_found():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    missed = 0
    for k in range(200):
        item = rng.choices(words, k=20)
        text = list(item)
        for i in rng.sample(range(20), 2):
            text[i] = "changed"
        missed += not D.Seeds([(k, " ".join(item))]).search([" ".join(rng.choices(words, k=30) + text)])[0]
    assert missed <= 6


def test_edge_rows_and_empty_tables(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "the river runs past the old mill and the children of the village play"),
                                   (2, None), (None, "x y z u v w"), (3, "")], "item_id long, text string")
    out = D.find_overlaps(edge_docs, bench).collect()
    assert len(out) == len(rows())
    for r in out:
        assert bool(r["hits"]) == ("river" in (r["text"] or ""))
    assert D.find_overlaps(no_docs, bench).count() == 0
    none = D.find_overlaps(edge_docs, bench.limit(0)).collect()
    assert len(none) == len(rows()) and not any(r["hits"] for r in none)


def test_slices_together_equal_one_pass(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")

    def run():
        return {r["doc_id"]: sorted(map(tuple, r["hits"]))
                for r in D.find_overlaps(docs, bench, keep=["doc_id"]).collect()}

    one = run()
    monkeypatch.setattr(D, "SLICE_BYTES", 2_000)
    assert run() == one


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"

    def norm(t):
        return " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "

    items = [norm(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()
            if any(i in norm(r["text"]) for i in items)}
    got = queries.op6_decontaminate(spark, sf).collect()
    assert {r["doc_id"] for r in got if r["contaminated"]} == want and want


def test_spread_changes_of_whole_items_are_found():
    for n, at, end, same in ((20, (4, 9, 14), 21, 17), (15, (4, 9), 16, 13), (50, range(4, 50, 5), 50, 40)):
        item = [f"w{i}" for i in range(n)]
        text = ["changed" if i in at else w for i, w in enumerate(item)]
        assert search("before " + " ".join(text) + " after", ((1, " ".join(item)),)) == [(1, 1, end, same)]


def test_every_alignment_is_judged_like_brute_force():
    def allowed(equal, least):
        return any(5 * sum(equal[s:e]) >= 4 * (e - s)
                   for s in range(len(equal)) for e in range(s + least, len(equal) + 1))

    rng = random.Random(11)
    for _ in range(1500):
        n, share = rng.randint(5, 40), rng.randint(1, 20) / 100
        equal = [rng.random() >= share for _ in range(n)]
        least = min(D.MIN_WORDS, n)
        run = D.best_run(np.array(equal), least)
        assert (run is not None) == allowed(equal, least)
        if run:
            s, e, same = run
            assert e - s >= least and same == sum(equal[s:e]) and 5 * same >= 4 * (e - s)
    assert D.best_run(np.ones(9, dtype=bool), 10) is None


def test_seed_hits_are_reported_for_1_to_20_percent_changes():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    for percent in range(1, 21):
        for n in (10, 15, 20, 50):
            item = rng.choices(words, k=n)
            text = list(item)
            for i in rng.sample(range(n), n * percent // 100):
                text[i] = "changed"
            seeds = D.Seeds([(1, " ".join(item))])
            ids = np.array([seeds.vocab.get(w.encode(), 0) for w in text])
            whole = any(offset == 0 for offset, _k in seeds.alignments(ids).tolist())
            assert not whole or seeds.search([" ".join(text)])[0]


def test_repeated_words_take_linear_time():
    import time

    for item, text in ((["a"] * 1000, ["a"] * 20_000), ("a b c".split() * 300, "a b c".split() * 6000)):
        seeds = D.Seeds([(1, " ".join(item))])
        t = time.time()
        hits = seeds.search([" ".join(text)])[0]
        assert time.time() - t < 1 and hits and hits[0][3] >= len(item) - 3


def test_partial_repeated_and_changed_items_equal_brute_force():
    """Documents made of pieces of items with short periods, changed words and runs
    of one word: an item is found where some aligned window is 80 % equal and
    holds a seed."""
    rng = random.Random(21)
    letters = "a b c d".split()
    for trial in range(300):
        item = [rng.choice(letters + [f"w{rng.randrange(30)}"]) for _ in range(rng.randint(10, 30))]
        if trial % 2:
            i = rng.randrange(len(item))
            item[i:i] = [rng.choice(letters)] * rng.randint(8, 40)
        lo = rng.randrange(len(item) - 9)
        part = item[lo:lo + rng.randint(10, 30)]
        text = ["x1"] * rng.randrange(3) + part + ["x2"] * rng.randrange(3) + part[:rng.randrange(len(part))]
        for i in range(len(text)):
            if rng.random() < 0.05:
                text[i] = "changed"
        seeds = D.Seeds([(1, " ".join(item))])
        hits = seeds.search([" ".join(text)])[0]
        ids = [seeds.vocab.get(w.encode(), 0) for w in text]
        own = seeds.items[0][1].tolist()
        want = False
        for offset in range(-len(own), len(ids)):       # brute force: every alignment, seeds where a mask fits
            equal = [0 <= offset + j < len(ids) and ids[offset + j] == own[j] for j in range(len(own))]
            inside = [j for j in range(len(own)) if 0 <= offset + j < len(ids)]
            if not inside:
                continue
            window = np.array(equal[inside[0]:inside[-1] + 1])
            seeded = any(all(equal[j + c] for c in care) for m, care in enumerate(seeds.care[:len(D.MASKS)])
                         for j in range(len(own) - int(care[-1])))
            want |= seeded and D.best_run(window, min(D.MIN_WORDS, len(own))) is not None
        assert bool(hits) == want, (item, text, hits)


def test_clashing_names_and_long_repeated_text(spark):
    df = spark.createDataFrame([(1, ITEM, "a", "b", "c", 1)], "doc_id long, text string, _seed_bytes string, own string, hits string, row int")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    r = D.find_overlaps(df, bench, out_col="found").first()
    assert (r["_seed_bytes"], r["own"], r["hits"], r["row"]) == ("a", "b", "c", 1) and len(r["found"]) == 1
