import random

import numpy as np

from braidwork.llm.leakage import LeakRules, align, common_in_order, leaked_items, longest_run

WORDS = [f"w{i}" for i in range(400)]


def slow(item, doc):
    run = 0
    for i in range(len(item)):
        for j in range(len(doc)):
            k = 0
            while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k]:
                k += 1
            run = max(run, k)
    h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == doc[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return run, max(map(max, h))


def test_alignment_like_the_textbook():
    rnd = random.Random(2)
    for _ in range(60):
        a, b = [rnd.randrange(4) for _ in range(rnd.randint(0, 9))], [rnd.randrange(4) for _ in range(rnd.randint(0, 12))]
        run, matched = align(np.array(a, dtype=int), np.array(b, dtype=int))
        r, best = slow(a, b) if a and b else (0, 0)
        assert longest_run(a, b) == r and common_in_order(a, b) >= matched
        assert run == r and (best + 1) // 2 <= matched <= min(len(a), len(b)) if best else matched == 0


def data(spark):
    rnd = random.Random(4)
    item = [rnd.choice(WORDS) for _ in range(40)]
    other = [rnd.choice(WORDS) for _ in range(40)]
    fill = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    changed = [w if i % 8 else "changed" for i, w in enumerate(item)]
    docs = [
        (1, fill(50) + " " + " ".join(item) + " " + fill(5)), (2, fill(9) + " " + " ".join(item[5:18]) + "! " + fill(30)), (3, fill(9) + " " + " ".join(item[5:17]) + " zz " + fill(30)),
        (4, " ".join(changed)), (5, "<p>" + " ".join(f"<b>{w}</b>," for w in item).upper() + "</p>"), (6, " ".join(w[0] + "​" + w[1:] for w in item)), (7, fill(300)), (8, None), (9, ""), (10, " ".join(item[:7])),
        (11, fill(20_000) + " " + " ".join(item)), (1, fill(3)),
    ]
    items = [(100, " ".join(item), None), (101, " ".join(other), "x"), (102, None, None), (103, "", None), (104, "w1 w2", None)]
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, item_text string, answer string")


def test_leaks(spark):
    docs, items = data(spark)
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs.where("doc_id <> 1 or length(text) > 100"), items).collect()}
    assert {x for x in got if x[1] != 104} == {(d, 100) for d in (1, 2, 4, 5, 6, 11)}
    by_shuffle = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs.where("doc_id <> 1 or length(text) > 100"), items, LeakRules(max_broadcast=0)).collect()}
    assert by_shuffle == got


def test_empty(spark):
    docs, items = data(spark)
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_altered_copies_by_density(spark):
    """Items of one template, each with words of its own; every k-th word of a copy is altered."""
    rnd = random.Random(8)
    frame = [rnd.choice(WORDS) for _ in range(30)]
    items = {i: [w for a, b in zip(frame, [rnd.choice(WORDS) for _ in range(30)]) for w in (a, b)] for i in range(12)}
    docs, want, n = [], set(), 0
    for k in range(3, 9):
        for i, item in items.items():
            n += 1
            docs.append((n, " ".join([rnd.choice(WORDS) for _ in range(60)] + [f"x{j}" if j % k == k - 1 else w for j, w in enumerate(item)] + [rnd.choice(WORDS) for _ in range(200)])))
            want.add((n, i))
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(100, " ".join(items[0]))], "item_id bigint, item_text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert {x for x in found if x[1] != 100} == want and {d for d, i in found if i == 100} == {d for d, i in want if i == 0}
