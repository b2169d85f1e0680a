import random

from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm.leakage import Items, common, distance, leaked_items, plain_words, whole_distance

WORDS = "amber bridge candle dormer engine ferry garden harbor island jacket kettle lantern meadow needle orchard pillow quarry ribbon saddle timber upland valley window yellow".split()


def levenshtein(a, b, free):
    """Whole a against b; with free, against any part of b."""
    row = [0] * (len(b) + 1) if free else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) if free else row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=20))
def test_bit_parallel_distances(a, b):
    masks = [sum(1 << i for i, x in enumerate(a) if x == y) for y in b]
    assert distance(len(a), masks) == levenshtein(a, b, True)
    assert whole_distance(a, b) == levenshtein(a, b, False)
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
    assert common(len(a), masks) == lcs[-1][-1]


def item(seed=1, n=50):
    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(["", "s", "ly"]) for _ in range(n)]


def held(text, words):
    return Items([(7, " ".join(words))]).found([text]) == [[0]]


def test_layouts_and_edits():
    w = item()
    part = w[10:34]
    filler = ["nothing", "of", "this", "kind"] * 30
    assert held(" ".join(filler + part + filler), w)
    assert held(" ".join(filler + [x.upper() + "," for x in part]), w)
    assert held("<p>" + "<br/>\n".join(f"**{x}**" for x in part) + "</p>", w)
    assert held(" ".join(x[:2] + "­" + x[2:] for x in part), w)
    assert held(" ".join(x.replace("a", "а").replace("e", "е") for x in part), w)
    assert held(" ".join(x[0] + x[2] + x[1] + x[3:] if i % 3 == 0 else x for i, x in enumerate(part)), w)
    assert held(" ".join(y for i, x in enumerate(part) for y in ([x, "really"] if i % 6 == 0 else [x])), w)


def test_none():
    w = item()
    shuffled = w[:]
    random.Random(3).shuffle(shuffled)
    assert not held(" ".join(shuffled), w)
    assert not held(" ".join(w[:10]), w)
    assert not held(" ".join(w[:10] + ["far"] * 400 + w[30:40]), w)
    assert not held("", w) and not held(None, w)


def test_short_items_within_the_budget():
    for n in (1, 2, 5, 6, 8, 10, 12, 15, 20, 25, 31):
        for seed in range(60):
            r = random.Random(seed * 31 + n)
            w = [r.choice(WORDS) + r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n)]
            size = -(-2 * n // 5) if n > 5 else n
            budget, s = int(0.4 * size), r.randint(0, n - size)
            part = w[s : s + size]
            spread = [int((i + 0.5) * size / budget) for i in range(budget)] if seed % 2 else r.sample(range(size), budget)
            for i in spread:
                part[i] = f"qq{i}qq"
            assert held(" ".join(["zz"] * 50 + part + ["yy"] * 50), w), (n, seed)


def test_blocks(spark, monkeypatch):
    import codeweft.llm.leakage as L

    monkeypatch.setattr(L, "BLOCK", 7)
    all_ = [item(seed) for seed in range(30)]
    docs = spark.createDataFrame([(i, " ".join(w[5:40])) for i, w in enumerate(all_)], "doc_id bigint, text string")
    items = spark.createDataFrame([(100 + i, " ".join(w)) for i, w in enumerate(all_)], "item_id bigint, text string")
    got = {tuple(r) for r in leaked_items(docs, items).collect()}
    assert {(i, 100 + i) for i in range(30)} <= got and len(got) < 40


def test_frames(spark):
    w = " ".join(item())
    docs = spark.createDataFrame([(1, w, "x"), (1, w, "x"), (2, None, "x"), (3, "", "x"), (None, w, "x"), (4, "word " * 50_000 + w, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, w, "a"), (8, w, "b"), (9, None, "c"), (10, "  ", "d"), (None, w, "e")], "item_id bigint, text string, doc_id string")
    assert sorted(map(tuple, leaked_items(docs, items).collect())) == [(1, 7), (1, 8), (4, 7), (4, 8)]
    assert leaked_items(docs.limit(0), items).count() == 0
    assert leaked_items(docs, items.limit(0)).count() == 0
    assert plain_words("A&amp;B <b>c</b> d_e-\nf") == ["a", "b", "c", "d", "ef"]
