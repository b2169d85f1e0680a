import numpy as np
import pytest

from codeweft.llm import pii_train as T
from codeweft.llm.pii import LABELS, SYMBOLS, WEIGHTS, Finder, Model, personal_information, redact, redacted_documents, symbols, windows
from codeweft.llm.pii_grammar import candidates


@pytest.fixture(scope="module")
def finder():
    with np.load(WEIGHTS) as w:
        return Finder(Model(dict(w)))


CASES = [
    ("Signed-off-by: Marta Velindower <mvelindower@corvid.example>", [("name", "Marta Velindower"), ("email", "mvelindower@corvid.example")]),
    ("Call me on +49 (0)171 3920084 when the queue is back.", [("phone", "+49 (0)171 3920084")]),
    ("Customer gave SSN 949-04-2260 in the ticket.", [("id_number", "949-04-2260")]),
    ("Ship the replacement node to 149A Fennimoor Road, Flat 23, Mirefield QX16 9ZZ.", [("address", "149A Fennimoor Road, Flat 23, Mirefield QX16 9ZZ")]),
    ("Write to tomas [at] brack-it [dot] test if the queue is late.", [("email", "tomas [at] brack-it [dot] test")]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_found(finder, text, want):
    got = finder.found([text])[0]
    assert [(k, text[s:e]) for s, e, k in got] == want
    masked = redact(text, got)
    assert all(v not in masked and f"[{k.upper()}]" in masked for k, v in want)


@pytest.mark.parametrize("text", ["", "   ", "clone git@code.example.com:core/plan.git first", "opcode table +26 536 536 536", "The Marta Indexer service restarted twice.", "156 Worker Lane slots were free", "docs say user@<host>, replace it", "ping @ 74 ms, p99 @ 62361 ms", "firmware 614.614.33166 fails to boot"])
def test_none(finder, text):
    assert finder.found([text]) == [[]]


def test_long_texts_and_windows(finder):
    line = "Reported by Katya Bramelov during the on-call shift.\n"
    text = "nothing here\n" * 2000 + line + "x" * 50_000 + "\n" + line
    assert [text[s:e] for s, e, _ in finder.found([text])[0]] == ["Katya Bramelov"] * 2
    covered = windows("Anna Bell, " * 100)
    assert all(a[1] >= b[0] for a, b in zip(covered, covered[1:])) and covered[-1][1] >= 1080
    assert candidates("email", text, 0, len(text)) == []


@pytest.mark.parametrize("text,want", [("Thanks to marta velindower for the trace.", "marta velindower"), ("Reported by katya bramelov during the on-call shift.", "katya bramelov"), ("Co-reviewed with petra leimookheir (platform).", "petra leimookheir"), ("The map is lazy.\n- [ ] ask rafaela halenmere about the budget", "rafaela halenmere")])
def test_names_in_lower_case(finder, text, want):
    assert [(k, text[s:e]) for s, e, k in finder.found([text])[0]] == [("name", want)]


RARE = [
    ("Reported by Ian McDonald during the on-call shift.", "Ian McDonald"),
    ("Thanks to Karl zu Velind for the trace.", "Karl zu Velind"),
    ("Thanks to Omar bin Khalud for the trace.", "Omar bin Khalud"),
    ("Merci à Jean DUPONT pour la relecture.", "Jean DUPONT"),
    ("Write to tomas (AT) brack-it.test if the queue is late.", "tomas (AT) brack-it.test"),
    ("Write to tomas [AT] brack-it.test if the queue is late.", "tomas [AT] brack-it.test"),
    ("Write to tomas at brack-it.test if the queue is late.", "tomas at brack-it.test"),
    ("Ship the replacement node to 12 bis rue Velmer, 75011 Pontrelle", "12 bis rue Velmer, 75011 Pontrelle"),
    ("Ship the replacement node to 12, rue Velmer, 75011 Pontrelle", "12, rue Velmer, 75011 Pontrelle"),
    ("Ship the replacement node to 12 quai Velmer, 75011 Pontrelle", "12 quai Velmer, 75011 Pontrelle"),
    ("Ship the replacement node to Avda. Velmera 12, 28013 Villaserna", "Avda. Velmera 12, 28013 Villaserna"),
    ("Ship the replacement node to BP 1234, 75011 Pontrelle", "BP 1234, 75011 Pontrelle"),
    ("Call me on 0711/123456 when the queue is back.", "0711/123456"),
]


@pytest.mark.parametrize("text,want", RARE)
def test_rare_forms(finder, text, want):
    assert [text[s:e] for s, e, _ in finder.found([text])[0]] == [want]


def test_windows_cover_whole_texts():
    for n in (1, 95, 256, 257, 1000, 5000):
        own = windows("x " * n)
        assert own[0][0] == 0 and own[-1][1] == 2 * n and all(a[1] > b[0] for a, b in zip(own, own[1:]))


def test_viterbi_is_exact():
    r = np.random.default_rng(0)
    w = T.start_weights(r)
    w["trans"] = r.normal(0, 1, (LABELS, LABELS)).astype(np.float32)
    model = Model(w)
    x = r.integers(1, SYMBOLS, (3, 4)).astype(np.int16)
    s, best = model.scores(x), model.decode(x)
    import itertools

    for n in range(3):
        score = lambda p: model.first[p[0]] + sum(s[k, n, p[k]] for k in range(4)) + sum(model.trans[p[k], p[k + 1]] for k in range(3))  # noqa: B023, E731
        legal = lambda p: all(b % 2 or b == 0 or a in (b - 1, b) for a, b in zip((0, *p), p))
        assert legal(best[n].tolist()) and abs(max(score(p) for p in itertools.product(range(LABELS), repeat=4) if legal(p)) - score(best[n])) < 1e-3


def test_gradient():
    r = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in T.start_weights(r).items()}
    x = r.integers(1, SYMBOLS, (2, 6)).astype(np.int16)
    y = np.array([[0, 1, 2, 2, 0, 0], [3, 4, 0, 0, -1, -1]], np.int8)
    _, g = T.loss_and_gradient(w, x, y)
    for k in ("rec_f", "in_b", "out", "trans", "first", "bias_f"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        change = []
        for step in (1e-2, -1e-2):
            w2 = {a: b.copy() for a, b in w.items()}
            w2[k][at] += step
            change.append(T.loss_and_gradient(w2, x, y)[0])
        assert abs((change[0] - change[1]) / 2e-2 - g[k][at]) < 0.02 * abs(g[k][at]) + 1e-3, k


def test_symbols():
    assert symbols("aÉé中\ud800").tolist() == [97, 128, 129, 133, 133]


def test_frames(spark):
    rows = [(1, CASES[0][0]), (1, CASES[0][0]), (2, None), (3, ""), (None, CASES[1][0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kind string")
    assert sorted(map(tuple, personal_information(df).collect())) == sorted((1, k, v) for k, v in CASES[0][1])
    out = redacted_documents(df).collect()
    assert [r["n_cases"] for r in out] == [2, 2, 0, 0, 1] and out[2]["text"] is None and out[4]["text"] == "Call me on [PHONE] when the queue is back."
    assert personal_information(df.limit(0)).count() == 0
