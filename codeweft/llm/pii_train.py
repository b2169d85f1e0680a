"""python -m codeweft.llm.pii_train SF_DIR [SECONDS [PROCESSES [continue]]]: trains the model of pii.py in numpy and writes its weights beside it.

The labelled spans are made from a bounded sample of documents (DOCUMENTS rows at most): the exact forms of pii_grammar.py,
and for names the forms with a given name that signs a commit or review in the sample, in lower case too. Part of the names
and digits are then made anew at random and part of the forms put in rarer ones (names in lower case, other prefixes, other
signs), so that the model learns forms and surroundings and not the sample's names. Into most texts lines are put whose labels
no form made (pii_made.py). A fifth of the documents is held out; its accuracy by spans is printed, names in lower case also by
themselves, and that on made lines put into it.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys
import time
from pathlib import Path

import duckdb
import numpy as np

from . import pii_grammar as G
from . import pii_made as made
from .pii import LABELS, NEARLY_SHUT, SLOPE, SYMBOLS, WEIGHTS, Finder, Model, symbols, windows

#: Bound of the labelled sample.
DOCUMENTS = 20_000
EMBED, HIDDEN, RATE = 20, 24, 4e-3
#: Characters of a window in training and between the starts of two.
WINDOW, STRIDE = 96, 56
_SIGNED = re.compile(r"(?:Signed-off-by|Reviewed-by): (\w[\w'-]+) ")
#: Words that follow a given name in the names of services.
_SERVICE = re.compile(r"(?i)\b(?:indexer|scheduler|router|queue|builder|index|service|team|graph|server|runner|worker|store|cache)\b")


_LOW_WORD = r"[^\W\d_]+(?:['-][^\W\d_]+)*"
_LOW_PAIR = re.compile(rf"(?<![\w@./-])({_LOW_WORD})(?: (?:van|von|de|del|der|den|da|di|la|al|el))* ({_LOW_WORD})(?![\w@/])")


def low_names(text: str, given: set[str]) -> list[tuple[int, int]]:
    """A given name in lower case and the word in lower case after it."""
    out = []
    at = 0
    while m := _LOW_PAIR.search(text, at):
        if m[1].islower() and m[2].islower() and m[1].upper() in given and not _SERVICE.search(m[0]):
            out.append((m.start(), m.end()))
            at = m.end()
        else:
            at = m.end(1)
    return out


def spans(text: str, given: set[str]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a text's labelled spans, without overlap."""
    out = []
    for k, kind in enumerate(G.KINDS[:-1]):
        out += [(s, e, k) for s, e in G.candidates(kind, text, 0, len(text))]
    for s, e in G.candidates("name", text, 0, len(text)):
        words = re.findall(r"[^\W\d_]+", text[s:e])
        person = any(w.upper() in given for w in words) or re.match(r"[^\W\d_]\. ?[^\W\d_]", text[s:e]) and not text[s:e].startswith(("P.O", "P. O"))
        before = text[max(0, s - 4) : s].lower()
        if person and not _SERVICE.search(text[s:e]) and len(words) > 1 and not before.endswith("the "):
            out.append((s, e, 4))
    out += [(s, e, 4) for s, e in low_names(text, given)]
    kept: list[tuple[int, int, int]] = []
    for c in sorted(out, key=lambda c: (c[0], -c[1])):
        if not kept or c[0] >= kept[-1][1]:
            kept.append(c)
    return kept


def _word(r: random.Random, like: str) -> str:
    w = made.word(r)
    return w.upper() if like.isupper() and len(like) > 1 else w.capitalize() if like[0].isupper() else w


def _rare_name(piece: str, r: random.Random) -> str:
    x = r.random()
    first, _, last = piece.rpartition(" ")
    if x < 0.25:
        return piece.lower()
    if not first or not last[:1].isupper() or x > 0.45:
        return piece
    if x < 0.28:
        return f"{first} {last.lower()}"
    if x < 0.30:
        return f"{first.lower()} {last}"
    if x < 0.34:
        return f"{first} {last.upper()}"
    if x < 0.39:
        return f"{first} {r.choice(['Mc', 'Mac', chr(79) + chr(39), 'D' + chr(39)])}{last.capitalize()}"
    return f"{first} {r.choice('de del della der den van von zu zum af da do dos du la ter ten bin ibn'.split())} {last}"


def _rare_mail(piece: str, r: random.Random) -> str:
    x = r.random()
    if x > 0.12 or "@" not in piece:
        return piece
    if x < 0.03:
        return piece.replace("@", " at ")
    return piece.replace("@", r.choice(["(AT)", " (AT) ", "[AT]", " [AT] ", " {AT} ", "(at)", "[at]"]))


def _rare_address(piece: str, r: random.Random) -> str:
    if r.random() < 0.4:
        piece = re.sub(r"^(\d+),? (?=rue|avenue|boulevard|chemin|place|impasse)", lambda m: m[1] + r.choice([" bis ", " ter ", ", ", " bis, "]), piece)
        piece = re.sub(r"(?<=\d )rue|(?<=, )rue|(?<=s )rue|(?<=r )rue", lambda m: r.choice(["quai", "cours", "all" + chr(0xE9) + "e", "rue"]), piece)
        piece = re.sub(r"^(?:Calle|Avenida|Plaza|Paseo|Camino)(?= )", lambda m: r.choice(["Avda.", "Ronda", "C/", m[0]]), piece)
        piece = re.sub(r"^(?:P\.? ?O\.? ?Box|PO Box|Postfach|Apartado)(?= \d)", lambda m: r.choice(["BP", "Case postale", "Casilla", m[0]]), piece)
    return piece


def changed(text: str, own: list[tuple[int, int, int]], r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with other names and digits of the same form in its spans."""
    parts, out, at, n = [], [], 0, 0
    for s, e, k in own:
        piece = text[s:e]
        if k == 4:
            piece = _rare_name(re.sub(r"[^\W\d_]{3,}", lambda m: _word(r, m[0]), piece), r)
        elif k == 0:
            piece = _rare_mail(re.sub(r"^[a-z]{3,}", lambda m: _word(r, m[0]), piece), r)
        else:
            piece = re.sub(r"(?<=\d)\d", lambda m: str(r.randint(0, 9)), piece)
            if k == 3:
                piece = _rare_address(piece, r)
            elif k == 1 and r.random() < 0.05:
                piece = f"0{r.randint(20, 9999)}{r.choice('/-')}{r.randint(10**5, 10**8 - 1)}"
        parts += [text[at:s], piece]
        n += s - at
        out.append((n, n + len(piece), k))
        n += len(piece)
        at = e
    parts.append(text[at:])
    return "".join(parts), out


def with_lines(text: str, own: list[tuple[int, int, int]], r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with one to four made lines between its own; a labelled span is never broken."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n" and not any(s <= i < e for s, e, _ in own)] + [len(text)]
    parts, out, at, n, k = [], [], 0, 0, 0
    for end in sorted(r.choices(ends, k=r.randint(1, 4))):
        parts.append(text[at:end])
        while k < len(own) and own[k][0] < end:
            out.append((own[k][0] + n, own[k][1] + n, own[k][2]))
            k += 1
        line, pieces = made.line(r)
        line = ("\n" if end == len(text) and text and text[-1] != "\n" else "") + line + "\n"
        first = end + n + line.startswith("\n")
        out += [(first + s, first + e, kind) for s, e, kind in pieces]
        parts.append(line)
        n += len(line)
        at = end
    parts.append(text[at:])
    return "".join(parts), out + [(s + n, e + n, kind) for s, e, kind in own[k:]]


def examples(texts: list[str], given: set[str], r: random.Random | None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels (-1 beyond the end) of the windows of texts."""
    xs, ys = [], []
    for t in texts:
        own = spans(t, given)
        if r is not None and r.random() < 0.5:
            t, own = changed(t, own, r)
        if r is not None and r.random() < 0.6:
            t, own = with_lines(t, own, r)
        label = np.zeros(len(t), np.int8)
        for s, e, k in own:
            label[s:e] = 2 + 2 * k
            label[s] = 1 + 2 * k
        code = symbols(t)
        for s, e in windows(t, WINDOW, STRIDE):
            x, y = np.zeros(WINDOW, np.int16), np.full(WINDOW, -1, np.int8)
            x[: e - s], y[: e - s] = code[s:e], label[s:e]
            xs.append(x)
            ys.append(y)
    return np.array(xs), np.array(ys)


def start_weights(r: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"embed": r.normal(0, 0.3, (SYMBOLS, EMBED))}
    for d in "fb":
        w[f"in_{d}"] = r.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN))
        w[f"rec_{d}"] = r.normal(0, HIDDEN**-0.5 * 0.7, (HIDDEN, 4 * HIDDEN))
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1
        w[f"bias_{d}"] = bias
    w |= {"out": r.normal(0, 0.2, (2 * HIDDEN, LABELS)), "out_bias": np.zeros(LABELS), "trans": np.zeros((LABELS, LABELS)), "first": np.zeros(LABELS)}
    for j in range(2, LABELS, 2):  # an inside follows its own beginning or itself
        w["trans"][:, j] = -4
        w["trans"][[j - 1, j], j] = 1
        w["first"][j] = -1
    return {k: v.astype(np.float32) for k, v in w.items()}


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(SLOPE * x + 0.5, NEARLY_SHUT, 1)


def _slope(gate: np.ndarray) -> np.ndarray:
    return SLOPE * ((gate > NEARLY_SHUT) & (gate < 1))


def _forward(w: dict, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
    n, t = x.shape
    table = w["embed"] @ w[f"in_{d}"] + w[f"bias_{d}"]
    state, cell = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((t, n, HIDDEN), np.float32), [None] * t
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        z = table[x[:, k]] + state @ w[f"rec_{d}"]
        gates, cand = _gate(z[:, : 3 * HIDDEN]), np.clip(z[:, 3 * HIDDEN :], -1, 1)
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before_state, before_cell = state, cell
        cell = f * cell + i * cand
        th = np.clip(cell, -1, 1)
        state = o * th
        kept[k] = (i, f, o, cand, th, before_state, before_cell)
        out[k] = state
    return out, kept


def _backward(w: dict, g: dict, x: np.ndarray, d: str, grad: np.ndarray, kept: list) -> None:
    n, t = x.shape
    ds, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dtable = np.zeros((SYMBOLS, 4 * HIDDEN), np.float32)
    drec = g[f"rec_{d}"]
    for k in range(t - 1, -1, -1) if d == "f" else range(t):
        i, f, o, cand, th, before_state, before_cell = kept[k]
        ds = ds + grad[k]
        dc = dc + ds * o * (np.abs(th) < 1)
        dz = np.concatenate([dc * cand * _slope(i), dc * before_cell * _slope(f), ds * th * _slope(o), dc * i * (np.abs(cand) < 1)], axis=1)
        drec += before_state.T @ dz
        one = np.zeros((n, SYMBOLS), np.float32)
        one[np.arange(n), x[:, k]] = 1
        dtable += one.T @ dz
        ds, dc = dz @ w[f"rec_{d}"].T, dc * f
    g[f"in_{d}"] += w["embed"].T @ dtable
    g[f"bias_{d}"] += dtable.sum(axis=0)
    g["embed"] += dtable @ w[f"in_{d}"].T


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def loss_and_gradient(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the windows' label sequences under the CRF, and its gradient."""
    n, t = x.shape
    g = {k: np.zeros_like(v) for k, v in w.items()}
    f_out, f_kept = _forward(w, x, "f")
    b_out, b_kept = _forward(w, x, "b")
    both = np.concatenate([f_out, b_out], axis=2)
    s = both @ w["out"] + w["out_bias"]
    live = (y >= 0).T
    lab = np.where(y < 0, 0, y).T.astype(np.int64)
    rows = np.arange(n)
    alpha = np.empty((t, n, LABELS), np.float32)
    alpha[0] = s[0] + w["first"]
    for k in range(1, t):
        step = _log_sum(alpha[k - 1][:, :, None] + w["trans"], 1) + s[k]
        alpha[k] = np.where(live[k][:, None], step, alpha[k - 1])
    total = _log_sum(alpha[-1], 1)
    beta = np.zeros((t, n, LABELS), np.float32)
    for k in range(t - 2, -1, -1):
        step = _log_sum(w["trans"] + (s[k + 1] + beta[k + 1])[:, None, :], 2)
        beta[k] = np.where(live[k + 1][:, None], step, 0)
    node = np.exp(alpha + beta - total[:, None]) * live[:, :, None]
    gold = w["first"][lab[0]] + s[0][rows, lab[0]]
    ds = node.copy()
    ds[0][rows, lab[0]] -= 1
    np.add.at(g["first"], lab[0], -1)
    g["first"] += node[0].sum(axis=0)
    for k in range(1, t):
        on = live[k]
        gold = gold + on * (w["trans"][lab[k - 1], lab[k]] + s[k][rows, lab[k]])
        ds[k][rows[on], lab[k][on]] -= 1
        pair = np.exp(alpha[k - 1][:, :, None] + w["trans"] + (s[k] + beta[k])[:, None, :] - total[:, None, None]) * on[:, None, None]
        g["trans"] += pair.sum(axis=0)
        np.add.at(g["trans"], (lab[k - 1][on], lab[k][on]), -1)
    ds /= n
    g["trans"] /= n
    g["first"] /= n
    flat = ds.reshape(-1, LABELS)
    g["out"] = both.reshape(-1, 2 * HIDDEN).T @ flat
    g["out_bias"] = flat.sum(axis=0)
    dboth = ds @ w["out"].T
    _backward(w, g, x, "f", dboth[:, :, :HIDDEN], f_kept)
    _backward(w, g, x, "b", dboth[:, :, HIDDEN:], b_kept)
    return float((total - gold).mean()), g


_DATA: tuple[np.ndarray, np.ndarray] | None = None


def _part(task: tuple[dict, np.ndarray]) -> tuple[float, dict, int]:
    w, rows = task
    return (*loss_and_gradient(w, _DATA[0][rows], _DATA[1][rows]), len(rows))


def train(x: np.ndarray, y: np.ndarray, seconds: float, batch: int = 96, processes: int = 4, seed: int = 7, start: dict | None = None, rate_0: float = RATE) -> dict[str, np.ndarray]:
    """Adam over shuffled windows until the time is up; the rate falls from rate_0 to a twentieth. Each process takes a batch a step."""
    global _DATA
    _DATA = (x, y)
    r = np.random.default_rng(seed)
    w = start or start_weights(r)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    began, step, said = time.time(), 0, []
    with multiprocessing.get_context("fork").Pool(processes) as pool:
        while (part := (time.time() - began) / seconds) < 1:
            order = r.permutation(len(x))
            for rows in np.array_split(order, max(1, len(x) // (batch * processes))):
                part = min(1.0, (time.time() - began) / seconds)
                done = pool.map(_part, [(w, own) for own in np.array_split(rows, min(processes, len(rows)))], chunksize=1)
                n = sum(k for _, _, k in done)
                g = {k: sum(d[1][k] * (d[2] / n) for d in done) for k in w}
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                step += 1
                rate = rate_0 * (1 - 0.95 * part) * min(1, 20 / max(norm, 1e-6))
                for k in w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
                said.append(sum(d[0] * d[2] for d in done) / n)
                if step % 50 == 0:
                    print(f"step {step}, {time.time() - began:.0f} s, loss {np.mean(said[-50:]):.3f}", flush=True)
                if part >= 1:
                    break
    return w


def accuracy(finder: Finder, texts: list[str], given: set[str]) -> dict[str, tuple[int, int, int]]:
    """By kind: spans found, of the labelled ones, and found in all; "lower" are the names in lower case."""
    out = {k: [0, 0, 0] for k in (*G.KINDS, "lower")}
    for t, found in zip(texts, finder.found(texts)):
        want = {(s, e, G.KINDS[k]) for s, e, k in spans(t, given)}
        for c in want:
            for k in (c[2], "lower")[: 1 + (c[2] == "name" and t[c[0] : c[1]].islower())]:
                out[k][1] += 1
                out[k][0] += c in found
        for c in found:
            for k in (c[2], "lower")[: 1 + (c[2] == "name" and t[c[0] : c[1]].islower())]:
                out[k][2] += 1
    return {k: tuple(v) for k, v in out.items()}


def made_accuracy(finder: Finder, texts: list[str], given: set[str], seed: int = 99) -> dict[str, tuple[int, int]]:
    """By kind: made pieces found, of those put into the texts, by equal bounds; no exact form has a say in what was put there."""
    r = random.Random(seed)
    rows = [with_lines(t, [], r) for t in texts]
    out = {k: [0, 0] for k in G.KINDS}
    for (_, own), found in zip(rows, finder.found([t for t, _ in rows])):
        for s, e, k in own:
            out[G.KINDS[k]][0] += (s, e, G.KINDS[k]) in found
            out[G.KINDS[k]][1] += 1
    return {k: tuple(v) for k, v in out.items()}


def sample(sf_dir: str) -> list[tuple[int, str]]:
    path = Path(sf_dir, "documents.parquet")
    return duckdb.sql(f"select doc_id, text from '{path}{'/*.parquet' if path.is_dir() else ''}' where trim(text) != '' order by hash(doc_id) limit {DOCUMENTS}").fetchall()


def given_names(texts: list[str]) -> set[str]:
    return {m.upper() for t in texts for m in _SIGNED.findall(t)}


def _kept() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        w = {k: v.astype(np.float32) for k, v in f.items()}
    return pruned(w, HIDDEN) if w["rec_f"].shape[0] > HIDDEN else w


def pruned(w: dict[str, np.ndarray], hidden: int) -> dict[str, np.ndarray]:
    """The weights with the units left that what follows them listens to most; to be trained on."""
    h = w["rec_f"].shape[0]
    out, parts = dict(w), {}
    for d, rows in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        weight = np.linalg.norm(w["out"][rows], axis=1) + np.linalg.norm(w[f"rec_{d}"], axis=1)
        keep = np.sort(np.argsort(-weight)[:hidden])
        gates = np.concatenate([keep + k * h for k in range(4)])
        out[f"rec_{d}"], out[f"in_{d}"], out[f"bias_{d}"] = w[f"rec_{d}"][np.ix_(keep, gates)], w[f"in_{d}"][:, gates], w[f"bias_{d}"][gates]
        parts[d] = w["out"][rows][keep]
    out["out"] = np.concatenate([parts["f"], parts["b"]])
    return out


def _wrong(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((model.decode(x) != y) & (y >= 0)).any(axis=1)


def main(sf_dir: str, seconds: float) -> None:
    docs = sample(sf_dir)
    given = given_names([t for _, t in docs])
    held = [t for i, t in docs if i % 5 == 0]
    processes = int(sys.argv[3]) if len(sys.argv) > 3 else 4
    learnt = [t for i, t in docs if i % 5]
    with multiprocessing.get_context("fork").Pool(processes) as pool:
        x, y = map(np.concatenate, zip(*pool.starmap(examples, [(learnt[k::processes], given, random.Random(3 + k)) for k in range(processes)])))
    # windows without a span are many and easy: keep all with one, as many again, and those that the kept weights mark wrongly
    has = (y > 0).any(axis=1)
    wrong = np.zeros(len(x), bool)
    if "continue" in sys.argv:
        with multiprocessing.get_context("fork").Pool(processes) as pool:
            model = Model(_kept())
            wrong = np.concatenate(pool.starmap(_wrong, [(model, a, b) for a, b in zip(np.array_split(x, len(x) // 512 + 1), np.array_split(y, len(x) // 512 + 1))]))
    keep = has | wrong | (np.random.default_rng(1).random(len(x)) < min(1.0, 1.2 * has.mean() / max(1e-9, 1 - has.mean())))
    # identity numbers are the fewest: their windows count three times
    number = keep & np.isin(y, (5, 6)).any(axis=1)
    print(f"{len(x)} windows, {has.sum()} with a span, {keep.sum()} used, {len(given)} given names", flush=True)
    rows = np.concatenate([np.flatnonzero(keep), np.repeat(np.flatnonzero(number), 2)])
    w = train(x[rows], y[rows], seconds, processes=processes, **({"start": _kept(), "rate_0": RATE / 3} if "continue" in sys.argv else {}))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in w.items()})
    finder = Finder(Model(w))
    print(accuracy(finder, held, given), made_accuracy(finder, held, given), Path(WEIGHTS).stat().st_size)


if __name__ == "__main__":
    main(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 600)
