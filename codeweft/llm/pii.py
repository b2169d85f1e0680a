"""Personal information inside free text.

A character-level bidirectional LSTM with CRF transitions marks it: each character gets scores for the beginning and the inside
of every kind, and the best sequence of a window is found by Viterbi decoding. Overlapping windows cover the whole of every
text; their decodings are reconciled over it: of two windows the one decides a character in which it lies further from the
edge. What the model marks is then brought to exact bounds, by the form of its kind if it has one, else by whole words; a stretch
that can't be of its kind (a phone number without digits) is dropped.

The model is trained in numpy from labelled spans (pii_train.py); its weights are a small file beside this module, read once
and sent to the tasks. Windows that repeat are decoded once a task.

Defined results: null, empty and blank texts hold none; the same piece twice in a document is one case; overlapping cases of
different kinds are settled for the one that begins first, then the longer one. A null id gives no case but is redacted.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pii_grammar import KINDS, snap

WEIGHTS = str(Path(__file__).with_name("pii_model.npz"))
#: Characters of a window and between the starts of two that overlap.
WINDOW, STRIDE = 1536, 1496
BATCH = 512
#: 0 outside, then beginning and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Labels that may follow any other, beginnings, and insides.
FREE, BEGIN, INSIDE = [0, *range(1, LABELS, 2)], list(range(1, LABELS, 2)), list(range(2, LABELS, 2))
SYMBOLS = 140
#: How steeply the gates open.
SLOPE = 0.2
#: What a shut gate still lets through, so that no state fades to numbers that a processor is slow with.
NEARLY_SHUT = 1e-6


def _symbol_table() -> np.ndarray:
    """Code points below 0x250 to symbols: ASCII as it is, accented letters by case, the rest by class (see symbols)."""
    table = np.empty(0x250, np.int16)
    for c in range(0x250):
        ch = chr(c)
        table[c] = c if c < 128 else 128 if ch.isupper() else 129 if ch.islower() else 130 if ch in "ºª°" else 131 if ch.isspace() else 132
    return table


_TABLE = _symbol_table()
#: Without the checks of numpy.clip, which take as long as small arrays do.
_clip = np.clip if not hasattr(np, "_core") else np._core.umath.clip


def symbols(text: str) -> np.ndarray:
    """One symbol a character; 0 is left for padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(code), 133, np.int16)
    low = code < 0x250
    out[low] = _TABLE[code[low]]
    out[(code >= 0x3000) & (code < 0x303F) | (code >= 0xFF00) & (code < 0xFF65)] = 134
    out[(code >= 0x2018) & (code <= 0x201F)] = 135
    return out


class Model:
    """Weights: embed (SYMBOLS, E); per direction in (E, 4H), rec (H, 4H), bias (4H); out (2H, LABELS), out_bias; trans (LABELS, LABELS), first (LABELS).

    Gates, in the order input, forget, output, open by a straight line, clipped: SLOPE * x + 1/2 within 0 and 1. The candidate and
    the state are clipped at -1 and 1; nothing in the recurrence is slower than a product, on any processor.
    """

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        f = {k: np.asarray(v, np.float32) for k, v in w.items()}
        self.hidden = h = f["rec_f"].shape[0]
        scale = np.concatenate([np.full(3 * h, SLOPE, np.float32), np.ones(h, np.float32)])
        half = np.concatenate([np.full(3 * h, 0.5, np.float32), np.zeros(h, np.float32)])
        self.embed = np.ascontiguousarray(np.concatenate([f["embed"], np.ones((SYMBOLS, 1), np.float32)], axis=1).T)
        # below the gates' rows, those that score the state that goes in
        score = {"f": f["out"][:h], "b": f["out"][h:]}
        silent = np.zeros((f["embed"].shape[1] + 1, LABELS), np.float32)
        self.weights = {d: np.ascontiguousarray(np.concatenate([np.concatenate([f[f"rec_{d}"] * scale, f[f"in_{d}"] * scale, (f[f"bias_{d}"] * scale + half)[None]]), np.concatenate([score[d], silent])], axis=1).T) for d in "fb"}
        self.out_bias, self.trans, self.first = f["out_bias"], f["trans"], f["first"]
        self.back = np.full_like(self.trans, -np.inf)
        self.back[:, FREE] = self.trans[:, FREE]
        for i in INSIDE:
            self.back[[i - 1, i], i] = self.trans[[i - 1, i], i]

    def _run(self, x: np.ndarray, d: str, s: np.ndarray) -> None:
        """Adds a direction's part to the scores (T, LABELS, N). x: (T, N)."""
        t, n = x.shape
        h = self.hidden
        # the state, then the embedding of the character and a one for the bias
        given = np.zeros((h + len(self.embed), n), np.float32)
        state, letter = given[:h], given[h:]
        cell, z = np.zeros((h, n), np.float32), np.empty((4 * h + LABELS, n), np.float32)
        gates, enter, keep, leave, candidate, scored = z[: 3 * h], z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h : 4 * h], z[4 * h :]
        weights, before = self.weights[d], None
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            self.embed.take(x[k], axis=1, out=letter, mode="clip")
            np.matmul(weights, given, out=z)
            if before is not None:
                s[before] += scored
            before = k
            _clip(gates, NEARLY_SHUT, 1, gates)
            _clip(candidate, -1, 1, candidate)
            cell *= keep
            enter *= candidate
            cell += enter
            _clip(cell, -1, 1, state)
            state *= leave
        s[before] += np.matmul(weights[4 * h :, :h], state)

    def _scores(self, x: np.ndarray) -> np.ndarray:
        s = np.empty((x.shape[1], LABELS, x.shape[0]), np.float32)
        s[:] = self.out_bias[:, None]
        places = np.ascontiguousarray(x.T, np.intp)
        for d in "fb":
            self._run(places, d, s)
        return s

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(T, N, LABELS) for symbols (N, T)."""
        return self._scores(x).transpose(0, 2, 1)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labels (N, T) by Viterbi; an inside follows only its own beginning or itself."""
        best = self._scores(x)
        t, _, n = best.shape
        free, own_b, own_i = np.ascontiguousarray(self.trans[:, FREE])[:, :, None], self.trans[BEGIN, INSIDE][:, None], self.trans[INSIDE, INSIDE][:, None]
        best[0] += self.first[:, None]
        best[0, INSIDE] = -np.inf
        paths, held, on = np.empty((LABELS, len(FREE), n), np.float32), np.empty((len(INSIDE), n), np.float32), np.empty((len(INSIDE), n), np.float32)
        for k in range(1, t):
            a, here = best[k - 1], best[k]
            np.add(a[:, None], free, out=paths)
            most = paths.max(axis=0)
            here[0] += most[0]
            here[1::2] += most[1:]
            np.add(a[1::2], own_b, out=held)
            np.add(a[2::2], own_i, out=on)
            here[2::2] += np.maximum(held, on, out=held)
        labels = np.empty((t, n), np.int8)
        labels[-1] = best[-1].argmax(axis=0)
        for k in range(t - 1, 0, -1):
            labels[k - 1] = (best[k - 1] + self.back[:, labels[k]]).argmax(axis=0)
        return labels.T


def windows(text: str, size: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int]]:
    """(start, end) of the windows of a text, which cover all of it."""
    out: list[tuple[int, int]] = []
    start = 0
    while len(text) - start > size:
        out.append((start, start + size))
        start += stride
    if start < len(text):
        out.append((start, len(text)))
    return out


class Finder:
    """Finds the cases of texts; remembers the windows it has decoded."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, bytes] = {}

    def _decode(self, parts: list[str]) -> None:
        """Windows of like length are decoded together, so that little is padding."""
        parts.sort(key=len)
        for i in range(0, len(parts), BATCH):
            group = parts[i : i + BATCH]
            x = np.zeros((len(group), max(map(len, group))), np.int16)
            code, at = symbols("".join(group)), 0
            for k, p in enumerate(group):
                x[k, : len(p)] = code[at : at + len(p)]
                at += len(p)
            for p, labels in zip(group, self.model.decode(x)):
                self.known[p] = labels[: len(p)].tobytes()

    def found(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the cases of each text, in order, without overlap."""
        if len(self.known) > 200_000:
            self.known.clear()
        spans = [windows(t) if t else [] for t in texts]
        new = {t[s:e] for t, own in zip(texts, spans) for s, e in own} - self.known.keys()
        self._decode(list(new))
        return [self._cases(t, own) if own else [] for t, own in zip(texts, spans)]

    def _cases(self, text: str, own: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        marks: list[tuple[int, int, int]] = []  # start, end, kind
        k = 0
        while k < len(own):
            # windows that overlap are one stretch; each decides up to the middle of what it shares with the next
            labels = bytearray(self.known[text[own[k][0] : own[k][1]]])
            first = own[k][0]
            while k + 1 < len(own) and own[k + 1][0] < own[k][1]:
                (_, e), (s2, e2) = own[k], own[k + 1]
                middle = (s2 + e) // 2
                labels = labels[: middle - first] + self.known[text[s2:e2]][middle - s2 :]
                k += 1
            k += 1
            if any(labels):
                marks += _marks(labels, first)
        cases = []
        for s, e, kind in marks:
            if (exact := snap(KINDS[kind], text, s, e)) is not None:
                cases.append((*exact, KINDS[kind]))
        out: list[tuple[int, int, str]] = []
        for c in sorted(set(cases), key=lambda c: (c[0], -c[1])):
            if not out or c[0] >= out[-1][1]:
                out.append(c)
        return out


def _marks(labels: bytearray, first: int) -> list[tuple[int, int, int]]:
    out, start, kind = [], -1, -1
    for i, x in enumerate(labels):
        own = (x - 1) // 2 if x else -1
        if own != kind or x % 2 == 1:
            if kind >= 0:
                out.append((first + start, first + i, kind))
            start, kind = i, own
    if kind >= 0:
        out.append((first + start, first + len(labels), kind))
    return out


def redact(text: str, cases: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder such as [EMAIL] in place of each case, otherwise unchanged."""
    parts, at = [], 0
    for s, e, kind in cases:
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(parts) + text[at:]


_FINDERS: dict[int, Finder] = {}


def _share(df: DataFrame, weights: str):
    # the weights have a fixed size, some tens of kilobytes
    data = Path(weights).read_bytes()
    return df.sparkSession.sparkContext.broadcast((hash(data), data))


def _finder(shared) -> Finder:
    key, data = shared.value
    if key not in _FINDERS:
        with np.load(io.BytesIO(data)) as w:
            _FINDERS[key] = Finder(Model(dict(w)))
    return _FINDERS[key]


def personal_information(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, kind, pii_text): each piece once a document."""
    shared = _share(documents, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [r for i, t, cases in zip(b.column(0).to_pylist(), texts, finder.found(texts)) for r in dict.fromkeys((i, kind, t[s:e]) for s, e, kind in cases)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "kind", "pii_text"])

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, kind string, pii_text string").distinct()


def redacted_documents(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, n_cases, text): every row, its cases replaced by typed placeholders."""
    shared = _share(documents, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = finder.found(texts)
            out = [t if t is None else redact(t, c) for t, c in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c) for c in found], pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_cases", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_cases bigint, text string")
