"""Encoding with a public byte-level BPE vocabulary.

A piece of text is encoded by backtracking: an Aho-Corasick automaton over the reversed tokens gives, in one pass, the longest
token that starts at each byte; the encoder walks forward with the longest token that may follow the one before it, tries
its next shorter prefix if the pair is not one that merging would leave standing, and steps back where nothing fits. Whether
a pair stands is read from the merge table by undoing both tokens' last merges, and remembered. The ids are exactly those of
merging by rank, in time linear in the piece. Decoding copies slices of one byte string through an offset table.

Defined results: null and empty text have the empty list; text that looks like a special token is ordinary text; lone
surrogates, which can't be UTF-8, are encoded as U+FFFD. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: White space as Unicode has it (the separators U+001C to U+001F are none).
_WS = r"\t\n\v\f\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Fixed value: the vocabulary's own pre-tokenization.
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Coarser cuts, at places where the pattern above always cuts: they are found by a cheap pattern and repeat often.
_CHUNKS = re.compile(rf"[{_WS}]+(?![^{_WS}])| ?[^{_WS}]+|[{_WS}]")
#: Chunks remembered by a worker; beyond it the memory is emptied and filled anew.
MEMORY = 400_000
_LONGEST_REMEMBERED = 64


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes bytes as printable characters: most as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Token bytes by id, and the merges as (left id, right id, result id), of a tokenizers JSON file.

    Vocabularies that cut or merge otherwise than this encoder does are refused.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or whole.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} is no byte-level BPE with the usual pattern")
    ids, to_byte = model["vocab"], _byte_of_char()
    tokens = [b""] * (max(ids.values()) + 1)
    for text, i in ids.items():
        if all(c in to_byte for c in text):
            tokens[i] = bytes(to_byte[c] for c in text)
    merges = []
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        merges.append((ids[left], ids[right], ids[left + right]))
        # a token that no merge makes is never met in text
    if any(a[2] >= b[2] for a, b in zip(merges, merges[1:])):
        raise ValueError(f"{path}: ids do not rise with the rank of merges")
    made = {m[2] for m in merges} | {i for i, t in enumerate(tokens) if len(t) == 1}
    return [t if i in made else b"" for i, t in enumerate(tokens)], merges


class Encoder:
    """Tables of one vocabulary, and what this process remembers."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        import ahocorasick
        import regex

        self.pieces = regex.compile(_PIECES).findall
        self.length = [len(t) for t in tokens]
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right, result in merges:
            self.merged.setdefault((left, right), result)
            if self.split[result] == (result, result):
                self.split[result] = (left, right)
        reverse = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if t:
                reverse.add_word(t[::-1].decode("latin-1"), i)
        reverse.make_automaton()
        self.reverse = reverse
        by_bytes = {t: i for i, t in enumerate(tokens) if t}
        #: the longest proper prefix of a token that is a token
        self.shorter = [-1] * len(tokens)
        for t, i in by_bytes.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := by_bytes.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.stands: dict[tuple[int, int], bool] = {}
        self.piece_ids: dict[str, tuple[int, ...]] = {}
        # decoding: token i is blob[at[i]:at[i + 1]]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        encoder = self

        class Memory(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = np.asarray(encoder.chunk(chunk), np.int32).tobytes()
                if len(chunk) <= _LONGEST_REMEMBERED:
                    if len(self) >= MEMORY:
                        self.clear()
                    self[chunk] = ids
                return ids

        self.memory = Memory()

    def pair_stands(self, a: int, b: int) -> bool:
        """Whether merging leaves token a directly before token b, when both are made of their own bytes."""
        known = self.stands.get((a, b))
        if known is not None:
            return known
        left, right, limit, stands = a, b, len(self.split), True
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                stands = False
                break
            # undo the later of the two merges on either side of the border
            if left > right:
                limit, inner = left, self.split[left][1]
                if inner == left:
                    limit, inner_right = right + 1, self.split[right][0]
                    if inner_right == right:
                        break
                    right = inner_right
                else:
                    left = inner
            else:
                limit, inner = right + 1, self.split[right][0]
                if inner == right:
                    limit, inner_left = left, self.split[left][1]
                    if inner_left == left:
                        break
                    left = inner_left
                else:
                    right = inner
        if len(self.stands) > 1_000_000:
            self.stands.clear()
        self.stands[(a, b)] = stands
        return stands

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece, by backtracking."""
        n, length, shorter, stands = len(raw), self.length, self.shorter, self.pair_stands
        longest = [-1] * n
        for end, token in self.reverse.iter(raw[::-1].decode("latin-1")):
            start = n - 1 - end
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        if n and length[longest[0]] == n:
            return [longest[0]]
        open_at, ids, at = bytearray(b"\1" * (n + 1)), [], 0
        token = longest[0] if n else -1
        while at < n:
            last = ids[-1] if ids else -1
            while True:
                end = at + length[token]
                if open_at[end] and (last < 0 or stands(last, token)):
                    ids.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if (less := shorter[token]) >= 0:
                    token = less
                    continue
                open_at[at] = 0  # no way on from here
                token = ids.pop()
                at -= length[token]
                last = ids[-1] if ids else -1
                if (less := shorter[token]) < 0:
                    open_at[at] = 0
                    token = ids.pop()
                    at -= length[token]
                    last = ids[-1] if ids else -1
                else:
                    token = less
        return ids

    def chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for p in self.pieces(chunk):
            if (known := self.piece_ids.get(p)) is None:
                known = tuple(self.piece(p.encode("utf-8", "replace") if not _lone(p) else _LONE.sub("\ufffd", p).encode()))
                if len(p) <= _LONGEST_REMEMBERED:
                    if len(self.piece_ids) >= MEMORY:
                        self.piece_ids.clear()
                    self.piece_ids[p] = known
            ids.extend(known)
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as native 32-bit integers."""
        return b"".join(map(self.memory.__getitem__, _CHUNKS.findall(text))) if text else b""

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        starts, lengths = self.at[ids], self.at[ids + 1] - self.at[ids]
        total = int(lengths.sum())
        where = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        return self.blob[where].tobytes()


_LONE = re.compile(f"[{chr(0xD800)}-{chr(0xDFFF)}]")


def _lone(text: str) -> bool:
    return _LONE.search(text) is not None


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; built once a process."""
    key = shared.value[0]
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*shared.value[1])
    return _ENCODERS[key]


def _share(df: DataFrame, vocabulary: str):
    # about 50,000 tokens, whatever the input
    tokens, merges = read_vocabulary(vocabulary)
    return df.sparkSession.sparkContext.broadcast((hash((tuple(tokens), tuple(merges))), (tokens, merges)))


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def encode_documents(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each row's text. vocabulary: path of a byte-level tokenizers JSON file."""
    shared = _share(documents, vocabulary)
    rows = documents.select(documents[key], documents[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([encode(t) for t in b.column(1).to_pylist()])], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of encode_documents's result; null ids have null text. Bytes that are no UTF-8 become U+FFFD."""
    shared = _share(encoded, vocabulary)
    rows = encoded.select(encoded[key], encoded[ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(shared).decode
        for b in batches:
            texts = [None if x is None else decode(np.asarray(x, np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, text string")
