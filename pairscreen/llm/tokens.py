"""Token ids of whole text columns, each distinct word encoded once per task.

The tokenizer splits a text at white space and between letters, digits and
other characters, and lower-cases it; pieces are then encoded alone. So the
ids of a text are the ids of its pieces in order. Splitting here happens only
where the tokenizer certainly splits as well. Texts with other characters
than ASCII and Latin-1 letters, or with the mark that opens special tokens,
go to the tokenizer whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from pairscreen.llm.arrays import LOWER, SPACE, buffer, chunks, span_hashes

#: Distinct pieces a task remembers; beyond that it starts afresh.
CACHE_PIECES = 400_000

# Classes of bytes: 0 space, 1 letter, 2 digit, 3 other, 4 apostrophe (never
# split from its neighbours), 5 not handled here.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[SPACE] = 0
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123), 0xC3]] = 1
_CLASS[48:58] = 2
_CLASS[39] = 4


def load(path: str):
    """The tokenizer of a .json file, single-threaded inside tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_characters() -> list[str]:
    """The character that byte-level models read for each byte: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: Pieces encoded in one call.
JOINED = 500


def splits_words(path: str) -> bool:
    """Whether the file's tokenizer is of the kind that this module splits
    for: white space dropped, lower case, pieces of letters or others."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and spec["model"].get(
        "end_of_word_suffix") == "</w>"


class Encoder:
    """Encodes batches with one tokenizer file; keep one per task."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.by_piece = splits_words(path)
        if self.by_piece:
            from tokenizers import Tokenizer, pre_tokenizers

            # the same model without its text steps, for pieces that need none
            self._model = Tokenizer(self.tokenizer.model)
            self._model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self._last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self._last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
            self._characters = dict(enumerate(_byte_characters()))
        self._forget()

    def _forget(self) -> None:
        self._place: dict[int, int] = {}  # piece hash -> number
        self._ids = np.zeros(0, np.uint32)
        self._offsets = np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, np.uint32) for e in found]

    def _add(self, hashes: list[int], flat: np.ndarray, lengths: np.ndarray) -> None:
        known = len(self._place)
        self._place.update(zip(hashes, range(known, known + len(hashes))))
        self._offsets = np.concatenate([self._offsets, self._offsets[-1] + np.cumsum(lengths)])
        self._ids = np.concatenate([self._ids, flat])

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        """A piece without an apostrophe is one word to the model, and its
        last id, and no other, ends a word. So many go in one call."""
        odd = [i for i, p in enumerate(pieces) if b"'" in p]
        if odd:
            ids = self._whole([pieces[i].decode("utf-8") for i in odd])
            self._add([hashes[i] for i in odd], np.concatenate(ids), np.asarray([len(x) for x in ids]))
        plain = [i for i, p in enumerate(pieces) if b"'" not in p]
        if plain:
            read = [pieces[i].decode("latin-1").translate(self._characters) for i in plain]
            calls = [" ".join(read[i:i + JOINED]) for i in range(0, len(read), JOINED)]
            found = self._model.encode_batch_fast(calls, add_special_tokens=False)
            flat = np.concatenate([np.asarray(e.ids, np.uint32) for e in found])
            ends = np.flatnonzero(self._last[flat]) + 1
            if len(ends) != len(plain):
                raise ValueError("the tokenizer does not end words as expected")
            self._add([hashes[i] for i in plain], flat, np.diff(ends, prepend=0))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece numbers and rows in order, and the rows not handled."""
        n = len(offsets) - 1
        kind = _CLASS[data]
        tail = np.zeros(len(data), bool)
        tail[1:] = data[:-1] == 0xC3
        # the second byte of a Latin-1 letter; U+00D7 and U+00F7 are no letters
        letter = tail & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
        kind[letter] = 1
        special = np.zeros(len(data), bool)
        special[:-1] = (data[:-1] == 60) & (data[1:] == 124)  # "<|"
        odd = np.flatnonzero((kind == 5) | special)
        left = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        cut = np.ones(len(data) + 1, bool)
        if len(data) > 1:
            a, b = kind[:-1], kind[1:]
            cut[1:-1] = ((a != b) & (a != 4) & (b != 4)) | (a == 2) | (a == 0) | (b == 0)
            # an apostrophe holds its neighbours, whatever their kind
            cut[1:-1] &= ~(((a == 4) & (b != 0)) | ((b == 4) & (a != 0)))
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        real = (kind[starts] != 0) if len(starts) else np.zeros(0, bool)
        starts, ends = starts[real], ends[real]
        rows = np.searchsorted(offsets, starts, "right") - 1
        if len(left):
            skip = np.zeros(n, bool)
            skip[left] = True
            ok = ~skip[rows]
            starts, ends, rows = starts[ok], ends[ok], rows[ok]
        low = LOWER[data]
        low[letter & (data < 0x9F)] += 0x20
        hashes = span_hashes(low, starts, ends)
        seen, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._place) + len(seen) > CACHE_PIECES:
            self._forget()
        place = np.fromiter((self._place.get(h, -1) for h in seen.tolist()), np.int64, len(seen))
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = low.tobytes()
            at = where[new]
            self._learn(seen[new].tolist(), [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            place[new] = np.fromiter((self._place[h] for h in seen[new].tolist()), np.int64, len(new))
        return place[back], rows, left

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of every row."""
        out = np.zeros(len(texts), np.int64)
        for a, b in chunks(texts):
            part = texts.slice(a, b - a)
            if not self.by_piece:
                out[a:b] = [len(x) for x in self._whole([t or "" for t in part.to_pylist()])]
                continue
            data, offsets = buffer(part)
            numbers, rows, left = self._pieces(data, offsets)
            sizes = np.diff(self._offsets)[numbers]
            out[a:b] = np.bincount(rows, weights=sizes, minlength=b - a).astype(np.int64)
            if len(left):
                out[a + left] = [len(x) for x in self._whole([part[i].as_py() for i in left.tolist()])]
        return out

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every row."""
        out: list[np.ndarray] = []
        for a, b in chunks(texts):
            part = texts.slice(a, b - a)
            if not self.by_piece:
                out += self._whole([t or "" for t in part.to_pylist()])
                continue
            data, offsets = buffer(part)
            numbers, rows, left = self._pieces(data, offsets)
            first, sizes = self._offsets[numbers], np.diff(self._offsets)[numbers]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            flat = self._ids[np.repeat(first - begin[:-1], sizes) + np.arange(begin[-1])]
            edges = begin[np.searchsorted(rows, np.arange(b - a + 1))]
            got = np.split(flat, edges[1:-1]) if b > a else []
            if len(left):
                for i, x in zip(left.tolist(), self._whole([part[i].as_py() for i in left.tolist()])):
                    got[i] = x
            out += got
        return out
