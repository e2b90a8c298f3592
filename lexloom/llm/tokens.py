"""Token ids by the tokenizers library, a batch of texts at a time.

Both vocabularies split text before a space or line feed that stands between two characters that are not white space,
and between letters and marks, and never merge across such a split, so that the library needs to encode each distinct
piece once; ids are the same as those of the whole text. Arrow splits a batch and numbers its distinct pieces, a memo
gives the ids of those seen before, the library those of the others, and one gather puts them together. Texts that hold
a special token's string, or spaces beside other white space, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexloom.llm.common import kept

#: Pieces that the memo holds at most unless told otherwise; beyond, it forgets those that only one batch had.
MEMO = 400_000
#: Bytes of text that are encoded together.
PART = 8 << 20


#: Latin letters (but I with dot, whose lower case has a mark), then ASCII marks.
_STEM = re.compile(r"(\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]+)")


def _odd(piece: str) -> bool:
    """Whether white space of any kind, as any Unicode version has it, touches the ends of what follows a space or line feed."""
    core = piece[1:] if piece[:1] == "\n" else piece
    return not core or core[0].isspace() or core[-1].isspace()


class Encoder:
    """Texts -> ids as unsigned integers of 2 or 4 bytes; `end_id` follows each text."""

    def __init__(self, path: str, end_id: int, width: int = 4, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code, self.dtype, self.width = {2: "H", 4: "I"}[width], np.dtype(f"<u{width}"), width
        if max(self.tokenizer.get_vocab_size() - 1, end_id) >= 1 << 8 * width:
            raise ValueError(f"ids don't fit {width} bytes")
        self.end = array(self.code, [end_id]).tobytes()
        self.most = memo
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes | None] = {}  # ids of pieces with the space before them, if they begin with no line feed; none for odd ones
        self.marks: dict[str, bytes] = {}
        self.folds = self._encode(["Q"]) == self._encode(["q"])
        self.again: set[str] = set()

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """One call for all: a special token between two pieces keeps them apart, and its id shows where they end."""
        if not self.special:
            return self._encode(pieces)
        ids = np.frombuffer(self._encode([self.special[0].join(pieces)])[0], self.dtype)
        ends = [*np.flatnonzero(ids == self.tokenizer.token_to_id(self.special[0])).tolist(), len(ids)]
        raw, w = ids.tobytes(), self.width
        return [raw[w * a : w * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]

    def _learn(self, pieces: list[str]) -> None:
        memo = self.memo
        if len(memo) > self.most:
            kept = self.again if len(self.again) < self.most // 2 else set()
            self.memo = memo = {w: b for w, b in memo.items() if w in kept}
            self.again = set()
        new = [w for w in pieces if w not in memo]
        if len(new) < len(pieces):
            self.again.update(set(pieces).difference(new))
        odd = [w for w in new if _odd(w) or ("<" in w and any(s in w for s in self.special))]
        if odd:
            memo.update(dict.fromkeys(odd))
            new = [w for w in new if w not in memo]
        parts = {w: m.groups() for w in new if (m := _STEM.fullmatch(w))}
        plain = [w for w in new if w not in parts]
        stems = {m[0].lower() if self.folds and m[0].isascii() else m[0] for m in parts.values()}
        self._encode_into(memo, [*plain, *stems.difference(memo, plain)])
        if len(self.marks) > self.most // 8:
            self.marks = {}
        self._encode_into(self.marks, list({m[1] for m in parts.values()}.difference(self.marks)), "")
        for w, (stem, mark) in parts.items():
            memo[w] = memo[stem.lower() if self.folds and stem.isascii() else stem] + self.marks[mark]

    def _encode_into(self, memo: dict, pieces: list[str], lead: str = " ") -> None:
        for i in range(0, len(pieces), 500):
            some = pieces[i : i + 500]
            memo.update(zip(some, self._encode_pieces([w if w[0] == "\n" else lead + w for w in some])))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the number of ids before each text, with the total)."""
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = np.asarray(split.offsets).astype(np.int64)
        bounds -= bounds[0]
        found = pc.dictionary_encode(split.flatten())
        index = np.asarray(found.indices).astype(np.int64)
        pieces = found.dictionary.to_pylist()
        self._learn(pieces)
        blobs = list(map(self.memo.__getitem__, pieces))
        odd = np.fromiter((b is None for b in blobs), bool, len(blobs))
        # a text's first piece has no space before it; odd texts are one piece
        first = bounds[:-1]
        whole = np.zeros(len(texts), bool)
        if odd.any():
            whole[np.searchsorted(bounds, np.flatnonzero(odd[index]), side="right") - 1] = True
            whole &= np.diff(bounds) > 0
        heads = [pieces[i] for i in index[first].tolist()]
        for i in np.flatnonzero(whole).tolist():
            heads[i] = texts[i].as_py()
        nothing, end = len(blobs), len(blobs) + 1
        if whole.any():
            index[np.repeat(whole, np.diff(bounds))] = nothing
        index[first] = end + 1 + np.arange(len(texts))
        blobs = [b or b"" for b in blobs] + [b"", self.end] + [b for i in range(0, len(heads), 500) for b in self._encode(heads[i : i + 500])]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.width
        flat = np.frombuffer(b"".join(blobs), self.dtype)
        index = np.insert(index, bounds[1:], end)
        take = sizes[index]
        ends = np.cumsum(take)
        starts = (np.cumsum(sizes) - sizes)[index]
        ids = flat[np.repeat(starts - ends + take, take) + np.arange(ends[-1])]
        return ids, np.r_[0, ends[bounds[1:] + np.arange(len(texts))]]


@kept(2)
def encoder(path: str, end_id: int, width: int = 4, memo: int = MEMO) -> Encoder:
    """One encoder per Python worker; its memo lives on from task to task, until the language model's tasks drop it."""
    return Encoder(path, end_id, width, memo)


def slices(batch: pa.RecordBatch, chars: int = PART):
    """Parts of a batch of about so many bytes of text, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    part = np.cumsum(sizes) // chars
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(sizes)]
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)
