"""Token ids of texts, with the ids of text segments remembered.

A segment is a piece of text whose ids don't depend on what stands around it, so the ids of
a text are those of its segments in a row. Texts are cut on their bytes in Arrow, equal
segments of a batch become one dictionary entry, and the tokenizer itself, unchanged, encodes
every entry that is not remembered yet. When `MEMORY` segments are new, the memory keeps only
what was seen since it was full the last time.

Where a text is cut: in front of a run of white space, in front of the run's last character
if more text follows, and behind that character unless it is a space (a byte-level token may
start with one space, and the last white space of a run never joins the others); and between
an ASCII letter or digit and an ASCII mark other than the apostrophe. For vocabularies
that drop white space any cut there is right. Texts that hold the string of an
added token, or white space outside ASCII, are one segment.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY = 600_000
#: Segments up to so many characters are remembered.
SHORT = 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WORD = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_MARK = np.isin(np.arange(256), list(rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""))
#: White space that is longer than a byte, or counted as such by some pattern libraries only.
_RARE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array without nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    _valid, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def segments(texts: pa.Array, whole: np.ndarray) -> pa.Array:
    """The segments of all texts in a row; an empty one stands behind each text's last.
    Texts at the places `whole` are not cut."""
    data, at = _buffers(texts)
    size = len(data)
    starts = np.zeros(size + 1, bool)
    starts[at] = True
    space = np.append(_SPACE[data], False)
    i = np.flatnonzero(space)
    cut = starts[:size].copy()
    cut[i[~space[i - 1]]] = True  # at i = 0 this looks at the added False; a start is a cut anyway
    last = i[~space[i + 1] & ~starts[i + 1]]
    cut[last] = True
    cut[last[data[last] != 32] + 1] = True
    cut[1:] |= _WORD[data[:-1]] & _MARK[data[1:]]
    for d in whole:
        cut[at[d] + 1:at[d + 1]] = False
    inner = np.flatnonzero(cut).astype(np.int32)
    begin = np.insert(inner, np.searchsorted(inner, at[1:]), at[1:])
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, np.int32(size))), pa.py_buffer(np.ascontiguousarray(data)))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring_regex(texts, _RARE)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return np.flatnonzero(odd.to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by `end_id`, and the number of
        ids of each text. A null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        coded = segments(texts, self._whole(texts)).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.ids) > MEMORY:
            self.ids, self.before = {}, self.ids
        known, before = self.ids, self.before
        parts = [known.get(w) for w in words]
        missing = [i for i, part in enumerate(parts) if part is None]
        new = []
        for i in missing:
            word = words[i]
            if not word:
                parts[i] = array("I", [end_id]).tobytes()
            elif (part := before.get(word)) is not None:
                parts[i] = known[word] = part
            else:
                new.append(i)
        for i, code in zip(new, self.tokenizer.encode_batch_fast([words[i] for i in new], add_special_tokens=False)):
            parts[i] = array("I", code.ids).tobytes()
            if len(words[i]) <= SHORT:
                known[words[i]] = parts[i]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()),
                                         pa.array(np.frombuffer(b"".join(parts), "<u4")))
        taken = lists.take(coded.indices)
        at = taken.offsets.to_numpy()
        ends = at[1:][np.flatnonzero(coded.indices.to_numpy() == words.index(""))] if words else np.zeros(0, np.int32)
        return taken.values.to_numpy()[at[0]:at[-1]], np.diff(ends - at[0], prepend=0).astype(np.int64)


def cut_ids(ids: np.ndarray, sizes: np.ndarray, capacity: int, short_first: bool = False) -> dict[str, pa.Array]:
    """Pieces of at most `capacity` ids: `row` (place in `sizes`), `piece` (from 0 in its text),
    `start`, `length`, `ids` (binary, little-endian unsigned 32-bit). All pieces of a text but
    its last one, or with `short_first` its first one, are full. Every text has an id."""
    many = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    lead = (sizes - (many - 1) * capacity if short_first else np.minimum(sizes, capacity))[row]
    start = np.where(piece == 0, 0, lead + (piece - 1) * capacity)
    stop = np.minimum(lead + piece * capacity, sizes[row])
    at = np.append((np.cumsum(sizes) - sizes)[row] + start, len(ids)) * 4
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return {"row": pa.array(row, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
            "length": pa.array(stop - start, pa.int64()),
            "ids": pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.astype(np.int32)), data])}


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """The worker process's encoder: its next tasks find what this one remembers."""
    return Encoder(path)
