"""Whole-text tokenization with public tokenizer files, once per distinct piece.

A text is cut only at places where both kinds of vocabulary always start a new
word: before white space that follows a word, and before punctuation that
follows a letter.  Equal pieces then get equal ids, so each distinct piece is
encoded once and its ids are gathered by numpy; the result is what the library
returns for the whole text (tested against it).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cloakframe.llm.common import raw, slices, text_array

_SPACE, _LETTER, _PUNCT, _WORD = 1, 2, 4, 8


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[9, 10, 13, 32]] = _SPACE
    table[33:127] |= _WORD
    table[65:91] |= _LETTER
    table[97:123] |= _LETTER
    for c in b".,!;:?#%&*$":
        table[c] |= _PUNCT
    return table


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, lower: bool) -> "Encoder":
    """One encoder per worker process and file; its cache of pieces serves all tasks of that worker."""
    if (path, lower) not in _ENCODERS:
        _ENCODERS[path, lower] = Encoder(path, lower)
    return _ENCODERS[path, lower]


class Encoder:
    """``lower``: the vocabulary lower-cases and drops white space, so pieces may be lower-cased first."""

    def __init__(self, path: str, lower: bool, cached: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.lower, self.cached = Tokenizer.from_file(path), lower, cached
        special = self.tokenizer.get_added_tokens_decoder()
        self.mark_id = min(special)
        self.mark = special[self.mark_id].content
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [32, *range(0xC0, 0x100)]} | ({32: ""} if lower else {})
        self.letters = "^ ?[a-zß-öø-ÿ]+$" if lower else "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.lens = np.empty(0, np.uint32), np.empty(0, np.int32)

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces in order, and the number of the first piece of every text (and one past the last)."""
        body, offsets = raw(texts)
        kind = _CLASS[body]
        two = np.zeros(len(body), bool)  # second byte of a two-byte letter
        two[1:] = (body[1:] >= 0x80) & (body[:-1] >= 0xC3) & (body[:-1] <= 0xDF)
        latin = np.zeros(len(body), bool)
        latin[1:] = two[1:] & (body[:-1] == 0xC3) & (body[1:] != 0x97) & (body[1:] != 0xB7)
        cut = np.zeros(len(body) + 1, bool)
        cut[1:-1] = ((kind[1:] & _SPACE) != 0) & (((kind[:-1] & _WORD) != 0) | two[:-1])
        cut[1:-1] |= ((kind[1:] & _PUNCT) != 0) & (((kind[:-1] & _LETTER) != 0) | latin[:-1])
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        if self.lower and b"<|" not in body.tobytes():
            body = _LOWER[body]
            body[(kind & _SPACE) != 0] = 32
        else:
            body = np.ascontiguousarray(body)
        pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(body))
        return pieces, np.searchsorted(starts, offsets)

    def _learn(self, fresh: pa.Array) -> None:
        """Encode pieces seen for the first time.

        Pieces of plain letters go to the vocabulary's model at once, many in a
        call, after the byte mapping that the vocabulary's own steps would do;
        all others take the whole path, parted by a special token.
        """
        easy = pc.match_substring_regex(fresh, self.letters)
        plain = fresh.filter(easy).to_pylist()
        rest = fresh.filter(pc.invert(easy)).to_pylist()
        whole = [w for w in rest if "<|" not in w]
        odd = [w for w in rest if "<|" in w]
        ids, lens = [], []
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            got = self.words.encode_batch(["\n".join(part).translate(self.bytes)], add_special_tokens=False)[0]
            lens.append(np.bincount(np.asarray(got.word_ids, np.int64), minlength=len(part)))
            ids.append(np.asarray(got.ids, np.uint32))
        for i in range(0, len(whole), 500):
            part = whole[i : i + 500]
            got = np.asarray(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            gap = np.flatnonzero(got == self.mark_id)
            lens.append(np.diff(np.concatenate([[-1], gap, [len(got)]])) - 1)
            ids.append(np.delete(got, gap))
        for w in odd:
            got = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
            lens.append(np.array([len(got)]))
            ids.append(got)
        self.known = pa.concat_arrays([self.known, pa.array(plain + whole + odd, pa.string())])
        self.ids = np.concatenate([self.ids, *ids])
        self.lens = np.concatenate([self.lens, *lens]).astype(np.int32)

    def encode(self, column: pa.Array):
        """Yield (first row, end row, ids, offsets of the rows in ids) for runs of whole texts."""
        texts = text_array(column)
        for lo, hi in slices(texts, 4 << 20):
            pieces, first = self._pieces(texts.slice(lo, hi - lo))
            coded = pieces.dictionary_encode()
            if len(self.known) + len(coded.dictionary) > self.cached:
                self._forget()
            at = pc.index_in(coded.dictionary, value_set=self.known)
            if at.null_count:
                new = at.is_null()
                fresh = coded.dictionary.filter(new)
                before = len(self.known)
                self._learn(fresh)
                place = pc.index_in(fresh, value_set=self.known.slice(before)).to_numpy(zero_copy_only=False)
                at = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
                at[new.to_numpy(zero_copy_only=False)] = place + before
            else:
                at = at.to_numpy(zero_copy_only=False)
            begin = (np.cumsum(self.lens, dtype=np.int64) - self.lens)[at].astype(np.int32)
            size = self.lens[at]
            index = coded.indices.to_numpy(zero_copy_only=False) if len(pieces) else np.empty(0, np.int32)
            lens = size[index]
            ends = np.zeros(len(lens) + 1, np.int32)
            np.cumsum(lens, out=ends[1:])
            ids = self.ids[np.arange(ends[-1], dtype=np.int32) + np.repeat(begin[index] - ends[:-1], lens)]
            yield lo, hi, ids, ends[first].astype(np.int64)
