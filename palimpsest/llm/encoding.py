"""Exact token ids of whole texts, with the encodings of repeated words kept.

Both public byte-pair tokenizers start a new pre-token at a space or line end that stands
between two characters that are not white space, and between letters and marks that end a piece.
Text is cut there, the tokenizers library encodes each distinct piece once per worker, and the ids
are joined, so the result equals encoding the whole text. Cutting, looking up and joining are
columnar: pieces are Arrow strings and their ids slices of one pool. New pieces are encoded many at
a time. Words of letters alone are told apart by the tokens that only begin, or only end, a word;
other pieces by a bar between them, whose id no piece without a bar gives.
Up to KEPT pieces are held; then the half that was used longest ago is forgotten, and when a task ends all but AT_REST.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT, ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"[|\s]")
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts whose white space does not stand alone between two other characters, and the empty text.
UNEVEN = f"^$|^{SPACE}|{SPACE}{SPACE}|{SPACE}$"
#: Western letters and the marks after them, that never belong to one pre-token.
ENDED = r"^(?P<word>\n?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[!-/:-@\[-`{-~]{1,3})$"
KEPT, AT_REST, AT_ONCE, CHUNK_BYTES = 400_000, 100_000, 8_000, 2_000_000
_encoders: dict[str, Encoder] = {}


def pieces_of(texts: pa.Array) -> pa.ListArray:
    """Each text cut at each space and line end between two characters that are not white space; a piece that a line
    end came before starts with it, the first piece of a text as if one had."""
    uneven = pc.match_substring_regex(texts, UNEVEN)
    even = texts if not pc.any(uneven).as_py() else texts.filter(pc.invert(uneven))
    cut = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(even, "\n", " \n"), ""), " ")
    if len(even) == len(texts):
        return cut
    held = [CUT.split(f"\n{t}") if t else [] for t in texts.filter(uneven).to_pylist()]
    flags = uneven.to_numpy(zero_copy_only=False)
    place = np.where(flags, len(even) + np.cumsum(flags) - 1, np.cumsum(~flags) - 1)
    return pa.concat_arrays([cut, pa.array(held, cut.type)]).take(pa.array(place))


class Encoder:
    """encode(texts): the token ids of all texts and the offsets at which each text's begin."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.bar,) = self.tokenizer.encode(" |", add_special_tokens=False).ids
        self.line_end = self._encode("\n")
        last = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.marks_end = bool(last)
        self.marked = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.marked[i] = token.endswith(last) if last else token.startswith("Ġ")
        self.pieces = pa.array([], pa.string())
        self.pool, self.begins, self.sizes, self.used = (np.zeros(0, kind) for kind in ("<u4", np.int32, np.int32, np.int32))
        self.now = 0

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_words(self, words: list[str], learned: dict[str, bytes]) -> list[str]:
        """Adds the ids of words of letters after a space; returns them instead if the tokens don't tell them apart."""
        ids = self._ids(f" {' '.join(words)}")
        marks = np.flatnonzero(self.marked[ids])
        ends = marks + 1 if self.marks_end else np.append(marks[1:], len(ids))
        if len(marks) != len(words) or ends[-1] != len(ids) or not (self.marks_end or marks[0] == 0):
            return words
        raw, begin = ids.tobytes(), 0
        for p, end in zip(words, (4 * ends).tolist()):
            learned[p] = raw[begin:end]
            begin = end
        return []

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of every piece after a space, of the line end that it starts with and its rest, or of the marks that
        end a word, which start with a tab."""
        words, plain, odd = list[str](), list[str](), list[str]()
        learned = dict.fromkeys(pieces, b"")
        for p in pieces:
            (words if p.isalpha() else odd if p[0] == "\t" or ODD.search(p, p[0] == "\n") else plain).append(p)
        for i in range(0, len(words), AT_ONCE):
            plain += self._learn_words(words[i : i + AT_ONCE], learned)
        for i in range(0, len(plain), AT_ONCE):
            some = plain[i : i + AT_ONCE]
            ids = self._ids("".join([f"{p} |" if p[0] == "\n" else f" {p} |" for p in some]))
            raw, begin = ids.tobytes(), 0
            for p, end in zip(some, (4 * np.flatnonzero(ids == self.bar)).tolist(), strict=True):
                learned[p] = raw[begin:end]
                begin = end + 4
        for p in odd:
            learned[p] = self._encode(p[1:]) if p[0] == "\t" else self.line_end + self._encode(p[1:]) if p[0] == "\n" else self._encode(" " + p)
        return learned

    def _forget(self, kept: int) -> None:
        """Holds on to the pieces that were used last."""
        order = np.sort(np.argsort(self.used, kind="stable")[-kept:])
        sizes = self.sizes[order]
        self.pool = self.pool[_slices(self.begins[order], sizes)]
        self.pieces, self.used, self.sizes, self.begins = self.pieces.take(pa.array(order)), self.used[order], sizes, (np.cumsum(sizes) - sizes).astype(np.int32)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces are held; new ones are learned first."""
        self.now += 1
        at = pc.index_in(pieces, self.pieces)
        if at.null_count and len(self.pieces) + at.null_count > KEPT:
            self.used[at.drop_null().to_numpy()] = self.now
            self._forget(KEPT // 2)
            at = pc.index_in(pieces, self.pieces)
        missing = at.is_null()
        new = missing.to_numpy(zero_copy_only=False)
        found = np.where(new, len(self.pieces) + np.cumsum(new) - 1, at.fill_null(0).to_numpy())
        if at.null_count:
            learned = pieces.filter(missing)
            ids = list(self._learn(learned.to_pylist()).values())
            sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
            self.begins = np.concatenate([self.begins, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.full(len(sizes), self.now, np.int32)])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
            self.pieces = pa.concat_arrays([self.pieces, learned])
        self.used[found] = self.now
        return found

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, each text's with end_id at its end, and the offsets of each text;
        null is the empty text."""
        lists = pieces_of(pc.fill_null(texts.cast(pa.string()), ""))
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, ENDED)
        whole = pc.coalesce(pc.struct_field(parts, "word"), coded.dictionary).dictionary_encode()
        tails = pc.struct_field(parts, "tail").dictionary_encode()
        n, at = len(whole.dictionary), np.full((len(coded.dictionary), 2), -1, np.int32)
        at[:, 0] = whole.indices
        at[:, 1] = pc.fill_null(pc.add(tails.indices, n), -1)
        held = self._places(pa.concat_arrays([whole.dictionary, pc.binary_join_element_wise("\t", tails.dictionary, "")]))
        at = at[coded.indices.to_numpy()]
        begins, sizes = self.begins[held][at], np.where(at >= 0, self.sizes[held][at], 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        first = bounds[:-1][counts > 0]  # the line end before a text is not its own
        skip = len(self.line_end) >> 2
        begins[first, 0] += skip
        sizes[first, 0] -= skip
        ids = self.pool[_slices(begins.ravel(), sizes.ravel())]
        offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])[bounds]
        if end_id is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))

    def encoded(self, batches: Iterator[pa.RecordBatch], text_at: int, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of a task's batches with their ids and offsets; what the next task is unlikely to need goes at the end."""
        for batch in text_chunks(batches, text_at):
            yield batch, *self.encode(batch.column(text_at), end_id)
        if len(self.pieces) > AT_REST:
            self._forget(AT_REST)


def _slices(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions begin .. begin + size - 1 of each slice, one slice after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_chunks(batches: Iterator[pa.RecordBatch], text_at: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `size` bytes of text at most; one long text may exceed it alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy()
        begin = 0
        while begin < batch.num_rows:
            end = begin + max(1, int(np.searchsorted(np.cumsum(lengths[begin:]), size, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
