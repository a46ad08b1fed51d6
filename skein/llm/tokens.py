"""Encoding of whole texts with the ``tokenizers`` library, chunk by chunk.

A text is cut only at places where its tokenizer's pre-tokenizer always cuts as well, so
the ids of the pieces, put together, are the ids of the text.  Of a chunk of texts each
different piece is encoded once by the library, and its ids are dealt to all its places by
array operations; the first ``REMEMBERED`` pieces are remembered for a worker's next chunks.

* Null text counts as empty and has no ids.  Texts that hold a special token's string go to
  the library whole, which gives that token's id as a plain call does.
* Memory: chunks of ``CHUNK`` bytes (a longer text is a chunk of its own) and the remembered
  pieces, some 10 MB for each vocabulary.
* Texts with odd white space are cut by a regular expression, the others by Arrow.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
CHUNK = 2 << 20
#: Pieces that a worker remembers (some 25 bytes each).
REMEMBERED = 400_000
#: Pieces in one call of the library.
CALL = 20_000

_BLANK = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: White space beside other white space, or at either end; and the mark that Arrow cuts at.
_ODD = rf"[{_BLANK}][{_BLANK}]|\A[{_BLANK}]|[{_BLANK}]\z|\x00"
#: Before a single space or line break between two visible characters.
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def load(path: str):
    """The worker's tokenizer, made on first use."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _widths(path: str) -> np.ndarray:
    """Bytes of text behind each token (one character of a token is one byte; a mark of a word's end is none)."""
    tokenizer = load(path)
    width = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        width[i] = len(token.removesuffix("</w>"))
    return width


@dataclass
class _Known:
    """Pieces with their ids, one after another."""

    pieces: pa.Array
    sizes: np.ndarray
    ids: np.ndarray


class _Encoder:
    #: Pieces that may be joined: they begin with one blank and end visibly.
    plain: str

    def __init__(self, path: str):
        self.path, self.tokenizer = path, load(path)
        self.vocab = self.tokenizer.get_vocab_size()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def alone(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids and their numbers, each text on its own in a library call."""
        found = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), np.fromiter(map(len, found), np.int64, len(found))

    def ends(self, pieces: pa.Array, text: str) -> np.ndarray:
        """Where each piece of ``text`` ends, in bytes behind tokens."""
        raise NotImplementedError

    def _joined(self, pieces: pa.Array, tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """``alone`` for plain pieces: one library call, whose tokens are cut where the pieces end."""
        whole = bytes(memoryview(pieces.buffers()[2])[: pc.sum(pc.binary_length(pieces)).as_py()]).decode()  # ``take`` left them one after another
        [found] = (tokenizer or self.tokenizer).encode_batch_fast([whole], add_special_tokens=False)
        ids, ends = np.array(found.ids, np.uint32), self.ends(pieces, whole)
        reach = np.cumsum(_widths(self.path)[ids])
        cuts = np.searchsorted(reach, ends) + 1
        if len(ends) != len(pieces) or not np.array_equal(reach[np.minimum(cuts, len(reach)) - 1], ends):  # a cut that the library did not make
            return self.alone(pieces)
        return ids, np.diff(cuts, prepend=0)

    def _words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``alone`` for plain pieces of the letters a-z."""
        return self._joined(pieces)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ``pieces`` in the order of learning, their ids, and the numbers of ids."""
        words = pc.match_substring_regex(pieces, r"\A[ \n][a-z]+\z").to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(pieces, self.plain).to_numpy(zero_copy_only=False)
        ascii_ = pc.equal(pc.binary_length(pieces), pc.utf8_length(pieces)).to_numpy(zero_copy_only=False)
        order, ids, sizes = [], [], []
        for group, by in ((words, self._words), (plain & ascii_ & ~words, self._joined), (plain & ~ascii_, self._joined), (~plain, self.alone)):
            at = np.flatnonzero(group)
            for part in np.split(at, range(CALL, len(at), CALL)) if len(at) else ():
                found, n = by(pieces.take(pa.array(part)))
                order.append(part)
                ids.append(found)
                sizes.append(n)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *order]), np.concatenate([none.astype(np.uint32), *ids]), np.concatenate([none, *sizes])

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids; starts and sizes of each piece in them."""
        k = self.known
        place = pc.fill_null(pc.index_in(pieces, value_set=k.pieces), -1).to_numpy()
        new = np.flatnonzero(place < 0)
        order, ids, n = self._learn(pieces.take(pa.array(new)))
        at = np.empty(len(pieces), np.int64)
        at[place >= 0] = place[place >= 0]
        at[new[order]] = len(k.sizes) + np.arange(len(order))
        whole, sizes = np.concatenate([k.ids, ids]), np.concatenate([k.sizes, n])
        room = REMEMBERED - len(k.sizes)
        if room > 0:
            kept = pieces.take(pa.array(new[order[:room]]))
            self.known = _Known(pa.concat_arrays([k.pieces, kept]), np.concatenate([k.sizes, n[:room]]), np.concatenate([k.ids, ids[: int(n[:room].sum())]]))
        return whole, (np.cumsum(sizes) - sizes)[at], sizes[at]

    def odd(self, texts: pa.Array) -> np.ndarray:
        """True for texts that Arrow must not cut."""
        return pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        return pc.split_pattern(marked, "\0")

    def _dealt(self, lists: pa.ListArray, counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and their number for each text."""
        coded = lists.flatten().dictionary_encode()
        flat, starts, sizes = self._ids_of(coded.dictionary)
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts = np.diff(np.concatenate([[0], ends])[bounds])
        if counts_only:
            return np.zeros(0, np.uint32), counts
        return flat[np.repeat(starts[which] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], counts

    def encode(self, texts: pa.Array, counts_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts, counts: text i has ``ids[starts[i] : starts[i] + counts[i]]``."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = self.odd(texts) & ~special
        starts, counts, parts, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        for group in (~odd & ~special, odd, special):
            at = np.flatnonzero(group)
            if not len(at):
                continue
            own = texts if len(at) == len(texts) else texts.take(pa.array(at))
            if group is special:
                ids, n = self.alone(own)
            elif group is odd:
                ids, n = self._dealt(pa.array([_SAFE.split(t) for t in own.to_pylist()], pa.large_list(pa.large_string())), counts_only)
            else:
                ids, n = self._dealt(self._cut(own), counts_only)
            starts[at], counts[at] = total + np.cumsum(n) - n, n
            parts.append(ids)
            total += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), starts, counts


class ByteLevelEncoder(_Encoder):
    """Byte-level BPE whose pattern gives one leading space to the word after it."""

    plain = rf"(?s)\A[ \n][^{_BLANK}](.*[^{_BLANK}])?\z"

    def ends(self, pieces: pa.Array, text: str) -> np.ndarray:
        return np.cumsum(pc.binary_length(pieces).to_numpy())


class WordEncoder(_Encoder):
    """Word BPE that drops white space: every space and line break is a cut, whatever is beside it."""

    plain = rf"\A[ \n][^{_BLANK}]+\z"
    #: Letters (without İ, whose small form ends in a mark) with a full stop or comma behind, which is a token of its own.
    marked = r"\A[ \n]?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,]\z"

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        #: The same model for words of a-z, which the normalizer leaves as they are and the pattern cuts at blanks alone.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.marks = np.array([self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"], np.uint32)[:, 0]

    def _words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._joined(pieces, self.bare)

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that differ in A-Z and a-z (in ASCII alone, as NFC has some marks for one of them) or in a mark behind are encoded once."""
        pieces = pc.if_else(pc.equal(pc.binary_length(pieces), pc.utf8_length(pieces)), pc.ascii_lower(pieces), pieces)
        marked = pc.match_substring_regex(pieces, self.marked).to_numpy(zero_copy_only=False)
        order, n = np.argsort(marked, kind="stable"), int(marked.sum())
        ordered = pieces.take(pa.array(order))
        cut = ordered.slice(len(pieces) - n)
        coded = pa.concat_arrays([ordered.slice(0, len(pieces) - n), pc.utf8_slice_codeunits(cut, 0, -1)]).dictionary_encode()
        flat, starts, sizes = super()._ids_of(coded.dictionary)
        which = np.empty(len(pieces), np.int64)
        which[order] = coded.indices.to_numpy()
        starts, sizes = starts[which], sizes[which] + marked
        ends = np.cumsum(sizes)
        own = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        ids = flat.take(own, mode="clip") if len(own) else flat[:0]  # a mark's place is overwritten
        ids[ends[order[len(pieces) - n :]] - 1] = self.marks[pc.ends_with(cut, ",").to_numpy(zero_copy_only=False).astype(int)]
        return ids, ends - sizes, sizes

    def odd(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)

    def ends(self, pieces: pa.Array, text: str) -> np.ndarray:
        if text.isascii():
            return np.cumsum(pc.binary_length(pieces).to_numpy() - 1)
        seen = np.frombuffer(self.tokenizer.normalizer.normalize_str(text).encode(), np.uint8)
        blanks = np.flatnonzero(seen == 32)
        return np.append(blanks[1:], len(seen)) - np.arange(1, len(blanks) + 1)


@functools.cache
def encoder(kind: str, path: str) -> _Encoder:
    """The worker's encoder (``kind``: ``byte`` or ``word``), made on first use."""
    return {"byte": ByteLevelEncoder, "word": WordEncoder}[kind](path)


def chunks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of some ``size`` bytes (``CHUNK``): the first one's place, and the texts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + (size or CHUNK), side="right")))
        yield start, column.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # what Arrow keeps of chunks would stay with the worker
