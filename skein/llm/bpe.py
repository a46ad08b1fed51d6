"""Byte-pair encoding by a segment tree over pair ranks, and decoding.

A word's symbols stand in a row; each leaf of its tree holds the rank and place of one adjacent pair,
each inner node the least of its two children, so the root is the leftmost pair of lowest rank.  A merge
changes three leaves, each in logarithmic time, until the root says that no pair can be merged.  Short
words are worked on many at once, as trees that are rows of one array; a long word has a tree of its own.

Texts are cut at white space and each different piece is encoded once for a chunk, as ``tokens`` does;
what is ASCII is lower-cased and split here, other pieces go through the normalizer and the splitting of
the vocabulary file, whose Unicode tables decide.  Merging is never the library's.

Defined cases: a null or empty text has no ids and decodes to an empty text; the strings of special tokens
give their ids; a very long text is a chunk of its own and a very long word takes n log n steps; repeated
rows are encoded each; ids outside of the vocabulary are left out when decoding; null ids decode to null; an
empty table stays empty; columns of any name stay, and a name given for a result that exists is an error.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.tokens import CALL, WordEncoder, _Known, chunks, load, tokenizer_path

#: A root (or leaf) without a pair; a leaf is the rank, shifted, and the place.
NONE = np.int64(1) << 62
_PLACE = (1 << 32) - 1
#: Bytes of text of which each different piece is encoded once.
CHUNK = 4 << 20
#: Symbols from which a word gets a tree of its own.
ALONE = 512
#: Ids below which pairs have a table of their own.
FIRST = 512
#: Leaves that are worked on at once.
LEAVES = 1 << 20

#: The splitting pattern of the vocabulary file, over lower-case ASCII.
_ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Of an ASCII byte: 0 white space, 1 a letter, 2 a digit, 3 another.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]], _KINDS[97:123], _KINDS[48:58] = 0, 1, 2


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: printable Latin ones for themselves, the others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in seen else next(hidden)) for b in range(256)]


class Merges:
    """Ranks of pairs of a vocabulary with word ends, and the merging of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab: dict[str, int] = said["model"]["vocab"]
        end = said["model"]["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        names = [None] * self.size
        for token, i in (vocab | self.added).items():
            names[i] = token
        self.tokens = pa.array(names, pa.string())
        pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(said["model"]["merges"])}
        keys = np.fromiter((a * self.size + b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))[order]
        self.merged = np.zeros(len(said["model"]["merges"]), np.int64)
        for rank, new in pairs.values():
            self.merged[rank] = new
        # symbols by the code point of a byte's character, and by the byte: inside a word, and at its end
        self.by_character, self.by_byte = np.full((2, 512), -1, np.int64), np.full((2, 256), -1, np.int64)
        for b, c in enumerate(byte_characters()):
            for last, token in enumerate((c, c + end)):
                self.by_byte[last, b] = self.by_character[last, ord(c)] = vocab[token]

        #: Ranks of pairs of single bytes, where a word's leaves begin; their ids are the first ones.
        self.first = np.full((FIRST, FIRST), NONE)
        low = (self.keys // self.size < FIRST) & (self.keys % self.size < FIRST)
        self.first[self.keys[low] // self.size, self.keys[low] % self.size] = self.ranks[low] << 32

    def first_leaves(self, symbols: np.ndarray) -> np.ndarray:
        """The leaves of rows of single bytes' symbols, of which the last column is -1."""
        found = self.first[symbols[:, :-1], symbols[:, 1:]] | np.arange(symbols.shape[1] - 1)
        return np.where((symbols[:, 1:] >= 0) & (found < NONE), found, NONE)

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf of each pair; symbols below 0 pair with nothing."""
        wanted = left * self.size + right
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = (self.keys[found] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[found] << 32 | at, NONE)

    def merge_rows(self, symbols: np.ndarray) -> None:
        """Merges the words that are rows of ``symbols`` (-1 behind their ends), in place; what a merge takes away becomes -1."""
        rows, width = symbols.shape
        base = 1 << max(1, (width - 1).bit_length())
        sym = np.full((rows, base + 1), -1, np.int64)
        sym[:, :width] = symbols
        tree = np.full((rows, 2 * base), NONE)
        tree[:, base:] = self.first_leaves(sym) if max(self.by_byte.max(), 0) < FIRST else self.leaves(sym[:, :-1], sym[:, 1:], np.arange(base))
        level = base >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        after, before = np.tile(np.arange(1, base + 2), (rows, 1)), np.tile(np.arange(-1, base), (rows, 1))
        flat_sym, flat_tree, flat_after, flat_before = sym.ravel(), tree.ravel(), after.ravel(), before.ravel()
        live = np.arange(rows)

        def put(trees: np.ndarray, place: np.ndarray, leaf: np.ndarray) -> None:
            """A point update: the leaf, and the nodes above it."""
            node = place + base
            flat_tree[trees + node] = leaf
            while True:
                node = node >> 1
                if not node[0]:
                    return
                two = trees + 2 * node
                flat_tree[trees + node] = np.minimum(flat_tree[two], flat_tree[two + 1])

        while True:
            root = flat_tree[live * 2 * base + 1]
            going = root < NONE
            live, root = live[going], root[going]
            if not len(live):
                break
            at, trees, own = root & _PLACE, live * 2 * base, live * (base + 1)
            gone = flat_after[own + at]
            right = np.minimum(flat_after[own + gone], base)
            new = self.merged[root >> 32]
            flat_sym[own + at], flat_sym[own + gone] = new, -1
            flat_after[own + at], flat_before[own + right] = right, at
            left = flat_before[own + at]
            put(trees, gone, np.full(len(live), NONE))
            put(trees, at, self.leaves(new, flat_sym[own + right], at))
            has = np.flatnonzero(left >= 0)
            if len(has):
                put(trees[has], left[has], self.leaves(flat_sym[own[has] + left[has]], new[has], left[has]))
        symbols[:] = sym[:, :width]

    @functools.cached_property
    def _of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def merge_one(self, symbols: list[int]) -> list[int]:
        """Merges one long word."""
        of, merged, size, none, n = self._of, self.merged, self.size, int(NONE), len(symbols)
        base = 1 << max(1, (n - 1).bit_length())
        sym, after, before = [*symbols, -1], list(range(1, n + 2)), list(range(-1, n))
        tree = [none] * base + self.leaves(np.array(symbols), np.array([*symbols[1:], -1]), np.arange(n)).tolist() + [none] * (base - n)
        for node in range(base - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(place: int, leaf: int) -> None:
            node = place + base
            tree[node] = leaf
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        def leaf(a: int, b: int, place: int) -> int:
            rank = of.get(a * size + b) if a >= 0 and b >= 0 else None
            return none if rank is None else rank << 32 | place

        while (root := tree[1]) < none:
            at = root & _PLACE
            gone = after[at]
            right = min(after[gone], n)
            new = int(merged[root >> 32])
            sym[at], sym[gone], after[at] = new, -1, right
            if right < n:
                before[right] = at
            put(gone, none)
            put(at, leaf(new, sym[right], at))
            left = before[at]
            if left >= 0:
                put(left, leaf(sym[left], new, left))
        return [s for s in sym if s >= 0]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and their numbers for words whose symbols lie one after another."""
        starts = np.cumsum(sizes) - sizes
        kept = np.ones(len(symbols), bool)
        out = symbols.copy()
        width = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for w in np.unique(width[(sizes > 1) & (sizes < ALONE)]).tolist():
            group = np.flatnonzero((width == w) & (sizes > 1) & (sizes < ALONE))
            for own in np.split(group, range(max(1, LEAVES // w), len(group), max(1, LEAVES // w))):
                inside = np.arange(w) < sizes[own, None]
                at = (starts[own, None] + np.arange(w))[inside]
                rows = np.full((len(own), w), -1, np.int64)
                rows[inside] = symbols[at]
                self.merge_rows(rows)
                out[at] = rows[inside]
                kept[at] = rows[inside] >= 0
        for i in np.flatnonzero(sizes >= ALONE).tolist():
            own = slice(int(starts[i]), int(starts[i] + sizes[i]))
            ids = self.merge_one(symbols[own].tolist())
            out[own.start : own.start + len(ids)] = ids
            kept[own.start + len(ids) : own.stop] = False
        before = np.concatenate([[0], np.cumsum(kept)])
        return out[kept], before[starts + sizes] - before[starts]


@functools.cache
def merges(path: str) -> Merges:
    """The worker's ranks, made on first use."""
    return Merges(path)


class TreeEncoder(WordEncoder):
    """Encodes pieces of texts with ``Merges``."""

    def __init__(self, path: str):
        self.path, self.merges = path, merges(path)
        self.vocab, self.specials = self.merges.size, list(self.merges.added)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known = _Known(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        self.marks = self.merges.by_byte[1][[ord("."), ord(",")]].astype(np.uint32)  # words of their own

    def _ascii_words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words, the words' sizes, and each word's piece."""
        whole = "\n".join(pc.ascii_lower(pieces).to_pylist()).encode()
        bounds = np.cumsum(pc.binary_length(pieces).to_numpy() + 1)  # a line break stands behind each piece
        letters = np.frombuffer(whole, np.uint8)
        if b"'" in whole:
            spans = np.array([m.span() for m in _ASCII_WORDS.finditer(whole)], np.int64).reshape(-1, 2)
            starts, sizes = spans[:, 0], spans[:, 1] - spans[:, 0]
        else:  # the pattern's last three choices: runs of one class, digits one by one
            kind = _KINDS[letters]
            first = np.flatnonzero((kind > 0) & ((kind != np.concatenate([[0], kind[:-1]])) | (kind == 2)))
            past = np.flatnonzero((kind > 0) & ((kind != np.concatenate([kind[1:], [0]])) | (kind == 2))) + 1
            starts, sizes = first, past - first
        last = np.cumsum(sizes) - 1
        inside = letters[np.repeat(starts - (last + 1 - sizes), sizes) + np.arange(int(sizes.sum()))]
        symbols = self.merges.by_byte[0][inside]
        symbols[last] = self.merges.by_byte[1][inside[last]]
        return symbols, sizes, np.searchsorted(bounds, starts, side="right")

    def _other_words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for pieces with other characters, by the vocabulary file's normalizer and splitting."""
        tokenizer, said = load(self.path), pieces.to_pylist()
        split = lambda text: tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
        if all(p[1:].isprintable() and " " not in p[1:] and p[0] in " \n" for p in said):  # one blank before each: all at once
            normal = tokenizer.normalizer.normalize_str("".join(said))
            found = tokenizer.pre_tokenizer.pre_tokenize_str(normal)
            blanks = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
            piece = np.searchsorted(blanks, np.fromiter((at for _, (at, _) in found), np.int64, len(found)), side="right") - 1
            words = [w for w, _ in found]
        else:
            each = [split(p) for p in said]
            words = [w for found in each for w, _ in found]
            piece = np.repeat(np.arange(len(each)), [len(found) for found in each])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(sizes) - 1
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.merges.by_character[0][letters]
        symbols[last] = self.merges.by_character[1][letters[last]]
        return symbols, sizes, piece

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = pc.equal(pc.binary_length(pieces), pc.utf8_length(pieces)).to_numpy(zero_copy_only=False)
        simple = pc.match_substring_regex(pieces, self.plain).to_numpy(zero_copy_only=False)
        quoted = pc.match_substring(pieces, "'").to_numpy(zero_copy_only=False)
        order, ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for group, words_of in ((plain & ~quoted, self._ascii_words), (plain & quoted, self._ascii_words), (~plain & simple, self._other_words), (~plain & ~simple, self._other_words)):
            at = np.flatnonzero(group)
            for part in np.split(at, range(CALL, len(at), CALL)) if len(at) else ():
                symbols, n, piece = words_of(pieces.take(pa.array(part)))
                found, counts = self.merges.merge(symbols, n)
                order.append(part)
                ids.append(found.astype(np.uint32))
                sizes.append(np.bincount(piece, weights=counts, minlength=len(part)).astype(np.int64))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(sizes)

    def alone(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts with special tokens: what stands between them is encoded on its own."""
        ids, counts = [np.zeros(0, np.uint32)], []
        for text in texts.to_pylist():
            parts = self.special.split(text)
            found, starts, n = self.encode(pa.array([p for p in parts if p not in self.merges.added], pa.large_string()))
            between = iter(zip(starts.tolist(), n.tolist(), strict=True))
            row = [np.array([self.merges.added[p]], np.uint32) if p in self.merges.added else (lambda s, k: found[s : s + k])(*next(between)) for p in parts]
            ids += row
            counts.append(sum(map(len, row)))
        return np.concatenate(ids), np.array(counts, np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray, skip: frozenset[int] = frozenset()) -> pa.Array:
        """The texts of ids that lie one after another: their tokens with a space between."""
        wanted = ids < self.vocab
        if skip:
            wanted &= ~np.isin(ids, list(skip))
        tokens = self.merges.tokens.take(pa.array(np.minimum(ids, self.vocab - 1).astype(np.int64)))
        wanted &= ~pc.is_null(tokens).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(wanted)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        tokens = tokens.filter(pa.array(wanted)) if not wanted.all() else tokens
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), tokens), " ")


@functools.cache
def tree_encoder(path: str) -> TreeEncoder:
    """The worker's encoder, made on first use."""
    return TreeEncoder(path)


def _binaries(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary for each text: its ids as little-endian unsigned 32-bit integers."""
    ends = np.cumsum(counts)
    data = values if np.array_equal(starts, ends - counts) else values[np.repeat(starts - (ends - counts), counts) + np.arange(int(counts.sum()))]
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data.astype("<u4").tobytes())])


def _added(df: DataFrame, column: str, name: str, kind: T.DataType, made) -> DataFrame:
    """``df`` with one more column, ``name``, that ``made`` gives for slices of ``column``: pairs of a slice's start and its array."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"a column {name!r} exists already; name another for the result")
    place = df.columns.index(column)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, found in made(b.column(place)):
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(found)).columns, found], names=[*b.schema.names, name])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text``: a binary of little-endian unsigned 32-bit integers, empty for null."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def made(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        for at, texts in chunks(column, CHUNK):
            yield at, _binaries(*tree_encoder(path).encode(texts))

    return _added(docs, text, ids, T.BinaryType(), made)


def decode(coded: DataFrame, ids: str = "ids", text: str = "decoded", tokenizer: str | None = None, skip_special: bool = False) -> DataFrame:
    """``coded`` with the text that ``ids`` stand for; null for null ids."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def made(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        for at, own in chunks(column):
            e = tree_encoder(path)
            counts = pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            data = np.frombuffer(b"".join(own.drop_null().to_pylist()), "<u4")
            found = e.decode(data, counts, frozenset(e.merges.added.values()) if skip_special else frozenset())
            yield at, pc.if_else(own.is_null(), pa.scalar(None, pa.string()), found) if own.null_count else found

    return _added(coded, ids, text, T.StringType(), made)


def report(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_tokens, and digests of the ids and of the text that they decode to."""
    both = decode(encode(docs.select("doc_id", "text")).drop("text"))
    return both.select("doc_id", F.shiftright(F.octet_length("ids").cast("long"), 2).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
