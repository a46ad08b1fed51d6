"""What the review of round 4 found in the training-data operators, on inputs that showed it."""

from __future__ import annotations

import pyarrow as pa
from tokenizers import Tokenizer

from skein.llm import bpe
from skein.llm.tokens import tokenizer_path


def test_words_with_a_mark_behind_are_encoded_by_trees():
    """A full stop or comma behind a word is an id of its own; chunk after chunk, as a worker keeps what it learnt."""
    path = tokenizer_path("word_bpe_49k.json")
    library, e = Tokenizer.from_file(path), bpe.TreeEncoder(path)
    for said in ([], ["", None], ["A word. Another, and a word.\nWord,"], ["word, WORD. Éa, éA. İ. ß, a.. b., 1, .", "x" * 700 + ".", "<|endoftext|>a, b."], ["word.", None, "new, word"]):
        ids, starts, counts = e.encode(pa.array(said, pa.string()))
        assert [ids[s : s + n].tolist() for s, n in zip(starts, counts, strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in said]
