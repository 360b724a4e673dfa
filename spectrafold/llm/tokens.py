"""Exact access to the public tokenizer files inside Python workers.

``word_bpe_49k.json`` splits a text into words before it merges and never across
white space, so a text's ids are those of its words one after another; its batches
go through a bounded word table (``wordtable``).  Other tokenizers are called on
whole texts.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np

from .wordtable import WordTable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file, or ``name`` itself when it is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    """sha256 of the vocabulary file: the tokenizer's version."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WholeEncoder:
    """Ids by the library, text by text."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: piece.encode(texts, num_threads=1)
            self.size = piece.get_piece_size()
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.whole = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.size = self.tokenizer.get_vocab_size()

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their numbers."""
        ids = self.whole(texts)
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())), counts

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, counts = self.batch(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []


class WordEncoder(WholeEncoder):
    """The same ids for tokenizers that lower-case and merge within words of one kind of character (ids below 65536)."""

    def __init__(self, name: str):
        super().__init__(name)
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        tokenize = self.tokenizer.model.tokenize
        self.table = WordTable(self.whole, lambda w: [t.id for t in tokenize(w if w.isascii() else w.translate(as_bytes))])

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.table.batch(texts)


_ENCODERS: dict[str, WholeEncoder] = {}


def encoder(name: str) -> WholeEncoder:
    """This worker's encoder; kept between tasks."""
    if name not in _ENCODERS:
        word_wise = os.path.basename(name).startswith("word_bpe")
        _ENCODERS[name] = (WordEncoder if word_wise else WholeEncoder)(name)
    return _ENCODERS[name]
