"""Encoding whole texts with a public tokenizer, inside tasks.

A tokenizer that lower-cases and whose tokens end at white space gives a text the ids of its words, one after the other. For
such a one, Arrow splits texts and finds the different words of a slice; each worker encodes a word once, and numpy gathers
the ids of all occurrences: an order of magnitude faster than encoding texts. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are letters, then ASCII marks that the tokenizer always splits off: they share the ids of their lower-cased letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;=?@\[\]^_{}~-]*)")


def default_tokenizer() -> str:
    """The word tokenizer's file among the public ones."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words after which a worker's table keeps only those in use.
_KEEP = 300_000


class Encoder:
    """Texts to ids with the tokenizer in ``path``, a ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.by_word = made["model"].get("end_of_word_suffix") == "</w>" and '"Lowercase"' in json.dumps(made["normalizer"])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of lower-case letters, each of which ends in its only token that ends a word: encoded as one text."""
        ids = np.array(self._encode([" ".join(words)])[0], dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return [np.array(x, dtype="<u4").tobytes() for x in self._encode(words)]
        flat, at = ids.tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of new words into the table, as little-endian unsigned 32-bit integers."""
        split = {w: (m[1].lower(), m[2]) for w in words if (m := _PLAIN.fullmatch(w))}
        letters = list({a for a, _ in split.values()}.difference(self.words))
        if letters:
            self.words.update(zip(letters, self._encode_letters(letters), strict=True))
        other = list(words.difference(split).union(b for _, b in split.values()).difference(self.words))
        if other:
            self.words.update((w, np.array(x, dtype="<u4").tobytes()) for w, x in zip(other, self._encode(other), strict=True))
        self.words.update((w, self.words[a] + self.words[b]) for w, (a, b) in split.items())

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self.words) > _KEEP:
            self.words = {w: self.words[w] for w in words if w in self.words} | {"": b""}
        if new := {w for w in words if w not in self.words}:
            self._learn(new)
        return [self.words[w] for w in words]

    def _by_word(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The ids of the different words, which of them each occurrence is, and the occurrences of each text."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        code = lists.flatten().dictionary_encode()
        return self._each(code.dictionary.to_pylist()), code.indices.to_numpy(), pc.list_value_length(lists).to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; none for null."""
        if not self.by_word:
            each = self._encode(pc.fill_null(texts, "").to_pylist())
            return np.array([i for x in each for i in x], dtype="<u4"), np.array([len(x) for x in each], dtype=np.int64)
        parts, at, words = self._by_word(texts)
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        flat, n = np.frombuffer(b"".join(parts), dtype="<u4"), size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        first = (np.cumsum(size) - size)[at] - ends[:-1]
        return flat[np.repeat(first, n) + np.arange(ends[-1])], np.diff(ends[np.concatenate([[0], np.cumsum(words)])])

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        if not self.by_word:
            return self.encode(texts)[1]
        parts, at, words = self._by_word(texts)
        ends = np.concatenate([[0], np.cumsum((np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4)[at])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(words)])])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, 4 bytes each."""
        ids, n = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    return Encoder(path)
