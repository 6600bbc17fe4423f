"""Whole-text encoding with a tokenizers file, by way of its words.

A tokenizer whose pre-tokens are encoded independently of each other gives the same ids when every
different word is encoded once. Texts outside a conservative alphabet, and texts that hold one of the
tokenizer's own special strings, go to the library whole, so its Unicode tables always decide.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from itertools import chain, islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
from tokenizers import Tokenizer  # noqa: E402

from .common import ramp  # noqa: E402

#: Words remembered by a worker; beyond that it starts anew.
REMEMBERED = 800_000
#: Letters, besides ASCII ones, on which every Unicode version agrees: precomposed Latin.
LATIN = "À-ÖØ-öø-įı-ž"
#: Texts of these, printable ASCII and common white space need no library to be cut into words.
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LATIN}€]*")
#: The lower-cased alphabet's words, as the general pattern below cuts them.
PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+")
GENERAL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Numbered(dict):
    """Numbers words in the order of their first lookup."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Bounded memory of the ids of words; ``encode`` gives (ids, count for each) of unknown ones."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.number = Numbered()
        self.ids, self.first, self.count = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def of(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has)."""
        if len(self.number) > REMEMBERED:
            self.forget()
        had = len(self.number)
        which = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64)
        if len(self.number) > had:
            ids, count = self.encode(list(islice(self.number, had, None)))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
        count = self.count[which]
        return self.ids[np.repeat(self.first[which], count) + ramp(count)], count


def word_encoder(tokenizer_json: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to arrays of ids, for a lower-casing tokenizer whose Split pattern drops
    white space."""
    spec = json.loads(tokenizer_json)
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != GENERAL_WORDS:
        raise ValueError("this tokenizer cuts words in another way")
    special = [t["content"] for t in spec["added_tokens"]]

    # words of the plain alphabet are already normalised and cut; a word's last token ends in the suffix
    suffix = spec["model"]["end_of_word_suffix"]
    last = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
    last[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
    bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "truncation": None, "padding": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}}))

    def unknown(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word without its end")
        return ids, np.diff(ends, prepend=0)

    memory = Words(unknown)

    def encode(texts: list[str]) -> list[np.ndarray]:
        """One lookup of the words of all texts that are cut here."""
        cut = [PLAIN_WORDS.findall(t.lower()) if PLAIN.fullmatch(t) is not None and not any(s in t for s in special) else None for t in texts]
        ids, count = memory.of(chain.from_iterable(c for c in cut if c))
        ends = np.concatenate([[0], np.cumsum(count)])
        out, at = [], 0
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                out.append(np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4"))
            else:
                out.append(ids[ends[at] : ends[at + len(words)]])
                at += len(words)
        return out

    return encode
