"""Cutting texts into words by a compiled transducer, and numbering the different words.

The word pattern is compiled into a deterministic transducer over character classes; its transitions
say where a word starts. Inputs are cut into blocks, each block is turned into a map from entry state to
exit state for all states at once, and the maps compose through a parallel prefix scan, which gives
every block its true entry state. Equal words are found by a rolling hash and then compared character by
character, so that no hash decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from . import common
from .common import U64, UNIT_BASE, mix
from .word_tokens import Numbered

#: Character classes. RESET stands between texts. The single letters occur in contractions.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, RESET = range(7)
SINGLE = {c: 7 + k for k, c in enumerate("strevmld")}
CLASSES = 15
#: States: a word starts next; in letters, numbers, others; after one space, one other blank, a run
#: of blanks that ends in either; after an apostrophe that starts a word, and one letter further.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, APOSTROPHE, AFTER_R, AFTER_V, AFTER_L = range(12)
STATES = 12
#: Emission bits: a word starts here; a word starts one character back.
HERE, BACK = 1, 2
BLOCK = 256
STEP = 4


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) for each state and class, of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+|blanks+(?!non-blank)|blanks+."""
    to = np.zeros((STATES, CLASSES), dtype=np.uint8)
    out = np.zeros((STATES, CLASSES), dtype=np.uint8)
    letters = {LETTER, *SINGLE.values()}

    def opened(c: int) -> int:
        """State after a word starts with class c."""
        if c in letters:
            return IN_LETTERS
        return {SPACE: ONE_SPACE, BLANK: ONE_BLANK, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: APOSTROPHE}[c]

    def joined(c: int) -> int | None:
        """State after a space and class c; none for blanks."""
        return IN_LETTERS if c in letters else {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}.get(c)

    pairs = {AFTER_R: SINGLE["e"], AFTER_V: SINGLE["e"], AFTER_L: SINGLE["l"]}
    for s in range(STATES):
        for c in range(CLASSES):
            if c == RESET:
                to[s, c], out[s, c] = FRESH, BACK if s in pairs else 0
            elif (s == IN_LETTERS and c in letters) or (s == IN_NUMBERS and c == NUMBER) or (s == IN_OTHERS and c in (OTHER, QUOTE)):
                to[s, c] = s
            elif s in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK) and c in (SPACE, BLANK):
                to[s, c] = RUN_SPACE if c == SPACE else RUN_BLANK
            elif s in (ONE_SPACE, RUN_SPACE):
                to[s, c], out[s, c] = joined(c), BACK if s == RUN_SPACE else 0
            elif s == RUN_BLANK:
                to[s, c], out[s, c] = opened(c), BACK | HERE
            elif s == APOSTROPHE and c in (SINGLE["s"], SINGLE["t"], SINGLE["m"], SINGLE["d"]):
                to[s, c] = FRESH
            elif s == APOSTROPHE and c in (SINGLE["r"], SINGLE["v"], SINGLE["l"]):
                to[s, c] = {SINGLE["r"]: AFTER_R, SINGLE["v"]: AFTER_V, SINGLE["l"]: AFTER_L}[c]
            elif s == APOSTROPHE and c in (OTHER, QUOTE):
                to[s, c] = IN_OTHERS
            elif s in pairs and c == pairs[s]:
                to[s, c] = FRESH
            elif s in pairs:
                # the letter after the apostrophe starts a word of its own
                to[s, c], out[s, c] = (IN_LETTERS, BACK) if c in letters else (opened(c), BACK | HERE)
            else:
                to[s, c], out[s, c] = opened(c), HERE
    return to, out


class Lexer:
    """Word starts of concatenated texts."""

    def __init__(self):
        self.to, self.out = compile_transducer()
        table = np.arange(STATES, dtype=np.uint8)[:, None]
        for _ in range(STEP):  # transitions over STEP classes at once
            table = self.to[table].reshape(STATES, -1)
        self.leap = np.ascontiguousarray(table)

    def block_maps(self, blocks: np.ndarray) -> np.ndarray:
        """Exit state of each block for each entry state."""
        code = np.zeros((len(blocks), BLOCK // STEP), dtype=np.int32)
        for k in range(STEP):
            code = code * CLASSES + blocks[:, k::STEP]
        maps = np.tile(np.arange(STATES, dtype=np.intp), (len(blocks), 1))
        width = CLASSES**STEP
        flat = self.leap.ravel()
        for k in range(BLOCK // STEP):
            maps *= width
            maps += code[:, k, None]
            maps = flat.take(maps).astype(np.intp)
        return maps

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Composition of each block's map with all before it, in log steps."""
        maps = maps.copy()
        step = 1
        while step < len(maps):
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
            step *= 2
        return maps

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Where words start; the first text begins at 0, RESET ends each."""
        n = len(classes)
        padded = np.full(-(-n // BLOCK) * BLOCK, RESET, dtype=np.uint8)
        padded[:n] = classes
        blocks = padded.reshape(-1, BLOCK)
        after = self.scan(self.block_maps(blocks))[:, FRESH]
        state = np.concatenate([[FRESH], after[:-1]]).astype(np.intp)
        columns = np.ascontiguousarray(blocks.T)
        emitted = np.zeros(columns.shape, dtype=np.uint8)
        to, out = self.to.ravel().astype(np.intp), self.out.ravel()
        for k in range(BLOCK):
            at = state * CLASSES + columns[k]
            emitted[k] = out.take(at)
            state = to.take(at)
        emitted = emitted.T.ravel()[:n]
        mark = (emitted & HERE) > 0
        mark[:-1] |= (emitted[1:] & BACK) > 0
        return np.flatnonzero(mark)


def pattern_class(char: str) -> int:
    """As the regex module's Unicode tables see the character."""
    if char == " ":
        return SPACE
    if char == "'":
        return QUOTE
    if char in SINGLE:
        return SINGLE[char]
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        if regex.match(pattern, char):
            return kind
    return OTHER


class Cutter:
    """The words of texts; ``class_of`` gives the class of a character."""

    def __init__(self, class_of: Callable[[str], int]):
        self.lexer = Lexer()
        self.class_of = class_of
        self.classes = np.full(0x110000, 255, dtype=np.uint8)
        for c in range(128):
            self.classes[c] = class_of(chr(c))

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the different words, which of them each word is, words of each text)."""
        joined = "\0".join([*texts, ""])
        code = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes = self.classes[code]
        if (classes == 255).any():
            for c in np.unique(code[classes == 255]).tolist():
                self.classes[c] = self.class_of(chr(c))
            classes = self.classes[code]
        classes[ends] = RESET
        start = self.lexer.starts(classes)
        if not len(start):
            return [], start, np.zeros(len(texts), dtype=np.int64)
        text_of = np.searchsorted(ends, start)
        end = np.minimum(np.append(start[1:], len(code)), ends[text_of])
        size = end - start
        prefix = common.prefix_hash(code.astype(U64) + U64(1), UNIT_BASE)
        key = mix(common.range_hash(prefix, start, end, UNIT_BASE) + size.astype(U64))
        del prefix, classes
        first, which = np.unique(key, return_index=True, return_inverse=True)[1:]
        words = [joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        # a word that differs from the one its hash names gets a number of its own
        model = first[which]
        odd = size != size[model]
        mine = np.delete(code, ends)  # words cover all but the ends
        there = np.delete(np.arange(len(code), dtype=np.int32), ends) + np.repeat((start[model] - start).astype(np.int32), size)
        apart = mine != code.take(there, mode="clip")
        if apart.any():
            odd[np.repeat(np.arange(len(start)), size)[apart]] = True
        if odd.any():
            more = Numbered()
            for k in np.flatnonzero(odd).tolist():
                which[k] = len(words) + more[joined[start[k] : end[k]]]
            words += list(more)
        return words, which, np.bincount(text_of, minlength=len(texts))
