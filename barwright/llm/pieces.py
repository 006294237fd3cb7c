"""A fixed public piece vocabulary as an Aho-Corasick automaton in numpy.

The automaton enumerates every vocabulary piece that ends at a byte, longest
first.  Words of similar length run side by side, one row each, so a step over
one byte position is a few numpy operations for thousands of words.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_START = "▁"  # stands for the space before a word


def load_pieces(path: str = PIECES) -> tuple[list[str], list[float]]:
    """Pieces and scores, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]


class Automaton:
    """goto: next state by byte class; piece: the piece that a state spells, or -1;
    shorter: the next state down the suffixes that spells a piece, or 0."""

    def __init__(self, pieces: list[str]):
        spelled = [p.encode() for p in pieces]
        used = sorted({b for p in spelled for b in p})
        self.byte_class = np.zeros(256, np.int32)
        self.byte_class[used] = np.arange(1, len(used) + 1)
        child: list[dict[int, int]] = [{}]
        piece, levels = [-1], [[0]]
        for i, p in enumerate(spelled):
            s = 0
            for d, b in enumerate(p, 1):
                if b not in child[s]:
                    child[s][b] = len(child)
                    child.append({})
                    piece.append(-1)
                    if d == len(levels):
                        levels.append([])
                    levels[d].append(child[s][b])
                s = child[s][b]
            if s and piece[s] < 0:
                piece[s] = i
        n = len(child)
        self.piece = np.array(piece, np.int32)
        self.size = np.array([len(p) for p in spelled], np.int64)
        self.goto = np.zeros((n, len(used) + 1), np.int32)
        fail, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for level in levels:
            edges = [(s, b, c) for s in level for b, c in child[s].items()]
            rows = np.array(level)
            if level != [0]:
                self.goto[rows] = self.goto[fail[rows]]
            if edges:
                s, b, c = (np.array(x) for x in zip(*edges))
                cls = self.byte_class[b]
                fail[c] = np.where(s == 0, 0, self.goto[s, cls])
                self.goto[s, cls] = c
                self.shorter[c] = np.where(self.piece[fail[c]] >= 0, fail[c], self.shorter[fail[c]])

    def ends(self, words: np.ndarray, sizes: np.ndarray):
        """For each byte position i of padded rows: i, the rows that reach it, and an iterator of
        (rows, pieces) that end after it, longest first."""
        state = np.zeros(len(words), np.int32)
        for i in range(words.shape[1]):
            rows = np.flatnonzero(sizes > i)
            state[rows] = self.goto[state[rows], self.byte_class[words[rows, i]]]
            yield i, rows, self._down(rows, state[rows])

    def _down(self, rows: np.ndarray, state: np.ndarray):
        at = np.where(self.piece[state] >= 0, state, self.shorter[state])
        while True:
            some = at > 0
            rows, at = rows[some], at[some]
            if not len(rows):
                return
            yield rows, self.piece[at]
            at = self.shorter[at]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    most = int(sizes.max())
    return np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(-1, most), sizes


def char_ends(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the character that ends at each byte of padded rows, 0 inside a character."""
    n, most = words.shape
    lead = (words & 0xC0) != 0x80
    cols = np.arange(most)
    begin = np.maximum.accumulate(np.where(lead, cols, 0), axis=1)
    ends = np.ones((n, most), bool)
    ends[:, :-1] = lead[:, 1:]
    ends |= cols == sizes[:, None] - 1
    return np.where(ends & (cols < sizes[:, None]), cols - begin + 1, 0)


def by_size(words: list[bytes], cells: int = 1 << 19):
    """Batches of words of similar length with at most about ``cells`` bytes, padding included."""
    words = sorted(words, key=len)
    i = 0
    while i < len(words):
        size = max(1, len(words[i]))
        j = i
        while j < len(words) and (j - i) * (size + size // 4 + 1) < cells and len(words[j]) <= size + size // 4 + 1:
            j += 1
        yield words[i:max(j, i + 1)]
        i = max(j, i + 1)
