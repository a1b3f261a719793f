"""Token ids of whole texts by the tokenizers library, with a bounded piece cache.

A byte-pair tokenizer first cuts a text into pieces and encodes each piece alone,
so equal pieces have equal ids. Texts of characters below U+0180 are cut here by
the vocabulary's own rule; unseen pieces of a batch go to the library end to end
in one call, are told apart by their lengths in bytes, and are remembered. Texts
with other characters go to the library whole.
"""

from __future__ import annotations

import itertools
import os
import re
from collections import defaultdict

import numpy as np

#: Remembered pieces in a worker; beyond that, those met once are forgotten.
CACHED = 600_000
# Letters, numbers and white space below U+0180, and the two rules
# by which the vocabularies cut.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", " \\t-\\r\\x85\\xa0"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
WORDS = re.compile(f"[{LETTER}]+|[{NUMBER}]|{SHORT}|[^{SPACE}{LETTER}{NUMBER}]+")
SPACED = re.compile(f" ?[{LETTER}]+| ?[{NUMBER}]+|{SHORT}| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_OTHER = re.compile("[^\x00-ſ]")
_MADE: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to little-endian ids. ``spaced``: byte level, pieces take a
    space in front; otherwise white space is dropped and texts are lower-cased."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.spaced, self.cut = spaced, (SPACED if spaced else WORDS).findall
        vocab = self.tok.get_vocab()
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token.removesuffix("</w>"))  # a character for each byte
        self._reset()

    def _reset(self) -> None:
        """Pieces are numbered in order of appearance; the ids of number i are
        ids[start[i] : start[i] + length[i]]."""
        self.number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.start, self.length = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep just the pieces met twice or more, unless they are too many."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > CACHED // 2:
            return self._reset()
        kept = set(keep.tolist())
        pieces = [p for i, p in enumerate(self.number) if i in kept]
        self.number = defaultdict(itertools.count(len(pieces)).__next__, zip(pieces, range(len(pieces)), strict=True))
        self.length = self.length[keep]
        ends = np.cumsum(self.length)
        self.ids = self.ids[np.repeat(self.start[keep] - ends + self.length, self.length) + np.arange(ends[-1] if len(ends) else 0)]
        self.start, self.met = ends - self.length, np.ones(len(keep), np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _run(self, pieces: list[str], before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, start, length) of pieces encoded end to end, ``before`` each."""
        (ids,) = self._ids([before + before.join(pieces)])
        extra = len(before) if self.spaced else 0  # white space has ids of its own or none
        sizes = np.array([len(p.encode()) for p in pieces])
        ends, at = np.cumsum(sizes + extra), np.cumsum(self.bytes_of[ids])
        if not len(at) or at[-1] != ends[-1]:
            return None
        stop = np.searchsorted(at, ends) + 1
        start = np.searchsorted(at, ends - sizes, "right") if extra else np.r_[0, stop[:-1]]
        if (at[stop - 1] != ends).any() or extra and (at[start - 1] != ends - sizes).any():
            return None
        return ids, start, stop - start

    def _learn(self, pieces: list[str]) -> None:
        """Remember pieces that have just got the next numbers, in that order."""
        kinds: list[list[int]] = [[], [], []]  # encoded in a run, in a run between line feeds, or alone
        for i, p in enumerate(pieces):
            if p.isalpha():
                kinds[1 if self.spaced else 0].append(i)
            else:
                kinds[0 if self.spaced and p[0] == " " and p[1:].isalpha() else 2].append(i)
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        parts, at = [self.ids], len(self.ids)
        for kind, before in ((0, "" if self.spaced else " "), (1, "\n")):
            if kinds[kind]:
                found = self._run([pieces[i] for i in kinds[kind]], before)
                if found is None:
                    kinds[2] += kinds[kind]
                    continue
                start[kinds[kind]], length[kinds[kind]] = found[1] + at, found[2]
                parts.append(found[0])
                at += len(found[0])
        for i, ids in zip(kinds[2], self._ids([pieces[i] for i in kinds[2]]), strict=True):
            start[i], length[i] = at, len(ids)
            parts.append(ids)
            at += len(ids)
        self.ids, self.start, self.length = np.concatenate(parts), np.r_[self.start, start], np.r_[self.length, length]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty) as bytes of ``dtype``."""
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and _OTHER.search(t)]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        other = set(whole)
        if len(self.number) > CACHED:
            self._forget()
        known, number = len(self.number), self.number.__getitem__
        cut = [(i, np.fromiter(map(number, self.cut(t if self.spaced else t.lower())), np.int64)) for i, t in enumerate(texts) if t and i not in other]
        if len(self.number) > known:
            self._learn(list(itertools.islice(self.number, known, None)))
        if cut:
            met = np.bincount(np.concatenate([p for _, p in cut]), minlength=len(self.number))
            met[: len(self.met)] += self.met
            self.met = met
        for i, pieces in cut:
            length = self.length[pieces]
            ends = np.cumsum(length)
            if len(ends):
                at = np.repeat(self.start[pieces] - ends + length, length) + np.arange(ends[-1])
                out[i] = self.ids[at].tobytes()
        return out


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for all tasks of a worker process."""
    if (path, spaced) not in _MADE:
        _MADE[path, spaced] = Encoder(path, spaced)
    return _MADE[path, spaced]
