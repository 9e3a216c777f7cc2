"""Fast, exact use of a word-level BPE of the tokenizers library: every distinct piece of a word is encoded once.

Arrow splits texts at white space, numbers their distinct words, cuts these into pieces and numbers the distinct
pieces, so Python meets each piece once a step, and the library each new one.
The tokenizer of ``word_bpe_49k.json`` drops white space, and nothing in it (normal form, lower case, pattern,
merges) looks across white space, so a text's ids are the ids of its words in a row. Of a word, a run of Latin
letters is a match of its own, told from the punctuation before and behind it; in lower case it goes straight to the
library's merges. All else (other scripts, digits, apostrophes, control characters) is a piece as a whole and takes
the library's whole way, and so does a text that holds the string of a special token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Letters with what the pattern matches apart from them before and behind; no apostrophe, which begins 's and the like.
SIMPLE = rf"^(?P<before>[{_MARKS}]*)(?P<core>[{_LETTERS}]+)(?P<after>[{_MARKS}]*)$"
LETTERS = re.compile(f"[{_LETTERS}]+")


def _byte_alphabet() -> dict[int, str]:
    """Code points of Latin-1 characters to the characters by which byte-level BPE writes their UTF-8 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}


def _rows(flat: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches starts[i]..starts[i + 1] of ``flat`` for every i of ``index``, one behind the other, their offsets)."""
    first = starts[index]
    lengths = starts[index + 1] - first
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], lengths)], ends


class WordEncoder:
    """Ids of whole texts by a tokenizers file. The cache of pieces is emptied when it holds ``max_pieces``."""

    #: Characters of text encoded in one step; a longer text is a step of its own.
    STEP = 10_000_000
    #: Words that the library merges in one call.
    JOINED = 10_000

    def __init__(self, path: str, max_pieces: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: str.split() takes 1C to 1F as white space, the tokenizer does not.
        self.odd = [*(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), *"\x1c\x1d\x1e\x1f"]
        self.alphabet = _byte_alphabet() | {32: " "}
        #: The same merges for words that are already as byte-level BPE writes them.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = self.tokenizer.model.end_of_word_suffix
        self.last = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.max_pieces = max_pieces
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)  # starts[i]..starts[i + 1] are the ids of piece i

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of lower-case words of Latin letters, in a row, how many each has): words end with ids that say so."""
        ids = np.array(self.merges.encode_batch_fast([" ".join(words).translate(self.alphabet)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words):
            return ids, np.diff(ends, prepend=0)
        by_word = [*map(self._library, words)]  # a model that marks no ends
        return np.array([*chain.from_iterable(by_word)], np.uint32), np.array([*map(len, by_word)], np.int64)

    def _learn(self, fresh: list[str]) -> None:
        simple, rest = [], []
        for piece in fresh:
            (simple if LETTERS.fullmatch(piece) else rest).append(piece)
        by_piece = [self._library(piece) if piece else [] for piece in rest]
        parts = [self._letters(simple[lo : lo + self.JOINED]) for lo in range(0, len(simple), self.JOINED)]
        parts.append((np.array([*chain.from_iterable(by_piece)], np.uint32), np.array([*map(len, by_piece)], np.int64)))
        ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        first, end = len(self.known), len(self.known) + len(fresh)
        while end + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        used = self.starts[first]
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.starts[first + 1 : end + 1] = used + np.cumsum(lengths)
        self.flat[used : used + len(ids)] = ids
        self.known.update(zip(chain(simple, rest), range(first, end), strict=True))

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words in a row, offsets with one entry more than words)."""
        cut = pc.extract_regex(words, SIMPLE)
        before, core, after = (pc.struct_field(cut, k) for k in ("before", "core", "after"))
        core = pc.if_else(cut.is_valid(), pc.utf8_lower(core), words)
        coded, known = pa.concat_arrays([pc.fill_null(before, ""), core, pc.fill_null(after, "")]).dictionary_encode(), self.known
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(number < 0)):
            self._learn(fresh := [pieces[i] for i in new])
            number[new] = [*map(known.__getitem__, fresh)]
        number = np.ascontiguousarray(number[coded.indices.to_numpy()].reshape(3, -1).T).ravel()
        ids, ends = _rows(self.flat, self.starts, number)
        return ids, ends[::3]

    def steps(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end, their ids in a row, offsets with one entry more than texts), step by step."""
        sizes = np.cumsum([len(t or "") for t in texts])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + self.STEP, side="right")))
            ids, lengths = self._some([t or "" for t in texts[at:end]])
            yield at, end, ids, np.concatenate([[0], np.cumsum(lengths)])
            at = end

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets with one entry more than texts). A null text is an empty one."""
        ids, ends = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        for _, _, x, e in self.steps(texts):
            ids.append(x)
            ends.append(e[1:] + ends[-1][-1])
        return np.concatenate(ids), np.concatenate(ends)

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = {i: np.array(self._library(t), np.uint32) for i, t in enumerate(texts) if any(x in t for x in self.odd)}
        if len(self.known) > self.max_pieces:
            self._reset()
        words = pc.utf8_split_whitespace(pa.array(["" if i in whole else t for i, t in enumerate(texts)], pa.string()))
        coded = words.values.dictionary_encode()
        ids, ends = _rows(*self._words(coded.dictionary), coded.indices.to_numpy())
        ends = ends[words.offsets.to_numpy()]
        per_text = np.diff(ends)
        if whole:
            parts = np.split(ids, ends[1:-1])
            for i, x in whole.items():
                parts[i], per_text[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, per_text


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    return WordEncoder(path)
