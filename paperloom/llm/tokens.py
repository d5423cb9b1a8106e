"""Text to token ids, by the space-separated stretches of a text.

A byte-level pre-tokenizer never joins what lies on both sides of a space that touches a
non-space character, so a text can be cut before such spaces; equal stretches then have equal
ids and are encoded once. Where no two white-space characters meet, line ends are stretches of
their own. Texts with a space between two white-space characters, and texts with a special
token's string, are encoded whole.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import ragged, worker_held

#: Stretches that a worker remembers; beyond them it starts anew (a matter of speed and memory, not of results).
REMEMBERED = 600_000
#: Characters of stretches that it remembers at most, likewise.
REMEMBERED_CHARS = 16 << 20

_INNER_SPACE = re.compile(r"\s \s")
#: All white space, of Python and of Unicode, inside brackets of a pattern.
SPACES = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


class _Book:
    """Numbers given so far, and the stretches that wait to be encoded, in their order."""

    def __init__(self):
        self.n, self.waiting = 0, []


class _Known(dict):
    """Stretch, without ``prefix``, to number; a new one gets the next number and waits."""

    def __init__(self, prefix: str, book: _Book):
        self.prefix, self.book = prefix, book

    def __missing__(self, key: str) -> int:
        book = self.book
        n = self[key] = book.n
        book.n = n + 1
        book.waiting.append(self.prefix + key)
        return n


class StretchEncoder:
    """``encode(texts)``: all ids in one array and where each text's ids begin.

    encode_each(list of strings) -> the number of ids of each, and all ids in one array.
    """

    def __init__(self, encode_each: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: Sequence[str] = ()):
        self.encode_each = encode_each
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        strings = [f"[{SPACES}][{SPACES}]", *map(_quoted, special)]
        self.apart = "|".join(strings)
        self.forget()

    def forget(self) -> None:
        self.book = _Book()
        self.bare, self.spaced = _Known("", self.book), _Known(" ", self.book)
        self.starts = np.zeros(1 << 12, np.int32)
        self.lengths = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.int32)
        self.uses = np.zeros(1 << 12, np.int32)
        self.filled = self.chars = 0

    def _thin(self) -> None:
        """Keep short stretches that came more than twice, unless they are half of all."""
        uses, starts, lengths, ids = self.uses, self.starts, self.lengths, self.ids
        old = [[(w, n) for w, n in known.items() if uses[n] > 2 and len(w) <= 64] for known in (self.bare, self.spaced)]
        self.forget()
        if 2 * sum(map(len, old)) > REMEMBERED:
            return
        for known, kept in zip((self.bare, self.spaced), old, strict=True):
            for w, _ in kept:
                known[w]
        self.book.waiting = []
        kept = np.array([n for x in old for _, n in x], np.int64)
        size = lengths[kept]
        self.ids = ids[ragged(starts[kept], size)]
        self.filled, self.chars = len(self.ids), sum(len(w) for x in old for w, _ in x)
        self.starts, self.lengths, self.uses = (np.cumsum(size) - size).astype(np.int32), size, np.zeros(len(kept), np.int32)

    def _learn(self) -> None:
        new, self.book.waiting = self.book.waiting, []
        if not new:
            return
        lengths, ids = self.encode_each(new)
        self.chars += sum(map(len, new))
        n, first = self.book.n, self.book.n - len(new)
        total = len(ids)
        if n > len(self.starts):
            self.starts = np.resize(self.starts, 3 * n // 2)
            self.lengths = np.resize(self.lengths, 3 * n // 2)
            self.uses = np.concatenate((self.uses, np.zeros(3 * n // 2 - len(self.uses), np.int32)))
        if self.filled + total > len(self.ids):
            self.ids = np.resize(self.ids, 3 * (self.filled + total) // 2)
        self.lengths[first:n] = lengths
        self.starts[first:n] = self.filled + np.cumsum(lengths) - lengths
        self.ids[self.filled : self.filled + total] = ids
        self.filled += total

    def encode(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.book.n > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._thin()
        # the many small lists hold no cycles, and the collector would go through them again and again
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        apart = pc.match_substring_regex(column, self.apart).to_numpy(zero_copy_only=False)
        plain, odd = np.flatnonzero(~apart), np.flatnonzero(apart)
        counts = np.zeros(len(column), np.int64)
        numbers, counts[plain] = self._plain(column.take(pa.array(plain)) if len(odd) else column)
        others: list[int] = []
        for k in odd.tolist():
            parts = self._parts(column[k].as_py())
            others += [self.spaced[x[1:]] if x[:1] == " " else self.bare[x] for x in parts]
            counts[k] = len(parts)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        if len(odd):
            at = np.empty(int(bounds[-1]), np.int64)
            at[ragged(bounds[plain], counts[plain])] = numbers
            at[ragged(bounds[odd], counts[odd])] = others
        else:
            at = numbers
        self._learn()
        self.uses[: self.book.n] += np.bincount(at, minlength=self.book.n).astype(np.int32)
        lengths = self.lengths[at]
        ids = self.ids[ragged(self.starts[at], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ids, ends[bounds]

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of texts in which no two white-space characters meet, and how many each text has.

        Words are split and told apart in Arrow; each different one is looked up once.
        """
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n "), " ")
        words = lists.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(len(column), np.int64)
        index, names = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = np.asarray(lists.offsets).astype(np.int64)
        bounds -= bounds[0]
        end = names.index("\n") if "\n" in names else -1
        bare = index == end  # a line end, and what follows one or begins a text, has no space before it
        bare[1:] |= index[:-1] == end
        bare[bounds[:-1]] = True
        used = np.zeros(len(names), bool)
        used[index[~bare]] = True
        spaced = np.zeros(len(names), np.int64)
        get = self.spaced.__getitem__
        spaced[used] = list(map(get, names)) if used.all() else [get(names[k]) for k in np.flatnonzero(used).tolist()]
        numbers = spaced[index]
        first, back = np.unique(index[bare], return_inverse=True)
        numbers[bare] = np.array([self.bare[names[k]] for k in first.tolist()], np.int64)[back]
        return numbers, np.diff(bounds)

    def _parts(self, text: str) -> list[str]:
        if (self.special and self.special.search(text)) or _INNER_SPACE.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]


def byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself where Latin-1 prints it, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


# A word of letters that all Unicode versions know as such, and what may follow it: marks but the apostrophe, which begins contractions.
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def library_encoder(path: str) -> StretchEncoder:
    """Ids as the tokenizers library has them, without special tokens added, truncation or padding.

    A stretch of letters, or of letters and marks behind them, goes to the library's model at
    once, in the one or two parts that the pre-tokenizer would hand on; all others pass
    through the whole tokenizer.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    tokenize, letters = tokenizer.model.tokenize, byte_letters()
    space = letters[32]
    marks: dict[str, list[int]] = {}

    def encode_each(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int] | None] = []
        rest = []
        for k, x in enumerate(new):
            match = _WORD.fullmatch(x)
            if match is None:
                rest.append(k)
                found.append(None)
                continue
            word, tail = match.groups()
            if word.isascii():
                word = space + word[1:] if word[0] == " " else word
            else:
                word = word.encode().decode("latin-1").translate(letters)
            ids = [y.id for y in tokenize(word)]
            if tail:
                if tail not in marks:
                    if len(marks) > 10_000:
                        marks.clear()
                    marks[tail] = [y.id for y in tokenize(tail)]
                ids += marks[tail]
            found.append(ids)
        for k, x in zip(rest, tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = x.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))

    return StretchEncoder(encode_each, special)


def worker_encoder(path: str) -> StretchEncoder:
    """One encoder for each Python worker and vocabulary; what it remembers serves the worker's next tasks too."""
    return worker_held(("library", path), lambda: library_encoder(path))


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each row's ids."""
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
