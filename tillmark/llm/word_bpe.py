"""Prefix dynamic programming over a byte-level BPE vocabulary with word ends.

The encoding of a string of symbols ends in exactly one token t such that the encoding of what
comes before it ends in a token that stays next to t when both are encoded together. So, from left
to right, the last token of every prefix follows from those of shorter prefixes, and with it the token
count of every prefix: one look-up for each candidate token, and no encoding from scratch. In
this vocabulary the last symbol of a word carries a mark, so a prefix that ends within a word takes
its last token from the marked ones, and what is before it from the plain ones.

What the next symbol adds follows from the places where a token may still be under way, the last
tokens before them and their counts against each other. Such a state of the programme comes up again in
many words: steps from state to state are worked out once and remembered, as are words, both up to
a bound; a text is the sum of its words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# The tokenizer's special strings, its contractions and its word-end mark.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WORD_END = "</w>"

#: Texts of characters below this are split here; for others the library normalises and splits.
PLAIN_LIMIT = 0x250
#: Words remembered by a process.
REMEMBERED = 300_000
#: States of the dynamic programme remembered by a process.
REMEMBERED_STATES = 250_000


def _ranges(test) -> str:
    """Members of a character class below PLAIN_LIMIT."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_LIMIT) if test(unicodedata.category(chr(c)), chr(c)))


_LETTER = _ranges(lambda kind, _: kind[0] == "L")
_NUMBER = _ranges(lambda kind, _: kind[0] == "N")
_SPACE = "\t\n\v\f\r \x85\xa0"
_WORD = rf"(?:{'|'.join(CONTRACTIONS)}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+)"
_SPACED_WORD = re.compile(rf"[{_SPACE}]*{_WORD}")
#: Characters whose lower case lies elsewhere or is longer.
_LEAVING = "".join(c for c in map(chr, range(PLAIN_LIMIT)) if len(c.lower()) > 1 or ord(c.lower()) >= PLAIN_LIMIT)
_NOT_PLAIN = re.compile(rf"[^\x00-{chr(PLAIN_LIMIT - 1)}]|[{_LEAVING}]")
_ANY_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
_BARE_WORD = re.compile(_WORD)


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def _total(deltas: bytes) -> int:
    """The count that changes, signed bytes, add up to."""
    return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))


class _State(dict):
    """Where the dynamic programme is after a prefix of a word: for each next character, the state after it and, as a
    byte, by how much the count of the prefix as a word changes.

    ``open`` has, from the longest, each end of the prefix that begins a token, the last token before that end, and
    the token count up to there against that of the prefix, both as part of a longer word; ``ended`` is the
    count of the prefix as a word, against the same.
    """

    __slots__ = ("counter", "open", "ended")

    def __init__(self, counter: PrefixCounter, open: tuple, ended: int):
        self.counter, self.open, self.ended = counter, open, ended

    def __missing__(self, character: str) -> tuple[_State, int]:
        after, changed = self, 0
        for symbol in self.counter.shown(character):
            after, change = self.counter.after(after, symbol)
            changed += change
        self[character] = step = after, changed & 0xFF
        return step


class _Words(dict):
    """Changes of the count in words, worked out where they are not remembered."""

    def __init__(self, work_out: Callable[[str], bytes]):
        self.work_out = work_out
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        changes = self.older.get(word)
        if changes is None:
            changes = self.work_out(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED // 2:
                # Words not met since the last time are forgotten.
                self.older = dict(self)
                self.clear()
            self[word] = changes
        return changes


class PrefixCounter:
    """Token counts of all prefixes of texts, and token ids of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        # One string object for each token: equal ones need not be compared.
        self.same = {t: t for t in self.vocab}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.same[a], self.same[b]): i for i, (a, b) in enumerate(pairs)}
        self.library = Tokenizer.from_file(path)
        self.special = {s: self.library.token_to_id(s) for s in SPECIAL}
        marked = {t: t.removesuffix(WORD_END) for t in self.vocab if t.endswith(WORD_END) and t != WORD_END}
        # What tokens begin with: the same once more, and the plain and the marked token it is, if any.
        self.begins: dict[str, tuple[str, str, str]] = {}
        for body in {*self.vocab.keys() - marked.keys(), *marked.values()}:
            for begin in [body[:i] for i in range(1, len(body) + 1)]:
                if begin not in self.begins:
                    self.begins[begin] = (begin, self.same.get(begin, ""), self.same.get(begin + WORD_END, ""))
        self.symbols = dict(enumerate(byte_symbols()))
        self.halves: dict[str, tuple[int, str, str] | None] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, _State] = {}
        self.start = _State(self, (("", "", 0),), 0)
        self.words = _Words(self._word)

    # --- the dynamic programme ------------------------------------------------------------------

    def _half(self, token: str) -> tuple[int, str, str] | None:
        """Rank and halves of the last merge that makes a token; rank -1 for a single symbol; None
        if encoding the token's own text gives something else."""
        if token not in self.halves:
            body = token.removesuffix(WORD_END) or token
            parts = [*body[:-1], body[-1] + token[len(body) :]]
            made = (-1, token, token)
            while len(parts) > 1:
                rank, at = min((self.rank.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 30:
                    break
                made = (rank, parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (made[0], *map(self.same.__getitem__, made[1:])) if parts == [token] else None
        return self.halves[token]

    def _stays(self, before: str, token: str) -> bool:
        """Whether the two tokens come out again when encoded together.

        Takes the merges of both back, the latest first; they stay apart if at no time a merge
        across the border would have come before the one taken back."""
        pair = (before, token)
        known = self.beside.get(pair)
        if known is None:
            left, right = self._half(before) if before else (-1, "", ""), self._half(token)
            known = left is not None and right is not None
            a, b, undone = before, token, 1 << 30
            while known and before:
                across = self.rank.get((a, b), 1 << 30)
                # Of equal merges the leftmost comes first: one in a comes before, one in b after the border's.
                if across < undone:
                    known = False
                elif left[0] < 0 and right[0] < 0:
                    break
                elif left[0] > right[0]:
                    undone, a = left[0], left[2]
                    left = self._half(a)
                else:
                    undone, b = right[0] + 1, right[1]
                    right = self._half(b)
            if len(self.beside) >= REMEMBERED // 2:
                self.beside.clear()
            self.beside[pair] = known
        return known

    def _reached(self, state: _State, symbol: str) -> tuple[list[tuple[str, str, int]], str, int, str, int]:
        """One step of the programme: ends that begin a token, last token and count as part of a longer
        word, and as a word; counts against that of the prefix before."""
        begins, beside, stays = self.begins.get, self.beside.get, self._stays
        open, last, count, final, ended = [], "", 0, "", 0
        for part, before, at in state.open:
            begin = begins(part + symbol)
            if begin is None:
                continue
            part, plain, marked = begin
            open.append((part, before, at))
            if plain and not last:
                fits = beside((before, plain))
                if stays(before, plain) if fits is None else fits:
                    last, count = plain, at + 1
            if marked and not final:
                fits = beside((before, marked))
                if stays(before, marked) if fits is None else fits:
                    final, ended = marked, at + 1
        return open, last, count, final, ended

    def after(self, state: _State, symbol: str) -> tuple[_State, int]:
        """The state after one more byte symbol, and by how much the count of the prefix as a word changes."""
        open, last, count, _, ended = self._reached(state, symbol)
        # After these a word goes the same way, whatever came before.
        key = (*[(part, before, at - count) for part, before, at in open], ("", last, 0))
        after = self.states.get((key, ended - count))
        if after is None:
            if len(self.states) >= REMEMBERED_STATES:
                for known in [self.start, *self.states.values()]:
                    known.clear()
                self.states.clear()
            after = self.states[key, ended - count] = _State(self, key, ended - count)
        return after, ended - state.ended

    def changes(self, word: str) -> bytes:
        """By how much the token count changes, as a byte, from prefix to prefix of a word, each as a word of its own."""
        state, changes = self.start, bytearray()
        for character in word:
            state, change = state[character]
            changes.append(change)
        return bytes(changes)

    def tokens(self, word: str) -> list[str]:
        """Tokens of a word: the last one, that of the prefix before it, and so on."""
        shown, states = self.shown(word), [self.start]
        for symbol in shown:
            states.append(self.after(states[-1], symbol)[0])
        final = self._reached(states[-2], shown[-1])[3]
        tokens, at = [final], len(shown) - len(final) + len(WORD_END)
        while at:
            tokens.append(states[at].open[-1][1])
            at -= len(tokens[-1])
        tokens.reverse()
        return tokens

    def shown(self, text: str) -> str:
        """A text in byte symbols."""
        return text.encode().decode("latin-1").translate(self.symbols)

    def _word(self, word: str) -> bytes:
        """Change of the count at each code point of a (spaced) word."""
        bare = word.lstrip(_SPACE)
        changes = self.changes(bare)
        if bare[:1] == "'" and bare in CONTRACTIONS:  # shorter prefixes are not contractions, but quote and letters
            upto = [sum(_total(self._word(w)) for w in _BARE_WORD.findall(bare[:i])) for i in range(1, len(bare))] + [_total(changes)]
            changes = bytes([(b - a) & 0xFF for a, b in zip([0, *upto], upto)])
        return bytes(len(word) - len(bare)) + changes

    # --- texts ----------------------------------------------------------------------------------

    def _split(self, text: str) -> list[str]:
        """Words of a text with the white space before them, and white space at its end."""
        if text.isascii() or not _NOT_PLAIN.search(text):
            text = text.lower()
            words = _SPACED_WORD.findall(text)
            rest = len(text) - len(text.rstrip(_SPACE))
            return [*words, text[-rest:]] if rest else words
        text = self.library.normalizer.normalize_str(text)
        words, at = [], 0
        for _, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(text):
            words.append(text[at:start].replace("\x1f", " ") + text[start:end])
            at = end
        return [*words, text[at:]] if at < len(text) else words

    def deltas(self, text: str) -> bytes:
        """Change of the count at each code point of the normalised text."""
        if "<|" not in text or not _ANY_SPECIAL.search(text):
            return b"".join(map(self.words.__getitem__, self._split(text)))
        found = []
        for piece in _ANY_SPECIAL.split(text):
            deltas = b"".join(map(self.words.__getitem__, self._split(piece)))
            if piece in self.special:  # as ordinary text, but for its end
                deltas = deltas[:-1] + bytes([(1 - _total(deltas[:-1])) & 0xFF])
            found.append(deltas)
        return b"".join(found)

    def count(self, text: str) -> int:
        return _total(self.deltas(text))

    def ids(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit numbers."""
        found = []
        for piece in _ANY_SPECIAL.split(text):
            if piece in self.special:
                found.append(self.special[piece])
            else:
                bare = [w.lstrip(_SPACE) for w in self._split(piece)]
                found += [self.vocab[t] for w in bare if w for t in self.tokens(w)]
        return np.array(found, "<u4").tobytes()


class WordIds:
    """Token ids of texts by the library, which sees each new word once and remembered ones not at all.

    The library's encoding of a text is that of its words one after the other; texts that
    are not split here go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(WORD_END)
        self.kind = np.dtype(np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)
        # The same without what is already done to words: normalised and split.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.words: dict[str, bytes] = {}

    def _encode(self, library, text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as machine words: 16 bits if the vocabulary fits, else 32."""
        known, split, unknown = self.words, [], set()
        for text in texts:
            plain = (text.isascii() or not _NOT_PLAIN.search(text)) and not ("<|" in text and _ANY_SPECIAL.search(text))
            words = _BARE_WORD.findall(text.lower()) if plain else None
            split.append(words)
            unknown.update(set(words or ()).difference(known))
        missing, new = list(unknown), {}
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            ids = self._encode(self.of_words, " ".join(part))
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            if len(ends) != len(part):
                raise ValueError("the library splits words in another way")
            data = ids.tobytes()
            new.update({word: data[start:end] for word, start, end in zip(part, [0, *ends], ends)})
        if len(known) + len(new) > 2 * REMEMBERED:
            both = known | new
            known.clear()
        else:
            known.update(new)
            both = known
        found = [b"".join(map(both.__getitem__, words)) if words is not None else None for words in split]
        return [
            self._encode(self.library, text).tobytes() if ids is None else ids
            for text, ids in zip(texts, found)
        ]


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    """One counter per process and vocabulary file."""
    return PrefixCounter(path)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
