"""Fast exact encoding with a byte-level BPE of the tokenizers library: repeated pieces of text are encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import regex

from .bpe import byte_letters
from .common import HUGE, hashes

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the published pattern by which byte-level vocabularies of this kind cut text before merging.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Control characters on which engines differ about white space.
_DISPUTED = re.compile(r"[\x1c-\x1f\x85]")
#: Words that are one piece by the pattern: letters in every version of Unicode, after one space at most.
_WORD = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af]+")
_ALNUM = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: From a byte to the letter that stands for it in the vocabulary.
_LETTERS = dict(enumerate(byte_letters()))


def default_vocabulary() -> str:
    """Place of the public vocabulary on this machine; workers resolve it for themselves."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Stretches:
    """Numbers of stretches of text, found by arrays alone: an open table of hashes, with the stretch's first eight letters and length beside each.

    A stretch counts as known where its 64-bit hash, its first eight bytes and its length all agree.
    """

    def __init__(self, bound: int):
        bits = max(8, (2 * bound).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.hash, self.head, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.number = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers, or -1 for what is not known."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h >> self.shift).view(np.int64)
        while len(left):
            n = self.number.take(slot)
            same = (self.hash.take(slot) == h[left]) & (self.head.take(slot) == head[left]) & (self.size.take(slot) == size[left]) & (n >= 0)
            out[left[same]] = n[same]
            on = (n >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, head: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        """Enter stretches that are not there yet; the table must have room."""
        left, slot = np.arange(len(h)), (h >> self.shift).view(np.int64)
        while len(left):
            free = self.number.take(slot) < 0
            # Of several for one slot the last written stays, and the others go on.
            self.number[slot[free]] = number[left[free]]
            won = free & (self.number.take(slot) == number[left])
            at = slot[won]
            self.hash[at], self.head[at], self.size[at] = h[left[won]], head[left[won]], size[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask


class WordEncoder:
    """Ids of texts, as the library gives them for the whole text without adding special tokens.

    The library cuts a text by a published pattern and merges within the pieces alone.  A space or a line break begins
    a piece, unless it stands in a longer run of white space, and no piece holds a punctuation mark after a letter or digit; so a text
    is cut before each of them (before marks in ASCII only), and each
    distinct stretch is given to the library once per worker, up to a bound; arrays hold the ids of each number.
    No list of ids is kept: many of them would make Python's garbage collector walk them again and again.
    Texts with longer runs, or other white space at a cut, are cut by the pattern itself, and
    those that hold a special token's string, or characters on which engines disagree, go to the library whole.
    """

    def __init__(self, path: str, bound: int = 1_000_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError("special tokens with white space are not supported")
        self.model, self.pieces = self.library.model, {}
        self.bound, self.longest = bound, longest
        # Kinds of bytes: 1 letters and digits, 2 marks before which a text is cut if one of those comes before, 4 spaces and line breaks.
        # A mark at which a special token's string would be cut is left out.
        inside = {b for s in self.special for a, b in pairwise(s.encode()) if a in _ALNUM}
        self.kind = np.array([1 if b in _ALNUM else 4 if b in (10, 32) else 2 if 32 < b < 127 and b not in inside else 0 for b in range(256)], np.uint8)
        # A special token of letters alone may stand within a word, so that no word is taken for one piece.
        self.word = re.compile(r"(?!)").fullmatch if any(_WORD.fullmatch(s) for s in self.special) else _WORD.fullmatch
        self.known, self.kept = Stretches(bound), 0
        # Ids of number n: ids[start[n] : start[n + 1]]; where plain is false, its text cannot be cut at spaces.  Arrays with room to grow.
        self.n, self.start, self.plain, self.ids = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool), np.zeros(1 << 14, np.uint32)

    def encode_text(self, text: str) -> list[int]:
        """Ids of a text cut by the published pattern; the library's model gets it piece by piece."""
        if _DISPUTED.search(text) or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for p in PATTERN.findall(text):
            known = self.pieces.get(p)
            if known is None:
                known = tuple(t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(_LETTERS)))
                if len(self.pieces) < 200_000 and len(p) <= self.longest:
                    self.pieces[p] = known
            ids += known
        return ids

    def learn(self, found: list[bytes]) -> np.ndarray:
        """Numbers of new stretches, whose ids the arrays hold from now on."""
        tokenize, word, flat = self.model.tokenize, self.word, []
        plain, ends = np.ones(len(found), bool), np.empty(len(found), np.int64)
        for i, raw in enumerate(found):
            text = raw.decode()
            if word(text):
                letters = text if text.isascii() else raw.decode("latin-1").translate(_LETTERS)
                flat += [t.id for t in tokenize("Ġ" + letters[1:] if raw[0] == 32 else letters)]
            else:
                inner = text[1:] if raw[0] in (32, 10) else text
                plain[i] = not inner or not (inner[0].isspace() or inner[-1].isspace() or any(s in text for s in self.special))
                if plain[i]:
                    flat += self.encode_text(text)
            ends[i] = len(flat)
        more = np.array(flat, np.uint32)
        first, end = self.n, self.n + len(found)
        if end + 1 > len(self.plain):
            self.start, self.plain = (np.concatenate((x, np.zeros(max(len(x), end + 1), x.dtype))) for x in (self.start, self.plain))
        at = int(self.start[first])
        if at + len(more) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(more)), np.uint32)))
        self.ids[at : at + len(more)] = more
        self.start[first + 1 : end + 1] = at + ends
        self.plain[first:end] = plain
        self.n = end
        return np.arange(first, end)

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all stretches, where each text's stretches begin and the end, texts that cannot be cut at spaces)."""
        self.n = self.kept  # what was learnt last time and not kept is dropped
        raws = [x.encode() if x else b"" for x in texts]
        joined = b"".join([*raws, bytes(16)])
        data, total = np.frombuffer(joined, np.uint8), len(joined) - 16
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        kind = self.kind.take(data[:total])
        gap = kind == 4
        cut = gap.copy()
        cut[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
        cut[begins[begins < ends]] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=total)
        bounds = np.searchsorted(start, np.append(begins, total))
        h, head = hashes(data, start, size)
        huge = np.flatnonzero(size > HUGE)
        h[huge] = huge.astype(np.uint64)
        numbers = self.known.find(h, head, size)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            order = new[np.lexsort((size[new], head[new], h[new]))]
            fresh = np.concatenate(([True], (h[order[1:]] != h[order[:-1]]) | (head[order[1:]] != head[order[:-1]]) | (size[order[1:]] != size[order[:-1]])))
            at = order[fresh]
            # A full memory keeps what it holds: frequent stretches come early, and what comes late mostly comes once.
            enter = size[at] <= self.longest
            enter &= np.cumsum(enter) <= self.bound - self.kept
            rank = np.argsort(~enter, kind="stable")
            own = np.empty(len(at), np.int64)
            own[rank] = self.learn([joined[s : s + k] for s, k in zip(start[at[rank]].tolist(), size[at[rank]].tolist(), strict=True)])
            numbers[order] = own[np.cumsum(fresh) - 1]
            at, own = at[enter], own[enter]
            self.known.add(h[at], head[at], size[at], own)
            self.kept += len(at)
        # White space alone may stand before a stretch, but not twice in a row.
        alone = (size == 1) & gap[start]
        bad = ~self.plain.take(numbers)
        twice = np.flatnonzero(alone[1:] & alone[:-1]) + 1
        bad[twice[~np.isin(twice, bounds)]] = True
        return numbers, bounds, np.unique(np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        numbers, bounds, odd = self.numbered(texts)
        first = self.start.take(numbers)
        length = self.start.take(numbers + 1) - first
        ends = np.concatenate(([0], np.cumsum(length)))
        out = self.ids.take(np.arange(ends[-1]) + np.repeat(first - ends[:-1], length)).astype("<u4", copy=False)
        found = [out[a:b].tobytes() for a, b in pairwise(ends[bounds].tolist())]
        for i in odd.tolist():
            found[i] = np.array(self.encode_text(texts[i]), "<u4").tobytes()
        return found

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        numbers, bounds, odd = self.numbered(texts)
        ends = np.concatenate(([0], np.cumsum(self.start.take(numbers + 1) - self.start.take(numbers))))
        found = np.diff(ends[bounds]).tolist()
        for i in odd.tolist():
            found[i] = len(self.encode_text(texts[i]))
        return found


@lru_cache(1)
def encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)
