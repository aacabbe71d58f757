"""BPE encoding by depth-first traversal of a trie of distinct words, and decoding."""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
#: What the vocabulary's own normaliser takes for white space (Unicode White_Space).
_GAP = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Control characters that str.split() also splits on but the tokeniser does not.
_ODD = regex.compile(r"[\x1c-\x1f]")


def default_vocabulary() -> str:
    """Place of the public vocabulary on this machine; workers resolve it for themselves."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others in order for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder for a byte-level BPE vocabulary with word-end marks, from its public JSON file.

    The tokens of a prefix end in one last token, and what stands before that token is the encoding of a
    shorter prefix.  So the state of a trie node is its last token, found among the tokens that end there
    as the one that BPE leaves apart from the last token before it.  A depth-first traversal hands the states
    of a path down to all words below it.
    """

    def __init__(self, path: str, bound: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        self.end = model["end_of_word_suffix"]
        self.text_of: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of.update({i: t for t, i in self.special.items()})
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.parts: dict[int, tuple[bytes, bool]] = {}
        for token, i in model["vocab"].items():
            at_end = token.endswith(self.end)
            raw = bytes(letters[c] for c in (token[: -len(self.end)] if at_end else token))
            (self.final if at_end else self.inner)[raw] = i
            self.parts[i] = raw, at_end
        self.longest = max(map(len, [*self.inner, *self.final]))
        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.apart_memo: dict[tuple[int, int], bool] = {}
        self.whole_memo: dict[int, bool] = {}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}
        self.word_memo: dict[bytes, bytes] = {}
        # The trie: node and letter to the node below, and each node's state.
        self.child: dict[int, int] = {}
        self.state = [-1]
        self.nodes = bound
        self.width = {i: len(raw) for i, (raw, _) in self.parts.items()}
        self.bound = bound

    def merged(self, symbols: list[int]) -> list[int]:
        """BPE by definition: merge the pair of lowest rank, leftmost first, until none is left.  For pairs of tokens only."""
        while len(symbols) > 1:
            best = min((self.merges.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(symbols, symbols[1:])))  # noqa: B905
            if best[0] == 1 << 60:
                break
            i = best[1]
            symbols[i : i + 2] = [self.merges[symbols[i], symbols[i + 1]][1]]
        return symbols

    def symbols(self, token: int) -> list[int]:
        raw, at_end = self.parts[token]
        out = [self.inner[raw[i : i + 1]] for i in range(len(raw))]
        if at_end:
            out[-1] = self.final[raw[-1:]]
        return out

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE over the letters of token a and then b gives just these two."""
        known = self.apart_memo.get((a, b))
        if known is None:
            if len(self.apart_memo) > 2_000_000:
                self.apart_memo.clear()
            # A pair that itself merges is never left apart; for the others BPE decides.
            known = self.apart_memo[a, b] = (a, b) not in self.merges and self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
        return known

    def whole(self, a: int) -> bool:
        """Whether BPE makes token a of its letters at all."""
        known = self.whole_memo.get(a)
        if known is None:
            known = self.whole_memo[a] = self.merged(self.symbols(a)) == [a]
        return known

    def last_token(self, path: bytes, last: list[int], tokens: dict[bytes, int]) -> int:
        """The state at the end of ``path`` (its last letters do), given the states at all depths before: the one token that ends there and stays apart from the state before it, short ones first."""
        n = len(last)
        tail = path[-self.longest :]
        size = len(tail)
        memo = self.apart_memo
        for start in range(size - 1, -1, -1):
            t = tokens.get(tail[start:])
            if t is not None:
                at = n - size + start
                if at:
                    ok = memo.get((last[at], t))
                    if ok is None:
                        ok = self.apart(last[at], t)
                else:
                    ok = self.whole(t)
                if ok:
                    return t
        raise ValueError("the vocabulary has no token for a byte")

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Token ids of each distinct non-empty word.

        Words enter the trie in sorted order, which visits it depth first: a word walks down to where it leaves the
        words before it, and only from there on are states computed.  The trie stays for later words, up to its bound.
        """
        if len(self.state) > self.nodes:
            self.child.clear()
            self.state = [-1]
        child, state, out = self.child, self.state, {}
        for w in sorted(words):
            node, last = 0, [-1]
            for depth, letter in enumerate(w[:-1], 1):
                key = node << 8 | letter
                below = child.get(key)
                if below is None:
                    state.append(self.last_token(w[:depth] if depth <= self.longest else w[depth - self.longest : depth], last, self.inner))
                    below = child[key] = len(state) - 1
                node = below
                last.append(state[node])
            ids, at, t = [], len(w), self.last_token(w, last, self.final)
            while True:
                ids.append(t)
                at -= self.width[t]
                if not at:
                    break
                t = last[at]
            out[w] = ids[::-1]
        return out

    def split(self, chunk: str) -> list[bytes]:
        """Words of a chunk without white space: composed, lower-cased letter by letter, cut by the vocabulary's pattern."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        if chunk.isascii() and chunk.isalpha():
            return [chunk.encode()]
        return [w.encode() for w in self.pattern.findall(chunk)]

    def encode_chunks(self, chunks: set[str]) -> None:
        """Put the id bytes of new chunks into the memo."""
        split = {c: self.split(c) for c in chunks}
        words = {w for ws in split.values() for w in ws}
        new = words - self.word_memo.keys()
        if len(self.word_memo) + len(new) > self.bound:
            self.word_memo.clear()
            new = words
        known = self.word_memo
        for w, x in self.encode_words(new).items():
            known[w] = struct.pack(f"<{len(x)}I", *x)
        for c, ws in split.items():
            self.memo[c] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        pieces = []
        for text in texts:
            if not text:
                pieces.append([])
                continue
            parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            pieces.append([p if i % 2 else _GAP.split(p) if _ODD.search(p) else p.split() for i, p in enumerate(parts)])
        new = {c for ps in pieces for p in ps if not isinstance(p, str) for c in p if c} - self.memo.keys()
        if len(self.memo) + len(new) > self.bound:
            self.memo.clear()
            new = {c for ps in pieces for p in ps if not isinstance(p, str) for c in p if c}
        self.encode_chunks(new)
        self.memo[""] = b""
        return [b"".join([np.array([self.special[p]], "<u4").tobytes() if isinstance(p, str) else b"".join(map(self.memo.__getitem__, p)) for p in ps]) for ps in pieces]

    def decode(self, ids: bytes) -> str:
        """The texts of all tokens, joined by spaces: the vocabulary's file names no decoder, and this is then the library's rule."""
        return " ".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def encoder(vocabulary: str) -> WordBpe:
    return WordBpe(vocabulary)


def _mapped(df: DataFrame, column: str, out: str, kind: pa.DataType, of: Callable[[WordBpe, list], list], vocabulary: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary or default_vocabulary())
        for b in batches:
            for at in range(0, b.num_rows, 512):  # a few texts at a time, so memory stays small
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of(e, part.column(1).to_pylist()), kind)], names=["doc_id", out])

    return df.mapInArrow(run, f"doc_id long, {out} {'binary' if kind == pa.binary() else 'string'}")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) per input row; ids: the text's token ids as little-endian unsigned 32-bit integers.

    The result is what the tokenizers library gives for the whole text without adding special tokens;
    special tokens that stand in a text become their ids, as there.  Null, empty and blank texts have no ids;
    null ids stay null; repeated rows are encoded each; an empty table gives no rows; other columns are not read.
    Words are remembered per worker up to a bound; one pass, no shuffle.  ``vocabulary`` is a file on every worker.
    """
    return _mapped(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), text_col, "ids", pa.binary(), lambda e, x: e.encode(x), vocabulary)


def decode(df: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, decoded) from the result of ``encode``; a null in ids is an empty text."""
    return _mapped(df.select("doc_id", "ids"), "ids", "decoded", pa.string(), lambda e, x: [e.decode(i or b"") for i in x], vocabulary)


def encoded_and_decoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): both directions in one pass; rows as for ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary or default_vocabulary())
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = e.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([e.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
