"""Quality rules: surface counts, then tokeniser fertility with rejection bands per script."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, materialise, mix64, text_bytes

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"

#: First and last code point of the scripts told apart.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}

#: Rejection bands per script: least and most characters per token, most byte-fallback tokens as a share of all,
#: least token entropy as a share of the most that so many tokens can have.
BANDS = {
    "latin": (1.45, 8.0, 0.10, 0.30),
    "greek": (0.6, 6.0, 0.40, 0.25),
    "cyrillic": (1.0, 7.0, 0.15, 0.30),
    "hebrew": (0.5, 6.0, 0.40, 0.25),
    "arabic": (0.5, 6.0, 0.40, 0.25),
    "indic": (0.2, 5.0, 0.90, 0.20),
    "thai": (0.2, 5.0, 0.90, 0.20),
    "hangul": (0.2, 4.0, 0.90, 0.20),
    "kana": (0.2, 4.0, 0.70, 0.20),
    "han": (0.2, 4.0, 0.90, 0.20),
    "other": (0.2, 8.0, 0.90, 0.20),
}

#: Latin bands for tables without labels, used only where nothing is fitted: entropy shares by log2 of the number of tokens, read off
#: English prose; the least for any text, and the most for text in pieces of fewer than SHORT_PIECES characters.
LEAST_ENTROPY = ((9, 10, 11, 12, 13, 14, 16), (0.525, 0.53, 0.51, 0.47, 0.445, 0.43, 0.39))
MOST_ENTROPY = ((5, 6, 7, 8, 9, 10, 11, 12, 13, 15), (0.939, 0.936, 0.897, 0.854, 0.771, 0.707, 0.651, 0.598, 0.554, 0.48))
SHORT_PIECES = 1.8

#: Fitting: texts of a script and size from which a floor is taken, what is left below the least of them, and the least fall of a floor
#: with each doubling beyond the largest size.
FIT_LEAST, FIT_SLACK, FIT_FALL = 20, 0.01, 0.05


class Floors(dict[str, tuple[list[float], list[float]]]):
    """Entropy floors by script: sizes (log2 of the number of tokens) and least entropy shares.

    ``reach`` has, by script, what no good text goes beyond: sizes, most entropy shares, the least characters per token
    and the most byte fallback.
    """

    def __init__(self, *args):
        super().__init__(*args)
        self.reach: dict[str, tuple[list[float], list[float], float, float]] = {}


SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("script", T.StringType()), T.StructField("n_tokens", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("chars_per_token", "fallback_share", "entropy_share")]
)
#: What a verdict goes by besides: whether the text has a letter of any script.
MEASURES = T.StructType([*SCHEMA.fields, T.StructField("lettered", T.BooleanType())])


def default_vocabulary() -> str:
    """Place of the public vocabulary on this machine; workers resolve it for themselves."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Fertility(dict):
    """Word -> number, with hash and token ids of each numbered word; starts afresh beyond a bound.

    Words are encoded one by one, as they stand after a space, so each distinct word is encoded once per worker.
    """

    def __init__(self, vocabulary: str, bound: int = 150_000):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.model.get_piece_size())])
        self.hash_of, self.bound = WordHashes(1), bound
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        self.hashes, self.start, self.tokens = np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.int32)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.pending.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; afterwards the arrays hold every word's hash and token ids."""
        if len(self) > self.bound:
            self.reset()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            ids = self.model.encode([w.decode("utf-8", "replace") for w in self.pending], num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.tokens = np.concatenate([self.tokens, np.fromiter((t for x in ids for t in x), np.int32, int(lengths.sum()))])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
            self.hashes = np.concatenate([self.hashes, self.hash_of.array(self.pending)])
            self.pending = []
        return out

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """All token ids of the numbered words in order."""
        first = self.start[numbers]
        length = self.start[numbers + 1] - first
        ends = np.cumsum(length)
        return self.tokens[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)]


@lru_cache(1)
def fertility(vocabulary: str) -> Fertility:
    return Fertility(vocabulary)


def script_of(text: str) -> str:
    """The script of most letters; 'other' without any, ties go to the one named first in SCRIPTS."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {s: sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges) for s, ranges in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in windows found twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(window):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        h = mix64(h)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    cover = np.zeros(n + window, np.int32)
    cover[:n] += hit
    cover[window:] -= hit
    return int((np.cumsum(cover)[: n + window - 1] > 0).sum())


def least_entropy_of(floors: Floors | None, script: str, size: float) -> float:
    """The fitted floor for a text of this script and size; 0 where there is none."""
    if not floors or script not in floors:
        return 0.0
    at, least = floors[script]
    if size <= at[-1]:
        return float(np.interp(size, at, least))
    fall = max(FIT_FALL, (least[-2] - least[-1]) / (at[-1] - at[-2])) if len(at) > 1 else FIT_FALL
    return max(0.0, least[-1] - fall * (size - at[-1]))


def floors_from(rows: list[tuple]) -> Floors:
    """Floors from (script, n_tokens, entropy_share) of good texts: by script and rounded size the least share, less a little.

    Rows that go on with (chars_per_token, fallback_share) give the reach of these measures too.
    """
    by: dict[tuple[str, int], list[tuple]] = {}
    for script, n, *measures in rows:
        if n > 1:
            by.setdefault((script, round(math.log2(n))), []).append(tuple(measures))
    out = []
    for (script, size), v in by.items():
        full = all(len(m) == 3 for m in v)
        out.append((script, size, len(v), min(m[0] for m in v), max(m[0] for m in v), min(m[1] for m in v) if full else None, max(m[2] for m in v) if full else None))
    return floors_of(out)


def floors_of(groups: list[tuple]) -> Floors:
    """Floors from (script, size, texts, least entropy, most entropy, least characters per token or None, most byte fallback or None).

    Shares fall with size, so the least of a size's texts is that of its longest ones, and no floor may rise.
    """
    by: dict[str, dict[int, tuple]] = {}
    for script, size, n, *ends in groups:
        if n >= FIT_LEAST:
            by.setdefault(script, {})[size] = tuple(ends)
    out = Floors()
    for script, sizes in by.items():
        at = sorted(sizes)
        least = np.minimum.accumulate([sizes[k][0] - FIT_SLACK for k in at]).tolist()
        out[script] = [float(k) for k in at], least
        if all(sizes[k][2] is not None for k in at):
            most = np.maximum.accumulate([sizes[k][1] + FIT_SLACK for k in reversed(at)])[::-1].tolist()
            out.reach[script] = [float(k) for k in at], most, min(sizes[k][2] for k in at), max(sizes[k][3] for k in at)
    return out


def beyond_reach(floors: Floors | None, script: str, size: float, per_token: float, fallback: float, entropy: float) -> bool:
    """Whether a text falls into shorter pieces than any good text of its script, and holds more entropy than those of its size or more byte fallback.

    Random letters do both; either alone is no reason, as other languages and richer prose differ from the good texts in one of them.
    Texts shorter than those are not held against its entropy.
    """
    if not floors or script not in floors.reach:
        return False
    at, most, pieces, most_fallback = floors.reach[script]
    return per_token < pieces and (fallback > most_fallback + FIT_SLACK or size >= at[0] and entropy > float(np.interp(size, at, most)))


def fit_floors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, good: Column | None = None, limit: int | None = None, vocabulary: str | None = None) -> Floors:
    """Entropy floors, and the reach of all three measures, from every labelled good document that passes the base rules.

    ``labels`` has the id and what ``good`` reads (quality = 1).  All of them are measured, and what comes to the driver is a row for each script and
    size.  Null and repeated ids, labels without a document and empty tables add nothing; scripts and sizes with fewer than FIT_LEAST such
    documents get no floor of their own.  Only a caller that sets ``limit`` gets a fit on that many of them, chosen by a hash of their ids.
    """
    chosen = good_ids(labels, id_col, good)
    if limit is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id", "left_semi")
    return floors_of_measures(quality(texts, "doc_id", "text", vocabulary=vocabulary))


def good_ids(labels: DataFrame, id_col: str = "doc_id", good: Column | None = None) -> DataFrame:
    """The distinct ids of labelled good documents as ``doc_id``."""
    return labels.where(F.col("quality") == 1 if good is None else good).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def floors_of_measures(measures: DataFrame) -> Floors:
    """The fit of ``fit_floors`` from good documents' measures, of which those that pass the base rules count."""
    m = measures.where("not base_failed and n_tokens > 1")
    ends = (F.count("*"), F.min("entropy_share"), F.max("entropy_share"), F.min("chars_per_token"), F.max("fallback_share"))
    groups = m.groupBy("script", F.bround(F.log2("n_tokens")).cast("int").alias("size")).agg(*ends)
    return floors_of([tuple(r) for r in groups.collect()])


def measure(text: str | None, raw: bytes, words: list[bytes], numbers: np.ndarray, f: Fertility, floors: Floors | None = None) -> tuple:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n_words = len(words)
    n_chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    n_repeat = repeated_words(f.hashes[numbers])
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    script = "latin" if raw.isascii() and raw.translate(None, b"0123456789") != raw.translate(None, bytes(range(65, 91)) + bytes(range(97, 123)) + b"0123456789") else script_of(text or "")
    ids = f.ids(numbers)
    n = len(ids)
    per_token = n_chars / n if n else 0.0
    fallback = float(f.byte[ids].sum()) / n if n else 0.0
    if n > 1:
        s = np.sort(ids)
        c = np.diff(np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [n])))
        entropy = (math.log2(n) - float((c * np.log2(c)).sum()) / n) / math.log2(min(n, len(f.byte)))
    else:
        entropy = 0.0
    lettered = script != "other" or any(map(str.isalpha, text or ""))
    kept = verdict(failed, lettered, script, n, per_token, fallback, entropy, floors)
    return n_words, n_chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), n_repeat, failed, kept, script, n, per_token, fallback, entropy, lettered


def verdict(failed: bool, lettered: bool, script: str, n: int, per_token: float, fallback: float, entropy: float, floors: Floors | None) -> bool:
    """Whether a text of these measures is kept."""
    low, high, most_fallback, least_entropy = BANDS[script]
    # Without a single letter of any script a text is no language.
    plausible = lettered
    if n > 1:
        size = math.log2(n)
        if script == "latin" and not (floors and script in floors):
            least_entropy = max(least_entropy, float(np.interp(size, *LEAST_ENTROPY)))
            plausible = per_token >= SHORT_PIECES or entropy <= float(np.interp(size, *MOST_ENTROPY))
        else:
            least_entropy = max(least_entropy, least_entropy_of(floors, script, size))
            plausible = plausible and not beyond_reach(floors, script, size, per_token, fallback, entropy)
    return not failed and plausible and low <= per_token <= high and fallback <= most_fallback and entropy >= least_entropy


def measured(texts: pa.Array, vocabulary: str | None, floors: Floors | None = None) -> Iterator[tuple]:
    f = fertility(vocabulary or default_vocabulary())
    for at in range(0, len(texts), 256):  # a few texts at a time, so memory stays small
        part = texts.slice(at, 256)
        strings = part.to_pylist()
        raws = text_bytes(part)
        words = [x.split() for x in raws]
        numbers = f.numbers([w for x in words for w in x])
        end = 0
        for s, raw, w in zip(strings, raws, words, strict=True):
            yield measure(s, raw, w, numbers[end : end + len(w)], f, floors)
            end += len(w)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, floors: Floors | None = None) -> DataFrame:
    """One row of measures and a verdict per input row (SCHEMA).

    Base rules fail a text with fewer than 20 words or with over 30 % of its words in repeated 8-word windows.
    The fertility of a public vocabulary decides the rest: characters per token, share of byte-fallback (or
    unknown) tokens and token entropy must lie in the bands of the text's script; text without any letter is not kept.
    Without a fit for it, Latin text has fixed bands that go by the number of tokens.
    ``floors`` (``fit_floors``) replace them: they raise the least entropy to what good documents of the script and size have, and reject what goes
    beyond their reach (``beyond_reach``).

    Null and empty texts have zero in all counts and fail the base rules, and so does a text of white space;
    null ids stay null; repeated rows are judged each on its own; very long texts are measured whole; an empty
    table gives no rows; other columns are not read.  ``vocabulary`` is a sentencepiece file on every worker.
    """

    return _measures(df, id_col, text_col, vocabulary, floors).select(*SCHEMA.names)


def _arrow(schema: T.StructType) -> list[pa.Field]:
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    return [pa.field(f.name, types[f.dataType.simpleString()]) for f in schema]


def _measures(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None, floors: Floors | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(measured(b.column(1), vocabulary, floors))
            columns = [b.column(0)] + [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(schema))

    schema = _arrow(MEASURES)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MEASURES)


def fit_and_judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, good: Column | None = None, vocabulary: str | None = None) -> DataFrame:
    """``quality`` with the floors that ``fit_floors`` gives for the same table, from one pass over its texts.

    A row of measures for each document is written; the fit joins the labels to these rows, and verdicts are made from them, so that no text
    is shuffled, kept or measured twice.
    """
    m = materialise(_measures(docs, id_col, text_col, vocabulary), "measures")
    floors = floors_of_measures(m.join(good_ids(labels, id_col, good), "doc_id", "left_semi"))
    by = [MEASURES.names.index(c) for c in ("base_failed", "lettered", "script", "n_tokens", "chars_per_token", "fallback_share", "entropy_share")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = SCHEMA.names.index("kept")
        for b in batches:
            kept = [verdict(*row, floors) for row in zip(*(b.column(i).to_pylist() for i in by), strict=True)]
            columns = [pa.array(kept, pa.bool_()) if i == at else b.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(schema))

    schema = _arrow(SCHEMA)
    return m.mapInArrow(run, SCHEMA)


def keep_good(df: DataFrame, text_col: str = "text", *, vocabulary: str | None = None, floors: Floors | None = None) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text passes the rules; one pass, no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([r[6] for r in measured(b.column(at).cast(pa.string()), vocabulary, floors)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
