import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, empty_table, odd_table, odd_texts
from tokenizers import Tokenizer

from cytoframe.llm import bpe, coder, lengths, queries, tokens


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


ODD = ["Hello WORLD's it'll don't 123 ½ ſ ΣΑΣ İstanbul", "<|startoftext|>a b<|endoftext|> c<|endoftext", "日本語 テスト  emoji 😀😀   x y", "é ́a", "a  b", " a", "a ", "a \n b", "a\n b", "a \x1cb", "x\0 y", "\xa0 \xa0a b", "a<|endoftext|> b", "a  <|endoftext|>", "'s 't", "a 's", " " * 90]


def test_trie_encoding_is_the_librarys(word_library):
    e = bpe.WordBpe(bpe.default_vocabulary())
    texts = [t or "" for t in odd_texts()] + ODD
    for text, ids in zip(texts, e.encode(texts), strict=True):
        want = word_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert e.decode(ids) == word_library.decode(want, skip_special_tokens=False)


def test_trie_bound_does_not_change_results():
    small, large = bpe.WordBpe(bpe.default_vocabulary(), bound=5), bpe.WordBpe(bpe.default_vocabulary())
    texts = [t or "" for t in odd_texts()[:12]] + ODD
    assert [small.encode([t])[0] for t in texts] == large.encode(texts)


def test_op6(spark, word_library):
    got = {r.doc_id: r for r in queries.op6_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = word_library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, word_library):
    df = odd_table(spark, ODD)
    e = bpe.encode(df)
    assert sorted(map(repr, ((r.doc_id, bytes(r.ids)) for r in e.collect()))) == sorted(repr((r.doc_id, np.array(word_library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes())) for r in df.collect())
    assert bpe.decode(e).count() == df.count() and bpe.encode(empty_table(spark)).count() == 0


def test_encoding_by_pieces_is_the_librarys(byte_library):
    texts = [t or "" for t in odd_texts()] + ODD
    for e in (tokens.WordEncoder(tokens.default_vocabulary()), tokens.WordEncoder(tokens.default_vocabulary(), bound=5)):
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_a_word_is_encoded_once_whatever_mark_follows(byte_library):
    class Counted:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, piece):
            self.calls += 1
            return self.model.tokenize(piece)

    e = tokens.WordEncoder(tokens.default_vocabulary())
    e.model = Counted(e.model)
    texts = ["".join(f" {w}{i % 10 * 'x'}{mark}" for i in range(20) for w in ("thha", "née")) for mark in ("", ",", ".", "!!", '"', ")")]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids
    # Twenty words, five marks; a word that ends in a letter beyond ASCII keeps its mark in one stretch (née itself, five times).
    assert e.model.calls <= 20 + 5 + 5 and e.kept <= 20 + 5 + 5
    assert not any(isinstance(x, list) for x in e.pieces.values())


def test_cuts_before_marks_are_the_librarys(byte_library):
    r = random.Random(7)
    parts = ["a", "don", "'t", "'s", "'re", "'", " ", "  ", "\n", "\t", "\r", ".", ",", "!!", "***", "<|endoftext|>", "endoftext", "<|", "|>", "<", "é", "日本", "½", "3", "\x1c", "\x85", "\xa0", "…", "\u0301", "😀", " The", "_", "-", "$5", "ſ", "x.y", "A1", "ß,", "\x00", "ʰ"]
    texts = ["".join(r.choices(parts, k=r.randrange(1, 25))) for _ in range(2000)]
    for e in (tokens.WordEncoder(tokens.default_vocabulary()), tokens.WordEncoder(tokens.default_vocabulary(), bound=20)):
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            want = [byte_library.encode(t, add_special_tokens=False).ids for t in some]
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(some)] == want
            assert e.count(some) == [len(x) for x in want]


def test_special_tokens_of_letters_or_with_marks_inside(tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    library.add_special_tokens(["EOT", "A1.b"])
    path = str(tmp_path / "special.json")
    library.save(path)
    texts = ["an EOT here", "EOT", "xEOTy, EOT.", "plain, words.", " A1.b A1.c", "xA1.b!", "A1.b"]
    for text, ids in zip(texts, tokens.WordEncoder(path).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_coder_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, coder.BLOCK - 1, coder.BLOCK, coder.BLOCK + 1, 9 * coder.BLOCK + 5):
        for ids in (r.integers(0, 1 << 16, n), np.zeros(n), r.zipf(1.3, n) % 50_000, np.arange(n) % 17, r.integers(0, 1 << 24, n)):
            ids = ids.astype(np.uint32)
            names, got_lengths, got = coder.unpack(coder.pack([5, None], [0, n], ids))
            assert names == [5, None] and got_lengths.tolist() == [0, n] and (got == ids).all()
    # So many distinct ids that words of 16 bits are written instead of 32.
    many = np.concatenate([np.arange(300_000), r.integers(0, 1 << 31, 5000)]).astype(np.uint32)
    assert (coder.unpack(coder.pack([1], [len(many)], many))[2] == many).all()
    repeated = np.tile(r.integers(0, 50_000, 64), 256).astype(np.uint32)
    assert len(coder.pack([1], [len(repeated)], repeated)) < len(repeated) / 4


def test_carries_and_ends_of_blocks():
    for kind in ("<u4", "<u2"):
        most = np.iinfo(kind).max
        out = np.array([5, most, most, 7, 0, 8], kind)
        coder._carry(out, np.array([3, 5]))
        assert out.tolist() == [6, 0, 0, 7, 1, 8]
    # Ids that cost nothing leave one word of four bytes in a block.
    zero, places = coder.Zero.of(np.zeros(3, np.uint32))
    assert len(coder.code_blocks(zero, places)[0]) == 4


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32)
    p = bytearray(coder.pack([1], [5000], ids))
    p[-1] ^= 1
    with pytest.raises(ValueError, match="block 2"):
        coder.unpack(bytes(p))
    p = bytearray(coder.pack([1], [5000], ids))
    p[30] ^= 1
    with pytest.raises(ValueError, match="head"):
        coder.unpack(bytes(p))


def test_op3(spark, byte_library):
    got = {r.doc_id: r for r in queries.op3_token_ids(spark, SF).collect()}
    start = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = byte_library.encode(d.text, add_special_tokens=False).ids + [0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_of_odd_rows(spark, byte_library):
    df = odd_table(spark, ODD)
    path = coder.new_path(spark)
    coder.write_ids(df, path)
    got = sorted(repr((r.doc_id, bytes(r.ids))) for r in coder.read_ids(spark, path).collect())
    assert got == sorted(repr((r.doc_id, np.array([*byte_library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in df.collect())
    path = coder.new_path(spark)
    coder.write_ids(empty_table(spark), path)
    assert coder.read_ids(spark, path).count() == 0 and coder.starts(spark, path).count() == 0


def test_length_histogram(spark, byte_library):
    df = odd_table(spark, ODD)
    n = sorted(len(byte_library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect())
    h = lengths.length_histogram(lengths.token_lengths(df))
    rows = h.collect()
    assert {r.n_tokens for r in rows} == set(n)
    for r in rows:
        assert r.n_docs == n.count(r.n_tokens) and r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.n_tokens)
        assert (r.docs_total, r.tokens_total, r.truncated_total) == (len(n), sum(n), sum(min(x, r.n_tokens) for x in n))
    for r in lengths.at_limits(h, [0, 1, 7, 512, 10**9]).collect():
        left = sum(min(x, r.context_limit) for x in n)
        assert (r.docs_whole, r.docs_cut, r.tokens_left, r.tokens_lost) == (sum(x <= r.context_limit for x in n), sum(x > r.context_limit for x in n), left, sum(n) - left)
    for r in lengths.quantiles(h, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(x for x in n if sum(y <= x for y in n) >= r.share * len(n) - 1e-9)
    empty = lengths.length_histogram(lengths.token_lengths(empty_table(spark)))
    assert empty.collect() == [] and lengths.at_limits(empty, [5]).first().tokens_left == 0


def test_vocabulary_files_are_not_copied():
    json.dumps({"files": [tokens.VOCABULARY, bpe.VOCABULARY]})
    assert tokens.default_vocabulary().startswith(public_tokenizers.__path__[0])
