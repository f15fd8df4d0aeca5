import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from tidegauge.llm import bpe, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
SAMPLES = ["", "Hello, WORLD!! it's 42nd don't I'LL", "ΣΑΣ İstanbul ǅ ﬁ é naïve", "tab\tnew\nline\x85\xa0nbsp em",
           "<|endoftext|> mid<|startoftext|>dle <|ENDOFTEXT|>", "日本語 текст עברית العربية हिन्दी 🙂🏽", "²½Ⅷ 12３４ a1b2_c-d", "x" * 700,
           "\x00\x1c\x1f ctrl", "''s'd'll ' 's", "​﻿ zero", "ß SS ẞ"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "abcdehiorstnéüñ AB.,'12\n"
    return SAMPLES + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]


def test_bpe_equals_library(texts):
    library, own = Tokenizer.from_file(PATH), bpe.WordBpe(open(PATH, encoding="utf-8").read())
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False), t


def test_bpe_memo_limit(texts):
    own = bpe.WordBpe(open(PATH, encoding="utf-8").read())
    want = [own.encode(t) for t in texts]
    own.memo.limit = 3
    own.memo.clear()
    assert [own.encode(t) for t in texts] == want


def test_bpe_queries(spark, awkward, nothing):
    library = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, bpe.digests(awkward, PATH).collect()), key=str)
    want = []
    for r in awkward.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(nothing, PATH).count() == 0
    ids = bpe.encode(awkward, PATH)
    both = bpe.decode(ids, PATH)
    assert both.columns == [*awkward.columns, "ids", "decoded"]
    assert sorted((hashlib.sha256(r.decoded.encode()).hexdigest() for r in both.collect())) == sorted(w[3] for w in want)


def library_counter(pieces, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(tokencount.MARK), normalizers.Replace(" ", tokencount.MARK)])
    return t


def test_counts_equal_library(texts):
    pieces = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    own, library = tokencount.UnigramCounter(pieces, True), library_counter(pieces, True)
    for t in texts + ["a  b   c    d", " lead", "trail ", MARKS, "<s> </s> <unk> <0x41>", "\n\n\n", "a \n b"]:
        assert own.count(t) == len(library.encode(t).ids), t


MARKS = tokencount.MARK * 5 + "x" + tokencount.MARK


def test_ties_and_unknown_characters():
    """Small vocabularies with many equal scores, with and without pieces over word marks."""
    rng = random.Random(11)
    for round in range(60):
        alphabet = "abc" + tokencount.MARK
        names = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 4))) for _ in range(12)}
        if round % 2:
            names = {n for n in names if tokencount.MARK not in n.lstrip(tokencount.MARK)} | {tokencount.MARK}
        pieces = [("<unk>", 0.0)] + [(n, float(-rng.randrange(1, 4))) for n in sorted(names)]
        own, library = tokencount.UnigramCounter(pieces, False), library_counter(pieces, False)
        for _ in range(40):
            t = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(14)))
            assert own.count(t) == len(library.encode(t).ids), (pieces, t)


def test_count_rows(awkward, nothing):
    pieces = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    library = library_counter(pieces, True)
    got = sorted(map(tuple, tokencount.token_counts(awkward, pieces).collect()), key=str)
    assert got == sorted([(r.doc_id, len(library.encode(r.text or "").ids)) for r in awkward.collect()], key=str)
    assert tokencount.token_counts(nothing, pieces).count() == 0
