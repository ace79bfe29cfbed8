import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from threadloom.llm import tokenise

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ATOMS = ["a", "bc", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "漢", "!!", "  \n", "zzzz", "<|endoftext|>", "\U0001f600", "\xa0"]


@pytest.fixture(scope="module")
def library():
    coder = tokenise.bpe(RANKS, PATTERN)
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(1, 0), (3, 1), (7, 4), (16, 8)])
def test_chunks_as_the_library(library, chunk, overlap):
    rng = random.Random(chunk)
    coder = tokenise.bpe(RANKS, PATTERN)
    for _ in range(400):
        text = "".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 100)))
        ids = np.frombuffer(coder.encode(text, chunk, overlap), dtype="<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert coder.decode(coder.encode(text, chunk, overlap)) == text.encode()


def test_rows_and_long_texts(docs, library):
    long = ("word and more, " * 40 + " " * 90 + "x" * 120) * 2
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, long), (4, long), (5, long + "z"), (6, " " * 300)]
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    got = tokenise.encode(docs(rows), RANKS, PATTERN, columns, chunk=64, overlap=16).collect()
    want = []
    for key, text in rows:
        raw = np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()
        want.append((key, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)
    assert tokenise.encode(docs([]), RANKS, PATTERN).count() == 0


def test_round_trip(docs):
    df = docs([(1, "Ein schöner Tag"), (2, ""), (3, None)])
    back = tokenise.decode(tokenise.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert {r.doc_id: bytes(r.raw) for r in back.collect()} == {1: "Ein schöner Tag".encode(), 2: b"", 3: b""}


def test_merges_as_the_library(library):
    """Both forms of the merge, on pieces short and long, against the library's own."""
    ranks, rng = tokenise.bpe(RANKS, PATTERN).ranks, random.Random(1)
    for n in (1, 2, 5, 150, 201, 2000):
        for letters in ("ab", "abcdefghij etz", "é中a\U0001f600", " "):
            for _ in range(5):
                raw = "".join(rng.choice(letters) for _ in range(n)).encode()
                if raw not in ranks:
                    want = library._encode_single_piece(raw)
                    assert tokenise.merged(ranks, raw) == want and tokenise.merged_long(ranks, raw) == want
    assert len(tokenise.merged_long(ranks, b"ab" * 100_000)) > 0


def test_many_pieces_are_merged_together(library):
    """Pre-tokens of many texts that aren't remembered are encoded in one call, each once, as the library does."""
    coder, rng = tokenise.Bpe(RANKS, PATTERN), random.Random(2)
    calls = []
    coder.memory = tokenise.Memory(lambda missing: calls.append(missing) or coder._encoded(missing), 500)
    for _ in range(4):
        texts = ["".join(rng.choice(["a", "b", "th", "er", "é", "中", "\U0001f600", "12", "!", " ", "x" * 70]) for _ in range(rng.randint(0, 60))) for _ in range(50)]
        got = coder.memory.join([coder.cut(text) for text in texts])
        assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in got] == list(map(library.encode_ordinary, texts))
    assert len(calls) == 4 and all(len(set(missing)) == len(missing) for missing in calls)
    assert not any(len(piece) > tokenise.REMEMBERED_PIECE for piece in coder.memory.now)


def test_pairs_of_any_vocabulary():
    """Against the merge of one piece; a byte without a rank is met only where it is left over."""
    ranks = {bytes([i]): 2 * i for i in range(256) if i != ord("q")} | {b"ab": 1, b"qu": 3, b"abab": 5, b"ba": 7, b"abqu": 9, b"aa": 11}
    pairs, rng = tokenise.Pairs(ranks), random.Random(3)
    raws = [b"", *["".join(rng.choice(["a", "b", "qu", "z"]) for _ in range(rng.randint(0, 20))).encode() for _ in range(300)]]
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in pairs.merged(raws)] == [tokenise.merged(ranks, raw) for raw in raws]
    assert pairs.merged([]) == []
    with pytest.raises(KeyError):
        pairs.merged([b"aq"])
