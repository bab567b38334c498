"""Whether two tokens may stand together, against the merges themselves."""

import random
import time

import public_tokenizers
import pytest

from odlake.llm import bpe


def test_pairs_agree_with_the_merges_of_random_vocabularies():
    draw = random.Random(3)
    for alphabet in (b"ab", b"abc") * 20:
        ranks = {bytes([c]): k for k, c in enumerate(alphabet)}
        for _ in range(25):
            joined = draw.choice(list(ranks)) + draw.choice(list(ranks))
            if len(joined) < 9:
                ranks.setdefault(joined, len(ranks))
        known = bpe.Pieces(ranks)
        for a, left in known.bytes.items():
            for b, right in known.bytes.items():
                assert known.fit(a << 32 | b) == (bpe.merged(left + right, ranks) == [a, b]), (ranks, left, right)


def test_a_token_out_of_the_order_of_ranks_is_decided_by_the_merges():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 9, b"abc": 4, b"cc": 5}
    known = bpe.Pieces(ranks)
    assert known.edges(4) is None
    for a, left in known.bytes.items():
        for b, right in known.bytes.items():
            assert known.fit(a << 32 | b) == (bpe.merged(left + right, ranks) == [a, b])


def test_forgetting_pairs_changes_no_ids(monkeypatch):
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4, b"ba": 5}
    texts = ["".join(random.Random(k).choices("ab", k=1 + k % 30)) for k in range(200)]
    whole = [bpe.Pieces(ranks)[t] for t in texts]
    monkeypatch.setattr(bpe, "PAIRS", 2)
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    few = bpe.Pieces(ranks)
    assert [few[t] for t in texts] == whole
    assert whole == [b"".join(i.to_bytes(4, "little") for i in bpe.merged(t.encode(), ranks)) for t in texts]


@pytest.mark.parametrize("shape", ["pairs", "letters", "accents"])
def test_a_very_long_piece_takes_linear_time(shape):
    """Two and four megabytes of one piece: twice the text, about twice the time."""
    rng = random.Random(1)
    letters = {"pairs": lambda n: "ab" * (n // 2), "letters": lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)), "accents": lambda n: "é" * (n // 2)}[shape]
    known, took = bpe.Pieces(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), []
    known.encode(letters(100_000).encode().decode("latin-1"))  # pairs are known afterwards
    for n in (2_000_000, 4_000_000):
        text = letters(n).encode().decode("latin-1")
        began = time.process_time()
        ids = known.encode(text)
        took.append(time.process_time() - began)
        assert b"".join(known.bytes[i] for i in ids) == text.encode("latin-1")
    assert took[1] < 2.5 * took[0] + 0.5
