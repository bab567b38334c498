"""What a Python worker needs at a time: an executor holds one for each core beside its heap."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

import public_tokenizers
from odlake.llm import bpe, common, repeats, suffixes


def most(work) -> float:
    """MB that work() needs at once, beyond what there is."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_segments_of_long_texts_are_found_in_little_memory():
    text = np.random.default_rng(1).integers(97, 123, 2_000_000).astype("u1").tobytes()
    ids = np.zeros(1, np.int64)
    assert most(lambda: repeats.of_batch(suffixes.BYTES, ids, ids, [text], [])) < 40


def test_character_classes_are_asked_for_in_little_memory():
    assert most(lambda: bpe.Splitter(public_tokenizers.PATTERN)) < 12


def test_freed_memory_is_given_back_when_a_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    assert list(common.frugal(lambda batches: batches)(iter([batch]))) == [batch] and given == [1]
    assert common.frugal_groups(lambda a: a)(1) == 1 and common.frugal_pairs(lambda a, b: a + b)(1, 2) == 3 and len(given) == 3
