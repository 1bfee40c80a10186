"""Memory that Python workers hold beside a full heap."""

import random

import numpy as np
import pyarrow as pa

from gatehouse.llm import common, sentencepiece_codec


def test_a_task_of_many_words_remembers_little_of_them():
    chance = random.Random(5)
    texts = [" ".join("".join(chance.choices("abcdefghijklmnopqrst", k=6)) for _ in range(20_000)) for _ in range(16)]
    code = sentencepiece_codec._coder(sentencepiece_codec.MODEL, True)
    most = 0
    for _ in code(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(16), pa.int64()), "text": texts})])):
        own, table = sentencepiece_codec._CODECS[sentencepiece_codec.MODEL]
        arrays = [own.slot_key, own.slot_ok, *[x for x in vars(table).values() if isinstance(x, np.ndarray)]]
        most = max(most, sum(x.nbytes for x in arrays) + 100 * len(own.pairs))
    assert most < 48 << 20


def test_arrays_that_are_done_with_go_back_to_the_system():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    kept = [np.ones(1 << 12) for _ in range(4000)]  # 32 KB each, which the C library takes from its heap
    held = kept[::100]
    full = resident()
    del kept
    common.spare()
    assert full - resident() > 64 << 20
    assert len(held) == 40
