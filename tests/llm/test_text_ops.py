"""op5, op6, op7, op8 and op10 against plain versions of themselves."""

import hashlib
import math
import random
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest

from gatehouse.llm import fingerprints, mixing, sentencepiece_codec, token_counts, token_files
from gatehouse.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n long, ids string, times int"
ODD = [(900, None), (901, ""), (902, " "), (903, "a▁b  c\n\n d"), (904, "é😀　ß " * 40), (905, "x" * 9000), (906, "tail \n"), (906, "again the same id"), (None, "no id"), (907, "    end")]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60").collect()]
    return rows + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, None, 3, "x", 1) for d, t in texts], SCHEMA).repartition(5)


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


def test_sentencepiece_equals_the_library_and_comes_back(spark, docs, texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sentencepiece_codec.encode(docs).collect()
    assert same([(r.doc_id, r.ids) for r in got], [(d, own.encode(t) if t else []) for d, t in texts])
    assert same([(r.doc_id, r.decoded) for r in got], [(d, (t or "").replace("▁", " ")) for d, t in texts])
    assert all(r.exact for r in got)
    short = sentencepiece_codec.encode(docs, digest=True).collect()
    crc = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert same([(r.doc_id, r.ids_crc32) for r in short], [(r.doc_id, crc(r.ids)) for r in got])
    assert sentencepiece_codec.encode(docs.limit(0)).count() == 0


def test_words_without_a_way_are_merged_one_by_one(monkeypatch):
    import numpy as np
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec = sentencepiece_codec.Codec()
    monkeypatch.setattr(codec, "_apart", lambda left, right: np.zeros(len(left), bool))
    words = ["▁hello", "▁naïve", "▁字字", "▁" + "ab" * 20, "▁x"]
    size, ids = codec.encode_words(words)
    assert [ids[a - n : a].tolist() for a, n in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)] == [own.encode(w[1:]) for w in words]


def test_texts_without_spaces():
    import base64
    import time

    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec, rng = sentencepiece_codec.Codec(), random.Random(3)
    encoded = base64.b64encode(rng.randbytes(150_000)).decode()
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60_000))
    mixed = "".join(rng.choice(["字", "é", "the", "ing", "😀", "123", "_", "a"]) for _ in range(40_000))
    words = ["▁" + encoded, "▁" + chinese, "▁" + mixed, "▁" + "ab" * 2000, "▁short", "▁" + "x" * 70]
    began = time.time()
    size, ids = codec.encode_words(words)
    assert time.time() - began < 30
    for w, a, n in zip(words, np.cumsum(size).tolist(), size.tolist(), strict=True):
        assert "".join(codec.parts(w)) == w
        assert ids[a - n : a].tolist() == own.encode(w[1:])


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(docs, texts, rule):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for d, t in texts:
        t = t or ""
        starts = [0, *[m.end() for m in re.finditer("\n", t) if m.end() < len(t)]]
        n, over = [0] * len(starts), [0] * len(starts)
        for a, b in own.encode(t, add_special_tokens=False).offsets:
            first, last = (max(k for k, s in enumerate(starts) if s <= x) for x in (a, max(a, b - 1)))
            at = first if rule == "first" else last
            if rule == "most":
                held = [min([*starts, len(t)][k + 1], b) - max(starts[k], a) for k in range(first, last + 1)]
                at = first + held.index(max(held))
            n[at] += 1
            over[at] += first != last
        wanted += [(d, k, s, e, n[k], over[k]) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(t)], strict=True))]
    assert same([tuple(r) for r in token_counts.section_tokens(docs, rule=rule).collect()], wanted)
    assert token_counts.section_tokens(docs.limit(0)).count() == 0


def plain_digest(raw):
    """The digest again, one byte triplet at a time."""
    if len(raw) < 3:
        return "00" * 64 + f"{len(raw):02x}" + raw.hex().rjust(4, "0")
    m, counts = 0xFFFFFFFF, [0] * 256
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        h = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA6B & m)
        h = (h ^ h >> 15) * 0xC2B2AE35 & m
        h = (h + c) * 0x27D4EB2F & m
        h = (h ^ h >> 13) * 0x165667B1 & m
        counts[h >> 24] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    digits = [sum(c > x for x in q) for c in counts]
    out = "".join(f"{digits[i] << 6 | digits[i + 1] << 4 | digits[i + 2] << 2 | digits[i + 3]:02x}" for i in range(0, 256, 4))
    return out + f"{min(255, 3 + int(math.log(len(raw)) / math.log(1.25) + 1e-12)):02x}0000"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    two = lambda s: [int(s[2 * i : 2 * i + 2], 16) >> k & 3 for i in range(64) for k in (6, 4, 2, 0)]
    cost = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(two(a), two(b), strict=True)) / 256
    steps = min(10, abs(int(a[128:130], 16) - int(b[128:130], 16)))
    return max(0.0, min(0.999, 1 - (cost + 0.06 * steps) / 3))


def test_fingerprints(spark, texts):
    """Against a plain version, from each document to the next and from the last to the first."""
    plain = sorted({d: t or "" for d, t in texts if d is not None}.items())
    docs = spark.createDataFrame([(d, t, None, 3, "x", 1) for d, t in plain], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert len(got) == len(plain)
    for (d, t), (_, u) in zip(plain, [*plain[1:], plain[0]], strict=True):
        r, k = got[d], len(t) // 4
        new = (t[:-k] if k else t) + u[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        marks = [plain_digest(x.encode()) for x in (t, new, u)]
        assert (r.fingerprint, r.edited_fingerprint) == tuple(marks[:2]), d
        assert (r.near_edited, r.near_next) == pytest.approx((plain_likeness(*marks[:2]), plain_likeness(marks[0], marks[2])))
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    assert fingerprints.fingerprint_documents(docs.where("doc_id = 905")).collect()[0].near_next == 1.0


def test_fingerprints_of_repeated_and_null_ids(docs, texts):
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert same([(r.doc_id, r.n_chars, r.fingerprint) for r in rows], [(d, len(t or ""), plain_digest((t or "").encode())) for d, t in texts])


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = tempfile.mkdtemp(prefix="gatehouse-test-") + "/ids"
    token_files.write_tokens(docs, path)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    wanted = []
    for d, t in texts:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    assert same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], wanted)
    path += "-none"
    token_files.write_tokens(docs.limit(0), path)
    assert token_files.read_tokens(spark, path).count() == 0


def test_random_access():
    import numpy as np

    rng = np.random.default_rng(1)
    ids = rng.choice([0, 7, 255, 256, 50_000, 70_000, 1 << 24], 3000).astype(np.int64)
    levels, marks, ranks = token_files.encode(ids)
    assert (token_files.decode(levels, marks) == ids).all()
    assert all(token_files.token(levels, marks, ranks, i) == ids[i] for i in range(3000))
    for some in (ids, ids[:2048], ids[:512], ids[:1], ids[ids < 256]):
        held = token_files.Segment(*token_files.encode(some))
        for _ in range(300):
            a, b = sorted(rng.integers(0, len(some) + 1, 2).tolist())
            assert (held.span(a, b) == some[a:b]).all()
        assert (held.span(0, len(some)) == some).all()


def water(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s] + 1e-9]
        if not over or len(over) == len(left):
            return fixed | {s: min(share[s], most * sizes[s]) for s in left}
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(d, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a"] * 30 + ["b", "c", "é", None])) for d in range(800)] + [(900, None, "a"), (901, "", "b"), (902, "w", "b"), (902, "w", "b"), (903, None, "empty")]
    docs = spark.createDataFrame([(d, t, s, 1, "clash", 9) for d, t, s in rows], "doc_id long, text string, source string, size int, extra string, times int").repartition(6)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted = water(sizes, mixing.WEIGHTS, mixing.MOST)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.times <= mixing.MOST
        taken[r.source] += r.times * r["size"]
    assert all(abs(taken[s] - wanted[s]) <= 40 for s in sizes)
    key = lambda r: (r.doc_id, r.times, r["size"])
    assert same(map(key, got), map(key, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_keeps_clashing_columns(spark):
    names = ["row", "id", "h", "slice", "of", "end", "whole", "part", "more", "_h", "_slice", "_more", "_end", "_whole", "_part", "_source"]
    docs = spark.createDataFrame([(d, "w " * (d + 1), "s", *range(16)) for d in range(5)], ["doc_id", "text", "source", *names])
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and all([r[n] for n in names] == list(range(16)) and r.times == 1 for r in got)


def test_op2_equals_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = [tuple(r) for r in QUERIES["op2_chat_format"](spark, SF).select("conv_id", "n_turns", "rendered").collect()]
    assert same(got, db.sql(f"select conv_id, n_turns, rendered from ({ORACLE_SQL['op2_chat_format']})").fetchall())


def test_queries_give_a_row_a_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_toxicity", "op5_sentencepiece", "op7_fingerprints", "op8_token_files", "op10_mixing"):
        assert QUERIES[name](spark, SF).count() == n, name
