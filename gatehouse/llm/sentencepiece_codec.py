"""Encoding and decoding with a SentencePiece BPE model by batched Viterbi: op5 and a stage of the pipeline."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import chunks, common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of pieces whose joint encoding is remembered at most, and the bits of the table in which they are first looked for.
PAIRS, SLOTS = 1 << 17, 20
#: Bits of the slots of a task's table of words: two workers of an executor hold one each, beside a heap that earlier stages have filled.
WORDS = 19
#: Bytes of the documents that are encoded together.
TOGETHER = 1 << 19
#: Words, as characters, that advance together.
CELLS = 1 << 20
#: Characters from which a word is cut where no piece can cross, so that its parts advance together too.
LONG = 64


class Codec:
    """The pieces of a model, and words encoded with them in batches.

    The model is a byte-pair one: a text's pieces are what its merges leave, not the cut with the
    largest sum of scores, so a Viterbi over scores would give other ids than the library. Here the
    Viterbi's states are the last pieces: the encoding of a word's first i characters is the encoding
    of its first i - l characters and one more piece just where these two pieces, merged alone, stay
    apart. A step is scored with its length if so and with 0 if not, and the maximum is the
    backpointer, so ties can't be and the longest would win. That the ids are the library's follows from
    merges looking at neighbours alone: two pieces that stay apart when merged alone stay apart within
    any word, and a word has one cut all of whose neighbours do.
    """

    def __init__(self, model: str = MODEL) -> None:
        import public_tokenizers
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.size = len(own)
        if not own.is_byte(own.piece_to_id("<0x00>")):
            raise ValueError("the model has no byte pieces")
        self.byte0 = own.piece_to_id("<0x00>")
        self.pieces = [own.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece goes on behind a space")
        self.score = {self.pieces[i]: own.get_score(i) for i in plain}
        self.state = {self.pieces[i]: i for i in plain}
        self.longest = max(map(len, self.score))
        #: Neighbours within any piece, as two characters in one number: between others no merge ever takes place.
        self.inner = np.array(sorted({ord(a) << 21 | ord(b) for p in self.score for a, b in zip(p, p[1:], strict=False)}), np.int64)
        # Pieces that their own merges don't leave whole never come up.
        whole = [i for i in plain if self.merged(self.pieces[i]) == [self.pieces[i]]]
        keys = np.array([self._hash_of(self.pieces[i]) for i in whole], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(whole, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.power = np.array([pow(int(_BASE), j, 1 << 64) for j in range(self.longest + 1)], np.uint64)
        self.pairs: dict[int, bool] = {}
        self.slot_key, self.slot_ok = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        spelled = [bytes([i - self.byte0]) if self.byte0 <= i < self.byte0 + 256 else b"" if own.is_control(i) or own.is_unknown(i) else self.pieces[i].replace(SPACE, " ").encode() for i in range(self.size)]
        self.spell_size = np.array([len(x) for x in spelled], np.int64)
        self.spell_start = np.cumsum(self.spell_size) - self.spell_size
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    @staticmethod
    def _hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def merged(self, text: str) -> list[str]:
        """Merges one short string: again and again the best-scored pair of neighbours, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[p], -k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _text(self, state: int) -> str:
        return self.pieces[state] if state < self.size else chr(state - self.size)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces merged alone stay these two; states from `size` on are characters without a piece."""
        wanted = left * (1 << 22) + right
        slot = (common.mix(wanted.view(np.uint64)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        ok = self.slot_ok[slot]
        missed = np.flatnonzero(self.slot_key[slot] != wanted)
        if len(missed):
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            new, back = np.unique(wanted[missed], return_inverse=True)
            known = np.array([self._pair(key) for key in new.tolist()], bool)
            ok[missed] = known[back]
            at = slot[missed]
            self.slot_key[at], self.slot_ok[at] = wanted[missed], ok[missed]
        return ok

    def _pair(self, key: int) -> bool:
        ok = self.pairs.get(key)
        if ok is None:
            a, b = self._text(key >> 22), self._text(key & ((1 << 22) - 1))
            ok = self.pairs[key] = self.merged(a + b) == [a, b]
        return ok

    def _pieces_in(self, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in words of one length, by their ends: (end, word, length, piece). Hashes are sieved before they probe the sorted keys."""
        found = []
        for l in range(1, min(len(prefix) - 1, self.longest) + 1):
            hashes = prefix[l:] - prefix[:-l] * self.power[l]
            row, word = np.nonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
            some = hashes[row, word]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == some)
            found.append((row[hit] + l, word[hit], np.full(len(hit), l, np.int64), self.ids[at[hit]]))
        end, word, l, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return end[order], word[order], l[order], piece[order]

    def _equal_length(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of states of words of one length, and all their states, from their characters (words x length)."""
        n, length = codes.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        end, word, l, piece = self._pieces_in(prefix)
        cut = np.searchsorted(end, np.arange(1, length + 2))
        last, back, lost = np.zeros((length + 1, n), np.int64), np.zeros((length + 1, n), np.int64), np.zeros(n, bool)
        for i in range(1, length + 1):
            span = slice(cut[i - 1], cut[i])
            w, step, p = word[span], l[span], piece[span]
            alone = np.ones(n, bool)
            alone[w[step == 1]] = False
            if alone.any():
                some = np.flatnonzero(alone)
                w, step, p = np.append(w, some), np.append(step, np.ones(len(some), np.int64)), np.append(p, self.size + codes[some, i - 1])
            score = step == i
            inner = np.flatnonzero(~score)
            if len(inner):
                score[inner] = self._apart(last[i - step[inner], w[inner]], p[inner])
            np.maximum.at(back[i], w, np.where(score, step, 0))
            best = np.flatnonzero(score & (step == back[i, w]))
            last[i, w[best]] = p[best]
            none = np.flatnonzero(back[i] == 0)
            if len(none):
                # No way leads here, so none that goes on from here may be trusted: such words are merged one by one.
                lost[none] = True
                back[i, none], last[i, none] = 1, self.size + codes[none, i - 1]
        out = np.full((n, length), -1, np.int64)
        at, rows = np.full(n, length), np.arange(n)
        for j in range(length - 1, -1, -1):
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            out[live, j] = last[at[live], rows[live]]
            at[live] -= back[at[live], rows[live]]
        for k in np.flatnonzero(lost).tolist():
            states = [self.state[x] if x in self.state else self.size + ord(x) for x in self.merged("".join(map(chr, codes[k].tolist())))]
            out[k] = [-1] * (length - len(states)) + states
        return (out >= 0).sum(1), out[out >= 0]

    def parts(self, word: str) -> list[str]:
        """A word cut between neighbours that no piece holds: merges see pieces alone, so what is left of such a place and what is right of it are encoded by themselves."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.inner, pairs), len(self.inner) - 1)
        cuts = [0, *(np.flatnonzero(self.inner[at] != pairs) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word and all ids; a word is what stands between spaces, with the spaces before it as U+2581. Long ones are encoded part by part."""
        if not any(len(w) > LONG for w in words):
            return self._encode_parts(words)
        cut = [self.parts(w) if len(w) > LONG else [w] for w in words]
        size, ids = self._encode_parts([x for own in cut for x in own])
        first = np.cumsum([0, *map(len, cut)])[:-1]
        return np.add.reduceat(size, first), ids

    def _encode_parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array(list(map(len, words)), np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        size, found = np.zeros(len(words), np.int64), []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            length = int(lengths[order[low]])
            step = max(1, CELLS // (length * 16))
            for a in range(low, high, step):
                some = order[a : min(a + step, high)]
                codes = np.frombuffer("".join([words[k] for k in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), length).astype(np.int64)
                n, states = self._equal_length(codes)
                if (states >= self.size).any():
                    n, states = self._spelled(n, states)
                size[some] = n
                found.append(states)
        ids = np.empty(int(size.sum()), np.int32)
        ids[chunks.ragged((np.cumsum(size) - size)[order], size[order])] = np.concatenate(found)
        return size, ids

    def _spelled(self, n: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        odd = np.flatnonzero(states >= self.size)
        spelled = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in (states[odd] - self.size).tolist()]
        grown = np.ones(len(states), np.int64)
        grown[odd] = list(map(len, spelled))
        out = np.repeat(states, grown)
        out[np.repeat(states >= self.size, grown)] = np.concatenate(spelled).astype(np.int64) + self.byte0
        return np.add.reduceat(grown, np.cumsum(n) - n), out

    def encode_chunks(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for spans of a run of texts that spaced() has made."""
        words = [raw[a:b].tobytes().decode().replace(" ", SPACE) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return self.encode_words(words)

    def decode(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose ids lie between starts and ends, and the number of bytes of each; the space that encoding puts before a text goes."""
        size = self.spell_size[ids]
        size[starts[ends > starts]] -= 1
        skip = np.zeros(len(ids), np.int64)
        skip[starts[ends > starts]] = 1
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        upto = np.append(0, stop)
        return self.spelling[np.arange(total) + np.repeat(self.spell_start[ids] + skip - (stop - size), size)], upto[ends] - upto[starts]


_CODECS: dict[str, tuple[Codec, chunks.ChunkTable]] = {}


def codec(model: str) -> tuple[Codec, chunks.ChunkTable]:
    """The codec of a model, kept while the process lives, and its table of words; both are bounded."""
    if model not in _CODECS:
        own = Codec(model)
        _CODECS[model] = own, chunks.ChunkTable(own.encode_chunks, WORDS)
    return _CODECS[model]


def forget(model: str) -> None:
    """Gives back what a task has remembered of words and pairs: the process may go on with tasks that need the room."""
    own = _CODECS[model][0]
    own.pairs.clear()
    _CODECS[model] = own, chunks.ChunkTable(own.encode_chunks, WORDS)


def spaced(texts: pa.Array) -> pa.Array:
    """Texts in which U+2581 is a space, with the space before them that encoding puts there; null and empty texts are empty."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    return pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(space, texts, empty))


def _coder(model: str, digest: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = codec(model)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").cast(pa.int64()), spaced(batch.column("text"))
            for low, high, raw, begins, stops, ids, ends in chunks.by_document(texts, chunks.word_cuts, table, TOGETHER):
                starts = np.concatenate([[0], ends[:-1]])
                decoded, sizes = own.decode(ids, starts, ends)
                upto = np.cumsum(sizes)
                out = {"doc_id": doc_ids.slice(low, high - low), "n_pieces": pa.array(ends - starts, pa.int64())}
                spans = list(zip((upto - sizes).tolist(), upto.tolist(), strict=True))
                if digest:
                    little = ids.astype("<u4")
                    out["ids_crc32"] = pa.array([zlib.crc32(little[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                    out["decoded_crc32"] = pa.array([zlib.crc32(decoded[a:b].tobytes()) for a, b in spans], pa.int64())
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                    out["decoded"] = pa.array([decoded[a:b].tobytes().decode("utf-8", "replace") for a, b in spans], pa.string())
                out["exact"] = pa.array([np.array_equal(decoded[a:b], raw[c + 1 : d]) for (a, b), c, d in zip(spans, begins.tolist(), stops.tolist(), strict=True)])
                yield pa.RecordBatch.from_pydict(out)
            common.spare()
        forget(model)
        common.spare()

    return code


def encode(docs: DataFrame, model: str = MODEL, digest: bool = False) -> DataFrame:
    """Ids of each document's whole text, the text decoded from them, and whether it is the text: (doc_id, n_pieces, ids, decoded, exact).

    With digest, CRC-32s of the ids (little-endian unsigned 32-bit) and of the decoded text stand in
    place of the ids and the text. Characters without a piece become byte pieces. The character
    U+2581 is how pieces write a space, so it comes back as one, as in the library.

    Null or empty text has no ids and decodes to the empty text. Repeated rows are coded each. An
    empty table gives no rows; a null doc_id stays null. Other columns are ignored.
    """
    common.small_batches(docs.sparkSession)
    kind = "ids_crc32 long, decoded_crc32 long" if digest else "ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_coder(model, digest), f"doc_id long, n_pieces long, {kind}, exact boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the decoded text."""
    return encode(common.table(spark, sf_dir, "documents"), digest=True)
