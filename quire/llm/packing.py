"""Packing by minimum bin slack: a window is filled by the multiset of remaining piece lengths that comes closest to its capacity.

Each task packs the documents it reads, so nothing is shuffled and a lost task gives the same rows again. Documents are cut into
full windows and one rest; rests wait in a pool of bounded size. For a window the reachable sums of the pool's lengths are kept as
bits of one integer, a layer per length; walking the layers back gives how many pieces of each length fill it. A slack that no
multiset closes is closed by cutting a piece. Only the end of a task has less than a window left: it is written as windows of
powers of two, which need no padding.

Defined cases: a null or empty text holds the end id alone; repeated rows and repeated or null doc_ids are documents of their own;
very long texts are cut like others; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tidy

CAPACITY = 4096
END_ID = 2
POOL_WINDOWS = 64
WORDS_KEPT = 100_000
WORDS_AT_ONCE = 1 << 14
SLICE_BYTES = 1 << 22
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
#: characters that some take for blanks and the tokenizer doesn't
SEPARATORS = "[\\x1c-\\x1f]"
#: a letter and ASCII punctuation (no apostrophe) at a word's end: the tokenizer starts a new piece between them, so a blank changes nothing
TAIL = "(\\pL)([!-&(-/:-@\\[-`{-~]+)(\\s|$)"

_encoders: dict = {}


class Encoder:
    """Token ids of texts by a kept table of words between blanks: the tokenizer never joins over a blank. A word of letters is one
    piece of its pattern, and each piece's last token carries the end mark, so many such words can be encoded as one text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.folded = Tokenizer.from_file(path)  # for words that are in normal form already
        self.folded.encode_special_tokens, self.folded.normalizer = True, None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        encoded = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def letters(self, words: list[str]) -> list[bytes]:
        lines = [" ".join(words[i:i + 256]) for i in range(0, len(words), 256)]
        flat = np.frombuffer(b"".join(self.ids(lines, self.folded)), dtype="<u4")
        data, cuts = flat.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that are not known."""
        plain, other = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        got = dict(zip(other, self.ids(other), strict=True))
        for i in range(0, len(plain), WORDS_AT_ONCE):
            part = plain[i:i + WORDS_AT_ONCE]
            got.update(zip(part, self.letters(part), strict=True))
        return got

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Words not seen for WORDS_KEPT others are forgotten, so usual ones stay."""
        parts = list(map(self.known.get, words))
        new = [w for w, p in zip(words, parts, strict=True) if p is None]
        got = dict(zip(new, map(self.older.get, new), strict=True))
        got.update(self.learn([w for w, p in got.items() if p is None]))
        self.known.update(got)
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {"": b""}, self.known
        return [got[w] if p is None else p for w, p in zip(words, parts, strict=True)]

    def encode(self, column: pa.StringArray) -> list[bytes]:
        """The ids of each text; null as the empty text."""
        texts = column.to_pylist()
        odd = {i for i, t in enumerate(texts) if t and not t.isascii() and ("\u0130" in t or not unicodedata.is_normalized("NFC", t))}
        odd.update(np.flatnonzero(pc.match_substring_regex(column.fill_null(""), SEPARATORS).to_numpy(zero_copy_only=False)).tolist())
        plain = pa.array(["" if i in odd or t is None else t for i, t in enumerate(texts)], pa.large_string())
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), TAIL, "\\1 \\2\\3"))
        coded = words.flatten().dictionary_encode()
        names, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        parts = self.look_up(names)
        size = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        flat, first, sizes = np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum(size) - size, size[index]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = flat[np.arange(ends[-1]) + np.repeat(first[index] - ends[:-1], sizes)].tobytes()
        cuts = (4 * ends[words.offsets.to_numpy()]).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in odd:
            out[i] = self.ids([texts[i]])[0]
        return out


def encoder(path: str) -> Encoder:
    """One a worker process: reading the vocabulary takes longer than many batches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill a window closest to its capacity. The longest piece is always among them."""
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    mask, reach, layers = (1 << (capacity + 1)) - 1, 1 << first, []
    for length in lengths:
        left = min(counts[length] - (length == first), (capacity - first) // length)
        layers.append((length, reach, left))
        step = 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen = {first: 1}
    for length, before, left in reversed(layers):
        used = next(k for k in range(left + 1) if before >> (total - k * length) & 1 and total >= k * length)
        total -= used * length
        if used:
            chosen[length] = chosen.get(length, 0) + used
    return chosen


class Packer:
    """The pool of one task. Pieces are (row, start, ids); out gets (piece, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, list[tuple]] = {}
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, row: tuple, ids: bytes) -> None:
        n, full = len(ids) // 4, 4 * self.capacity
        for at in range(0, n - self.capacity + 1, self.capacity):
            self.write([(row, at, ids[4 * at:4 * at + full])])
        rest = n - n % self.capacity
        if rest < n:
            self.put((row, rest, ids[4 * rest:]))

    def put(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]) // 4, []).append(piece)
        self.tokens += len(piece[2]) // 4

    def take(self, length: int) -> tuple:
        same = self.pool[length]
        piece = same.pop()
        if not same:
            del self.pool[length]
        self.tokens -= length
        return piece

    def write(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.out.append((p, self.sequence, at))
            at += len(p[2]) // 4
        self.sequence += 1

    def close(self, low: int) -> None:
        """Fills windows while the pool holds more than `low` windows."""
        while self.tokens >= max(low, 1) * self.capacity:
            chosen = fill({n: len(p) for n, p in self.pool.items()}, self.capacity)
            pieces = [self.take(n) for n, k in chosen.items() for _ in range(k)]
            slack = self.capacity - sum(len(p[2]) // 4 for p in pieces)
            while slack:
                pieces.append(self.cut(min(slack, max(self.pool))))
                slack -= len(pieces[-1][2]) // 4
            self.write(pieces)

    def cut(self, n: int) -> tuple:
        """The first n ids of a piece that has as many."""
        row, start, ids = self.take(max(self.pool))
        if len(ids) > 4 * n:
            self.put((row, start + n, ids[4 * n:]))
        return row, start, ids[:4 * n]

    def finish(self) -> None:
        self.close(0)
        while self.tokens:
            left, pieces = 1 << (self.tokens.bit_length() - 1), []
            while left:
                pieces.append(self.cut(min(left, max(self.pool))))
                left -= len(pieces[-1][2]) // 4
            self.write(pieces)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ids=True
    also the token ids. tokenizer: path of a vocabulary file that every executor has."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def rows(packer: Packer) -> pa.RecordBatch:
        got, packer.out = packer.out, []
        data = [[p[0][0] for p, _, _ in got], [p[1] for p, _, _ in got], [len(p[2]) // 4 for p, _, _ in got],
                [zlib.crc32(p[2]) for p, _, _ in got], [p[0][1] for p, _, _ in got], [s for _, s, _ in got], [o for _, _, o in got]]
        arrays = [pa.array(d, pa.int64()) for d in data]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if ids:
            arrays.append(pa.array([np.frombuffer(p[2], dtype="<u4").astype(np.int32) for p, _, _ in got], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 32)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) if b.num_rows else []
            at = 0
            while at < b.num_rows:
                end, held = at + 1, sizes[at]
                while end < b.num_rows and held + sizes[end] <= SLICE_BYTES:
                    held += sizes[end]
                    end += 1
                for key, got in zip(keys[at:end], enc.encode(texts.slice(at, end - at)), strict=True):
                    packer.add((key, len(got) // 4 + 1), got + tail)
                    if packer.tokens > 2 * POOL_WINDOWS * capacity:
                        packer.close(POOL_WINDOWS)
                if packer.out:
                    yield rows(packer)
                at = end
        packer.finish()
        if packer.out:
            yield rows(packer)

    # one task's documents stay together and in their order, so that a repeated task packs alike
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))
