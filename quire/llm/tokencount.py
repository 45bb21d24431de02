"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree.

Usual texts go to the library whole. A longer one is cut into chunks that overlap their neighbours by `overlap` code points to both sides
of each cut, and each chunk is encoded with offsets wherever Spark deals it, so that the library, whose time per character grows with the
text, never sees more than a chunk. At a cut, the encodings of both chunks are spliced at a place where both have a boundary that is proven stable:

* no piece of the vocabulary holds the two characters around the place next to each other, so nothing is ever merged across it; or
* the last piece before it and the first after it, encoded together, give these two pieces again. Merging is greedy by score, then from the
  left. Up to the first merge across a boundary the pieces at its sides see the merges they would see alone, so such a merge would
  also happen in the two alone. A row of pieces whose neighbours all pass this test is therefore the encoding of its text; neighbours
  within one encoding pass it, so the test at each splice is enough.

Where the overlap has no such place, the text is cut again with chunks and overlaps four times as wide, up to a single chunk. Counts are
those of the whole text in every case, whatever the sizes.

Huge texts are known by their SHA-256, so copies are encoded once. Chunks, ends and counts are tables in the shared folder.

Defined cases: a null or empty text has no tokens and no bytes; repeated rows and ids count as rows of their own; special strings in a
text are text; an empty table gives no rows; columns that are kept are nested while the job runs, so that no name clashes, and a kept
column of an output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy

LIMIT = 4096
CHUNK = 1 << 14
OVERLAP = 128
WIDER = 4
#: texts of more code points are cut
HUGE = 2 * CHUNK
BATCH_CHARS = 1 << 20
SPACE = "▁"
END = "key binary, seam long, head boolean, at array<int>, before array<int>, other array<int>, proven array<boolean>, around string"

_codecs: dict = {}


class Codec:
    """A sentencepiece model: counts, offsets and the proof that a place is a boundary."""

    def __init__(self, path: str):
        import sentencepiece
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.whole
        usual = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.inside = {pair for piece in usual for pair in zip(piece, piece[1:], strict=False)}
        held = set("".join(usual))
        self.foreign = next(c for c in map(chr, range(1, 0xD800)) if c not in held)  # nothing merges with it

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.whole.encode(texts, return_type="numpy", num_threads=1)]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.whole.encode(text, return_type="offset_mapping")["offsets"]

    def apart(self, left: str, right: str) -> bool:
        """Whether no piece holds these two characters next to each other."""
        return (left.replace(" ", SPACE), right.replace(" ", SPACE)) not in self.inside

    def stays(self, left: str, right: str) -> bool:
        """Whether the texts of two pieces, encoded together and not as the start of a text, are these pieces again."""
        middle = 1 + len(left)
        return [x for x in self.offsets(self.foreign + left + right) if x[0]] == [(1, middle), (middle, middle + len(right))]


def codec(path: str) -> Codec:
    """One a worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def ends_of(code: Codec, text: str, cuts: list[tuple[int, bool]], overlap: int) -> tuple[int, list[tuple]]:
    """The token count of a chunk, and for each of its cuts (place in the chunk, whether the chunk goes on behind it) the boundaries within
    the overlap: place from the cut, tokens before it, the far end of the piece that this chunk brings to it, and whether it is proven."""
    pieces = code.offsets(text)
    starts: dict[int, int] = {}
    for k, (a, _) in enumerate(pieces):
        starts.setdefault(a, k)
    out = []
    for cut, head in cuts:
        at, before, other, proven = [], [], [], []
        for p in range(max(cut - overlap, 0) + 1, min(cut + overlap, len(text))):
            k = starts.get(p)
            if k is None:
                continue
            far = pieces[k][1] if head else pieces[k - 1][0]
            if far == p or (not head and far == 0):
                continue  # a character written as bytes, or a piece that may hold the mark before the first word
            at.append(p - cut)
            before.append(k)
            other.append(far - cut)
            proven.append(code.apart(text[p - 1], text[p]))
        out.append((at, before, other, proven, text[max(cut - overlap, 0):cut + overlap]))
    return len(pieces), out


def splice(code: Codec, tail: dict, head: dict) -> tuple[int, int] | None:
    """Tokens before the splice in the chunk that ends and in the one that starts; None if no common boundary is proven."""
    starts = {p: k for k, p in enumerate(head["at"])}
    common = [(j, starts[p]) for j, p in enumerate(tail["at"]) if p in starts]
    common.sort(key=lambda x: (not tail["proven"][x[0]], abs(tail["at"][x[0]])))
    middle = len(tail["around"]) // 2
    for j, k in common:
        a, p, b = middle + tail["other"][j], middle + tail["at"][j], middle + head["other"][k]
        if tail["proven"][j] or (a >= 0 and b <= len(tail["around"]) and code.stays(tail["around"][a:p], tail["around"][p:b])):
            return tail["before"][j], head["before"][k]
    return None


def pieces_of(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """texts(key, text) -> a row a chunk: key, part, last, text."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                many = -(-len(text) // chunk)
                for first in range(0, many, 64):
                    parts = range(first, min(first + 64, many))
                    rows = [text[max(p * chunk - overlap, 0):(p + 1) * chunk + overlap] for p in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.binary()), pa.array(list(parts), pa.int64()),
                                                      pa.array([p == many - 1 for p in parts]), pa.array(rows, pa.string())],
                                                     names=["key", "part", "last", "text"])

    cut = texts.select("key", "text").mapInArrow(run, "key binary, part long, last boolean, text string")
    # copies meet here, and the chunks of one text are dealt over the tasks
    return cut.groupBy("key", "part").agg(F.first("last").alias("last"), F.first("text").alias("text"))


def chunk_ends(chunks: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """Each chunk's ends at the cuts it shares with its neighbours; the last chunk's token count as a row of seam -1."""
    names = [c.split()[0] for c in END.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()), pa.string()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                key, part, last, text = (b.column(j)[i].as_py() for j in range(4))
                begin = min(part, 1) * overlap
                cuts = ([(begin, True)] if part else []) + ([] if last else [(begin + chunk, False)])
                total, ends = ends_of(code, text, cuts, overlap)
                if last:
                    rows.append((key, -1, None, [], [total], [], [], ""))
                rows += [(key, part + (not head), head, *end) for (_, head), end in zip(cuts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    return chunks.select("key", "part", "last", "text").mapInArrow(run, END)


def seam_counts(ends: DataFrame, model: str) -> DataFrame:
    """key, tokens: at each cut the tokens before the splice in the chunk that ends, less those in the chunk that starts; null where
    no boundary is proven. With the last chunk's count these add up to the text's."""
    sides = F.struct("at", "before", "other", "proven", "around")
    tails = ends.where("seam >= 0 and not head").select("key", "seam", sides.alias("tail"))
    heads = ends.where("seam >= 0 and head").select("key", "seam", sides.alias("head"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for b in batches:
            got = [splice(code, tail, head) for tail, head in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g and g[0] - g[1] for g in got], pa.int64())], names=["key", "tokens"])

    return tails.join(heads, ["key", "seam"]).select("key", "tail", "head").mapInArrow(run, "key binary, tokens long")


def count_huge(texts: DataFrame, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """texts(key, text) -> key, n_tokens: a row for each different text. Keys whose overlaps hold no proven boundary go on, wider."""
    done, widest = [], texts
    while True:
        ends = stored(chunk_ends(pieces_of(widest, chunk, overlap), model, chunk, overlap), "token-ends")
        last = ends.where("seam = -1").select("key", F.col("before")[0].cast("long").alias("tokens"))
        sums = last.unionByName(seam_counts(ends, model)).groupBy("key").agg(
            F.sum("tokens").alias("n_tokens"), F.max(F.col("tokens").isNull()).alias("failed"))
        sums = stored(sums, "token-sums")
        done.append(sums.where(~F.col("failed")).select("key", "n_tokens"))
        failed = sums.where("failed").select("key")
        if failed.isEmpty():
            break
        widest, chunk, overlap = texts.join(failed, "key", "left_semi"), WIDER * chunk, WIDER * overlap
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def count(docs: DataFrame, model: str, keep: list[str] | None = None, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK,
          overlap: int = OVERLAP) -> DataFrame:
    """docs(text, ...) -> the columns to keep (doc_id), n_bytes, n_tokens, over_limit (n_tokens > limit). model: path of a sentencepiece
    model that every executor has; huge: texts of more code points are cut; chunk, overlap: in code points, 2 * overlap < chunk."""
    made = ["n_bytes", "n_tokens", "over_limit"]
    stay = [c for c in (["doc_id"] if keep is None else keep) if c not in made]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in stay]).alias("row"), text.alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for b in batches:
            texts = b.column(1)
            ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)) // BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]
            counts = [n for first, end in zip(cuts, cuts[1:], strict=False) for n in code.counts(texts.slice(first, end - first).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())],
                                             names=["row", "n_bytes", "n_tokens"])

    kind = rows.schema["row"].dataType.simpleString()
    long = F.length("text") > huge
    usual = rows.select("row", "text").where(~long).mapInArrow(run, f"row {kind}, n_bytes long, n_tokens long")
    cut = rows.where(long).select("row", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    known = count_huge(cut.select("key", "text"), model, chunk, overlap)
    out = usual.unionByName(cut.drop("text").join(known, "key").select("row", "n_bytes", "n_tokens"))
    return out.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
