"""Token ids in a binary format of compressed bit or byte planes.

One file per range of document ids, in ascending order:

    magic | chunk 0 | chunk 1 | ... | documents | index | length of index (8) | magic

A chunk holds up to ``chunk_ids`` ids, transposed into planes (one per bit or
byte that any of its ids needs), each compressed with zstandard.  ``documents``
holds ids and lengths of the documents.  The index (JSON) lists for each chunk its
place, its number of ids and the length of every plane, so a reader can fetch
any range of ids, or only some planes, without the rest.

A task writes a file under a name of its own and returns one manifest row; the
manifest, written by Spark, is what commits the files, so a task that was lost
or ran twice leaves at most an unlisted file behind.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from episodica.llm.common import require
from episodica.plans.small import keep
from episodica.session import scratch_path

MAGIC = b"IDPLANE1"

#: ids in a chunk
CHUNK_IDS = 1 << 16

#: text bytes that go to one file
FILE_BYTES = 64 << 20

#: words of which an encoder remembers the ids, and the longest it remembers
CACHED_WORDS = 500_000
COMMON_WORDS = 60_000
CACHED_CHARS = 40

#: new words that go through the tokenizer at once
TOGETHER = 10_000


# ---------------------------------------------------------------- chunks
def encode_planes(ids: np.ndarray, plane: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of uint32 ids, lowest first; no plane above the highest bit in use."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    z = zstandard.ZstdCompressor(level=level)
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if plane == "bit":
        return [z.compress(np.packbits(((ids >> np.uint32(b)) & 1).astype(np.uint8)).tobytes()) for b in range(bits)]
    if plane == "byte":
        by = ids.view(np.uint8).reshape(-1, 4)
        return [z.compress(np.ascontiguousarray(by[:, b]).tobytes()) for b in range(-(-bits // 8))]
    raise ValueError(f"plane must be 'bit' or 'byte', not {plane!r}")


def decode_planes(planes: list[bytes], n: int, plane: str = "byte") -> np.ndarray:
    out = np.zeros(n, dtype="<u4")
    z = zstandard.ZstdDecompressor()
    for b, data in enumerate(planes):
        raw = np.frombuffer(z.decompress(data), dtype=np.uint8)
        if plane == "bit":
            out |= np.unpackbits(raw, count=n).astype("<u4") << np.uint32(b)
        else:
            out |= raw.astype("<u4") << np.uint32(8 * b)
    return out


# ---------------------------------------------------------------- files
def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class PlaneWriter:
    """Writes one file; ``add`` takes documents in order, with their ids in one array."""

    def __init__(self, uri: str, plane: str, chunk_ids: int, level: int):
        fs, path = _filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.at = fs.open_output_stream(path), 0
        self.plane, self.chunk_ids, self.level = plane, chunk_ids, level
        self.chunks: list[list] = []
        self.parts: list[np.ndarray] = []
        self.held, self.total = 0, 0
        self.docs, self.lengths = [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs += doc_ids
        self.lengths += lengths.tolist()
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.chunk_ids:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, dtype="<u4")
        at = 0
        while len(ids) - at >= self.chunk_ids or (last and at < len(ids)):
            part = ids[at : at + self.chunk_ids]
            planes = encode_planes(part, self.plane, self.level)
            self.chunks.append([self.at, len(part), [len(p) for p in planes]])
            for p in planes:
                self._put(p)
            at += len(part)
        self.parts, self.held = [ids[at:]], len(ids) - at

    def close(self) -> None:
        self._flush(last=True)
        null = np.array([d is None for d in self.docs], dtype=np.uint8)
        cols = (np.array([d or 0 for d in self.docs], dtype="<i8"), np.array(self.lengths, dtype="<i8"), null)
        docs = zstandard.ZstdCompressor(level=self.level).compress(b"".join(c.tobytes() for c in cols))
        at = self.at
        self._put(docs)
        index = json.dumps(
            {"plane": self.plane, "chunks": self.chunks, "docs": [at, len(docs), len(self.docs)], "ids": self.total}
        ).encode()
        self._put(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Random access to one file; holds a chunk at a time."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a complete plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(self.file.read_at(n, size - 16 - n))
        at, length, docs = self.index["docs"]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, at)) if docs else b""
        self.doc_ids, self.lengths = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<i8", docs, 8 * docs)
        self.null = np.frombuffer(raw, np.uint8, docs, 16 * docs)
        self.starts = np.concatenate([[0], np.cumsum([c[1] for c in self.index["chunks"]])]).astype(np.int64)

    def chunk(self, i: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][i]
        data, planes, p = self.file.read_at(sum(sizes), at), [], 0
        for s in sizes:
            planes.append(data[p : p + s])
            p += s
        return decode_planes(planes, n, self.index["plane"])

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(document id, its ids in pieces), in file order."""
        i, held, at = -1, np.zeros(0, dtype="<u4"), 0
        for d, n, null in zip(self.doc_ids.tolist(), self.lengths.tolist(), self.null.tolist()):
            pieces = []
            while n:
                if at == len(held):
                    i, at = i + 1, 0
                    held = self.chunk(i)
                take = held[at : at + n]
                pieces.append(take)
                at += len(take)
                n -= len(take)
            yield (None if null else d), pieces

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the chunks that hold them."""
        first, last = np.searchsorted(self.starts, [start, stop - 1], side="right") - 1
        part = np.concatenate([self.chunk(i) for i in range(first, last + 1)]) if stop > start else np.zeros(0, "<u4")
        return part[start - self.starts[first] :][: stop - start]


# ---------------------------------------------------------------- tokens
_TOKENIZERS: dict[str, object] = {}

#: text bytes that are split into words at once
SLICE_BYTES = 16 << 20


#: ASCII letters and those of Latin-1: each stays one letter under NFC and in lower case
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: marks that may be taken off the end of a word; not the apostrophe, which may open a suffix
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: what the symbols that end a piece of a word have at their end
WORD_END = "</w>"


def _cores(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
    """Words of LETTERS in lower case and without the MARKS that may end them, other words as they are;
    whether a word is of the first kind; each word's place among the ends that were cut, or -1; these ends.

    The tokenizer cuts between letters and marks and lower-cases letters anyway,
    so fewer different words are left.
    """
    import pyarrow.compute as pc

    core = pc.ascii_rtrim(words, MARKS)
    plain = pc.match_substring_regex(core, f"^[{LETTERS}]+$")
    cut = pc.and_(plain, pc.less(pc.binary_length(core), pc.binary_length(words)))
    marked = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
    ends = pc.replace_substring_regex(words.take(pa.array(marked)), f"^[{LETTERS}]+", "").dictionary_encode()
    end = np.full(len(words), -1, dtype=np.int32)
    end[marked] = ends.indices.to_numpy(zero_copy_only=False)
    return pc.if_else(plain, pc.utf8_lower(core), words), plain.to_numpy(zero_copy_only=False), end, ends.dictionary.to_pylist()


def word_encoder(tokenizer_file: str, cached_words: int = CACHED_WORDS):
    """Arrow string array -> (uint32 ids of all texts, number of ids of each text).

    For tokenizers that split at white space and drop it, so that a text's ids
    are the ids of its words: words are cut at ASCII white space and made a
    dictionary by Arrow; only words that are new to the encoder, which remembers
    ``cached_words`` of them, go through the tokenizer.  Words of letters are one piece
    each; they go through it as one text, whose ids are cut behind those of word ends
    (if the vocabulary marks them and as many are found, else word by word).  All but the COMMON_WORDS met
    first by the worker go with the encoder (a task's), so later stages have the memory.
    """
    import os

    import pyarrow as pa
    import pyarrow.compute as pc

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if tokenizer_file not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file)
        last = np.zeros(tok.get_vocab_size(), dtype=bool)
        last[[i for w, i in tok.get_vocab().items() if w.endswith(WORD_END)]] = True
        _TOKENIZERS[tokenizer_file] = (tok, {"": b""}, last)
    tok, common, last = _TOKENIZERS[tokenizer_file]
    known = dict(common)
    code = "H" if tok.get_vocab_size() <= 1 << 16 else "I"
    dtype = np.dtype("<u2" if code == "H" else "<u4")

    def one_by_one(words: list[str]) -> list[bytes]:
        return [array(code, e.ids).tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]

    def as_text(words: list[str]) -> list[bytes]:
        ids = np.array(tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=dtype)
        ends = (np.flatnonzero(last[ids]) + 1) * dtype.itemsize
        if len(ends) != len(words) or ends[-1] != ids.nbytes:
            return one_by_one(words)
        flat, ends = ids.tobytes(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def look(words: list[str], plain: np.ndarray) -> list[bytes]:
        parts = list(map(known.get, words))
        missed = np.array([i for i, p in enumerate(parts) if p is None], dtype=np.int64)
        kind = plain[missed]
        for convert, which in ((as_text, missed[kind].tolist()), (one_by_one, missed[~kind].tolist())):
            for k in range(0, len(which), TOGETHER):
                at = which[k : k + TOGETHER]
                new = [words[i] for i in at]
                for i, w, ids in zip(at, new, convert(new)):
                    parts[i] = ids
                    if len(known) < cached_words and len(w) <= CACHED_CHARS:
                        known[w] = ids
                        if len(common) < COMMON_WORDS:
                            common[w] = ids
        return parts

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        core, plain, end, ends = _cores(coded.dictionary)
        cores = core.dictionary_encode()
        which = cores.indices.to_numpy(zero_copy_only=False)
        kinds = np.zeros(len(cores.dictionary), dtype=bool)
        kinds[which] = plain
        ids = look(cores.dictionary.to_pylist(), kinds)
        parts = list(map(ids.__getitem__, which.tolist()))
        marked, ends = np.flatnonzero(end >= 0), look(ends, np.zeros(len(ends), dtype=bool))
        for i, m in zip(marked.tolist(), end[marked].tolist()):
            parts[i] += ends[m]
        size = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts)) // dtype.itemsize
        at = np.cumsum(size, dtype=np.int64) - size
        flat = np.frombuffer(b"".join(parts), dtype=dtype)
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        ends = np.cumsum(n, dtype=np.int64)
        # ids fit 32 bits of places: a slice, or a single text, is below 2 GB
        where = np.repeat((at[which] - ends + n).astype(np.int32), n)
        where += np.arange(len(where), dtype=np.int32)
        upto = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return flat[where], np.diff(upto)

    return encode


def _slices(batch):
    """Parts of an Arrow batch with at most SLICE_BYTES of text each, or one row."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


# ---------------------------------------------------------------- Spark
def word_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    plane: str = "byte",
    chunk_ids: int = CHUNK_IDS,
    file_bytes: int = FILE_BYTES,
    level: int = 3,
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files below ``path``.

    Returns the manifest (kept on disk): file_no, file, n_docs, n_ids and the
    number of ids before the file.  Null texts count as empty; null ids come
    first; rows with equal ids keep one order by text; extra columns are not
    read; no rows give an empty manifest.
    """
    require(docs, id_col, text_col)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes), min(8, total >> 20))
    root = path.rstrip("/")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, out, name = word_encoder(tokenizer_file, cached_words), None, f"{root}/ids-{uuid.uuid4().hex}.planes"
        rows = 0
        for batch in batches:
            for part in _slices(batch):
                ids, n = encode(part.column("text"))
                # the end id goes behind the last id of each document
                ids = np.insert(ids.astype("<u4"), np.cumsum(n), end_id)
                out = out or PlaneWriter(name, plane, chunk_ids, level)
                out.add(part.column("id").to_pylist(), ids, n + 1)
                rows += len(n)
        if out is not None:
            out.close()
            cols = {"file_no": [_partition()], "file": [name], "n_docs": [rows], "n_ids": [out.total]}
            yield pa.RecordBatch.from_pydict(cols, pa.schema([("file_no", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ranged = d.repartitionByRange(files, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    done = keep(ranged.mapInArrow(write, "file_no int, file string, n_docs long, n_ids long"), "id-manifest")
    before = F.sum("n_ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))
    # one row per file, not per document
    return done.select("file_no", "file", "n_docs", "n_ids", F.coalesce(before, F.lit(0)).alias("start"))


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read_ids(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start, n_tokens and crc32 of the ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                rows, at = [], int(start)
                for doc, pieces in PlaneReader(file).documents():
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    n = sum(map(len, pieces))
                    rows.append((doc, at, n, crc))
                    at += n
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    out = manifest.select("file", "start").repartition(n).mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def token_table(spark: SparkSession, docs: DataFrame, tokenizer_file: str, end_id: int = 1, **kw) -> DataFrame:
    """Write the ids of ``docs`` to a new folder in the shared place and read them back."""
    return read_ids(write_ids(docs, scratch_path(spark, "ids"), tokenizer_file, end_id, **kw))
