"""Token-ID output in fixed-width bit-packed shards.

Texts are encoded with the tokenizers library one white-space-separated word at a
time: the tokenizer's pre-tokenizer never joins characters across white space, so the
ids of a text are its words' ids in order, and words repeat.  Ids are stored in the
fewest bits that hold the vocabulary.  A shard is::

    b"GLBITS01" | packed blocks of BLOCK ids, each from a whole byte | footer | footer size (8 bytes) | b"GLBITS01"

The footer is an Arrow IPC stream of the rows (doc_id, end: ids up to and with the
document's end id) with the width, the block length and every block's byte offset in
its metadata, so any id range unpacks with numpy from the blocks that hold it.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first;
repeated rows are written each; other columns are ignored; an empty table has no shards.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import slices
from .shared import cut, fresh_dir

MAGIC = b"GLBITS01"
#: Ids in a block.  A multiple of 8, so blocks of any width fill whole bytes.
BLOCK = 4096
#: Words whose ids a task remembers.
REMEMBERED = 250_000
#: Text bytes encoded at once.
ENCODE_BYTES = 4 << 20
#: Ids that the reader unpacks at once.
READ_IDS = 1 << 20


class WordEncoder:
    """Encodes Arrow string columns; one per task.

    Two steps keep the words few and their encoding cheap, and neither changes an id:
    ASCII letters are lower-cased, as the tokenizer does, and a space goes between an
    ASCII letter and the stops after it, where the pre-tokenizer cuts anyway.  Texts in
    which lower-casing first could change an id keep their case: those that hold an added
    token in any case (the tokenizer matches these by case, before it lower-cases), and
    those with a capital and a mark that compose only in lower case.  Words of
    letters only are one piece each, so many are encoded as one text and cut after the
    tokens that end a piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        cuts = str(self.tokenizer.pre_tokenizer).replace("\\\\", "\\")
        if not suffix or "Lowercase" not in str(self.tokenizer.normalizer) or r"[\p{L}]+" not in cuts or r"[^\s\p{L}\p{N}]+" not in cuts:
            raise ValueError("the tokenizer must lower-case, cut letters from other characters, and mark word ends")
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith(suffix)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cased = "|".join([*(f"(?i:{t})" for t in added), r"[HJTWY]\p{M}"])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    def words(self, texts: pa.Array):
        """Each row's words as codes (codes, row offsets), and the ids of each code (ids, offsets)."""
        texts = texts.fill_null("") if texts.null_count else texts
        texts = pc.if_else(pc.match_substring_regex(texts, self.cased), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring_regex(texts, r"([a-z])([.,]+)(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        rows = split.offsets.to_numpy().astype(np.int64)
        codes, ids, at = self._ids(coded.dictionary.to_pylist())
        return codes[coded.indices.to_numpy(zero_copy_only=False)], rows - rows[0], ids, at

    def _ids(self, words: list[str]):
        """The words' codes, and the ids of all codes so far."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        letters = [w for w in new if w.isalpha()]
        for at in range(0, len(letters), 1000):
            part = letters[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and (not len(ids) or stops[-1] == len(ids)):
                self._learn(part, ids, stops)
            else:
                self._learn_each(part)
        self._learn_each([w for w in new if not w.isalpha()])
        if len(self.ids) > 1:
            self.ids, self.at = [np.concatenate(self.ids)], [np.concatenate(self.at)]
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), self.ids[0], self.at[0]

    def _learn(self, words: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        begin = self.at[-1][-1]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids.append(ids)
        self.at.append(begin + stops)

    def _learn_each(self, words: list[str]) -> None:
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._learn(part, np.array([i for ids in each for i in ids], np.uint32), np.cumsum([len(ids) for ids in each]))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Ids in each row, without an end id."""
        codes, rows, _, at = self.words(texts)
        total = np.append(0, np.cumsum((at[1:] - at[:-1])[codes]))
        return total[rows[1:]] - total[rows[:-1]]

    def encode(self, texts: pa.Array, end_id: int):
        """All rows' ids, each row closed by end_id, and the rows' lengths."""
        codes, rows, ids, at = self.words(texts)
        ids, at = np.append(ids, np.uint32(end_id)), np.append(at, at[-1] + 1)
        codes = np.insert(codes, rows[1:], len(at) - 2)
        lens = at[codes + 1] - at[codes]
        total = np.cumsum(lens)
        where = np.repeat(at[codes] - (total - lens), lens) + np.arange(total[-1] if len(total) else 0)
        last = rows[1:] + np.arange(len(rows) - 1)
        row_ends = total[last]
        return ids[where], np.diff(row_ends, prepend=0)


def width_of(vocabulary: int) -> int:
    """Fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in width bits each, most significant bit first, padded with zero bits to a byte."""
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, np.uint32)
    for i in range(width):
        out = (out << np.uint32(1)) | bits[:, i]
    return out


class ShardWriter:
    """Streams ids into a shard; it appears under its name only when complete."""

    def __init__(self, folder: str, shard: int, width: int):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"{self.folder}/shard-{shard:06d}.bits"
        self.draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        self.out, self.width = self.fs.open_output_stream(self.draft), width
        self.out.write(MAGIC)
        self.at, self.starts, self.rest = len(MAGIC), [], np.zeros(0, np.uint32)
        self.docs, self.lens, self.n = [], [], 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.lens.append(lens)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._put(ids[:whole])
        self.rest = ids[whole:]

    def _put(self, ids: np.ndarray) -> None:
        if len(ids):
            data, each = pack(ids, self.width), BLOCK * self.width // 8
            self.starts += range(self.at, self.at + len(data), each)
            self.out.write(data)
            self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        self._put(self.rest)
        ends = np.cumsum(np.concatenate(self.lens)) if self.lens else np.zeros(0, np.int64)
        meta = {"width": str(self.width), "block": str(BLOCK), "starts": np.array([*self.starts, self.at], "<u8").tobytes()}
        table = pa.table({"doc_id": pa.chunked_array(self.docs, pa.int64()), "end": pa.array(ends, pa.int64())}).replace_schema_metadata(meta)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        footer = sink.getvalue()
        self.out.write(footer)
        self.out.write(footer.size.to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.name)
        return self.name, len(ends), self.n


class Shard:
    """Random access to a shard's ids."""

    def __init__(self, folder: str, name: str):
        self.file = pa.fs.FileSystem.from_uri(folder)[0].open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a complete shard")
        n = int.from_bytes(tail[:8], "little")
        self.docs = pa.ipc.open_stream(self.file.read_at(n, size - 16 - n)).read_all()
        meta = self.docs.schema.metadata
        self.width, self.block = int(meta[b"width"]), int(meta[b"block"])
        self.starts = np.frombuffer(meta[b"starts"], "<u8").astype(np.int64)
        self.ends = self.docs["end"].to_numpy()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the shard, read from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        data = self.file.read_at(int(self.starts[last] - self.starts[first]), int(self.starts[first]))
        n = min(last * self.block, int(self.ends[-1])) - first * self.block
        return unpack(data, n, self.width)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def digests(self) -> Iterator[tuple[int, int, int, int]]:
        """(first id, ids, crc32, row) of each document, unpacking READ_IDS ids at a time."""
        begin, i, n = 0, 0, len(self.ends)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, begin + READ_IDS, "right")))
            stop = int(self.ends[j - 1])
            if j == i + 1:
                crc = 0
                for a in range(begin, stop, READ_IDS):
                    crc = zlib.crc32(self.ids(a, min(stop, a + READ_IDS)).astype("<u4").tobytes(), crc)
                yield begin, stop - begin, crc, i
            else:
                data, a = memoryview(self.ids(begin, stop).astype("<u4").tobytes()), begin
                for k in range(i, j):
                    b = int(self.ends[k])
                    yield a, b - a, zlib.crc32(data[4 * (a - begin) : 4 * (b - begin)]), k
                    a = b
            begin, i = stop, j


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs as shards in ascending doc_id order; rows (shard, name, n_docs, n_ids)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = shard = None
        for batch in batches:
            for part in slices(batch, most=ENCODE_BYTES):
                if encoder is None:
                    encoder, at = WordEncoder(tokenizer), TaskContext.get().partitionId()
                    shard = ShardWriter(folder, at, width_of(max(encoder.size, end_id + 1)))
                shard.add(part.column("doc_id"), *encoder.encode(part.column("text"), end_id))
        if shard:
            name, n, ids = shard.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "name": [name], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([ids], pa.int64())})

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by text too, so that rows of one id, or of none, are not all of one shard
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    docs = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(docs.mapInArrow(write, "shard int, name string, n_docs long, n_ids long"))


def read_digests(shards: DataFrame, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from shards; start counts the ids of all documents before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                shard = Shard(folder, name)
                rows = np.array(list(shard.digests()), np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([shard.docs["doc_id"].combine_chunks(), *(pa.array(x) for x in (rows[:, 0] + first, rows[:, 1], rows[:, 2]))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    listed = shards.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = listed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.select("name", "first").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    folder = fresh_dir(docs.sparkSession, "tokens")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return read_digests(write_shards(docs, folder, tokenizer, end_id), folder)
