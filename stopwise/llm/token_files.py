"""Token ids in seekable files.

A file is a run of independent zstandard frames, a skippable frame with the index of its documents,
and a skippable frame with the seek table, laid out as in zstandard's seekable format: compressed
size, decompressed size and checksum (the low half of the XXH64 hash) of every frame, then the
number of frames, a descriptor byte and a magic number at the very end. A reader fetches the tail,
then only the frames of the documents it wants. The index holds doc_id, start and number of ids of
every document, as one zstandard frame of 64-bit integers.
"""

import string
import struct
import sys
import types
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopwise.llm.tables import read, small_batches
from stopwise.workspace import new_path, staged

# Fixed values of zstandard's seekable format, and a skippable frame's magic number for the index.
SEEK_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = "<IBI"
ENTRY = "<III"
HEAD = "<II"
NO_ID = -(1 << 63)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Writer:
    """Writes one file. Ids are kept as 32-bit integers, or 16-bit ones if the vocabulary allows."""

    def __init__(self, out, wide: bool, frame_bytes: int, level: int):
        self.out, self.wide, self.frame_bytes = out, wide, frame_bytes
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.packer = zstandard.ZstdCompressor(level=level)
        self.pending, self.held = [], 0
        self.entries, self.index, self.ids = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((NO_ID if doc_id is None else doc_id, self.ids, len(ids)))
        self.ids += len(ids)
        raw = ids.astype(self.dtype).tobytes()
        self.pending.append(raw)
        self.held += len(raw)
        while self.held >= self.frame_bytes:
            self._flush(self.frame_bytes)

    def _flush(self, size: int) -> None:
        whole = b"".join(self.pending)
        raw, rest = whole[:size], whole[size:]
        self.pending, self.held = [rest], len(rest)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        index = self.packer.compress(np.array(self.index, "<i8").reshape(-1, 3).tobytes())
        body = struct.pack("<B", self.wide) + index
        self.out.write(struct.pack(HEAD, INDEX_MAGIC, len(body)) + body)
        table = b"".join(struct.pack(ENTRY, *e) for e in self.entries)
        table += struct.pack(FOOTER, len(self.entries), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack(HEAD, SEEK_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to one file: reads the tail first, then the frames that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack(FOOTER, self._at(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        length = frames * struct.calcsize(ENTRY) + struct.calcsize(FOOTER)
        at = size - length - struct.calcsize(HEAD)
        if struct.unpack(HEAD, self._at(at, struct.calcsize(HEAD))) != (SEEK_MAGIC, length):
            raise ValueError("broken seek table")
        table = np.frombuffer(self._at(at + struct.calcsize(HEAD), frames * struct.calcsize(ENTRY)), "<u4").reshape(-1, 3)
        self.packed, self.raw, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.packed_at = np.concatenate([[0], np.cumsum(self.packed)])
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw)])
        start = int(self.packed_at[-1])
        magic, length = struct.unpack(HEAD, self._at(start, struct.calcsize(HEAD)))
        if magic != INDEX_MAGIC:
            raise ValueError("no index")
        body = self._at(start + struct.calcsize(HEAD), length)
        self.dtype = np.dtype("<u4" if body[0] else "<u2")
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.unpacker.decompress(body[1:]), "<i8").reshape(-1, 3)
        self.last: tuple[int, bytes] | None = None

    def _at(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if self.last is None or self.last[0] != k:
            raw = self.unpacker.decompress(self._at(int(self.packed_at[k]), int(self.packed[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"checksum of frame {k}")
            self.last = (k, raw)
        return self.last[1]

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on, decompressing only the frames that hold them."""
        width = self.dtype.itemsize
        lo, hi = start * width, (start + count) * width
        if lo == hi:
            return np.empty(0, self.dtype)
        first = int(np.searchsorted(self.raw_at, lo, "right")) - 1
        parts = []
        while self.raw_at[first] < hi:
            parts.append(self.frame(first)[max(0, lo - self.raw_at[first]) : hi - self.raw_at[first]])
            first += 1
            if first == len(self.raw):
                break
        return np.frombuffer(b"".join(parts), self.dtype)


class Encoder:
    """Ids of texts by a tokenizer that never joins what blanks or line breaks separate, splits
    letters and digits from punctuation, and lower-cases.

    The words between blanks are looked up among the known ones. A new word falls into its core and
    the closing punctuation, in lower case; cores not yet known are encoded by the library, joined
    by blanks in one call and parted again by their places. Known words move to an older generation
    when there are over ``words`` of them, and back when they are met again.
    """

    def __init__(self, path: str, words: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words = words

    def encode(self, text: str | None, end: int) -> np.ndarray:
        words = (text or "").replace("\n", " ").split(" ")
        try:
            ids = list(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(set(words))
            ids = list(map(self.known.__getitem__, words))
        ids.append(struct.pack("<I", end))
        return np.frombuffer(b"".join(ids), "<u4")

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > self.words:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = words.difference(known)
        unknown = missing.difference(older)
        known.update((w, older[w]) for w in missing - unknown)
        parts = [(w, *_parts(w)) for w in unknown]
        found = {p for _, *both in parts for p in both}.difference(known)
        unknown = found.difference(older)
        known.update((p, older[p]) for p in found - unknown)
        new = list(unknown)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            places = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
            ends = np.searchsorted(places, np.cumsum([len(p) + 1 for p in part]))
            for p, i, j in zip(part, [0, *ends[:-1].tolist()], ends.tolist()):
                known[p] = ids[i:j].tobytes()
        for w, core, tail in parts:
            known[w] = known[core] + known[tail] if tail else known[core]

    def size(self) -> int:
        return self.tokenizer.get_vocab_size()


def _parts(word: str) -> tuple[str, str]:
    """Core and closing punctuation of a word, in lower case. What may be a special token, and words
    with other signs before the punctuation, stay whole."""
    if "<|" in word:
        return word, ""
    word = word.lower() if word.isascii() else word.translate(LOWER)
    core = word.rstrip(string.punctuation)
    last = core[-1:]
    if not last.isascii():  # may become a letter with a mark
        last = unicodedata.normalize("NFC", last).lower()
    return (core, word[len(core) :]) if last.isalpha() or last.isdecimal() else (word, "")


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker, which Spark uses for one task after the other."""
    store = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    if path not in store.__dict__:
        store.__dict__[path] = Encoder(path)
    return store.__dict__[path]


def open_fs(uri: str):
    """File system and path of a folder that all executors share."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(
    documents: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 1,
    frame_bytes: int = 1 << 20,
    level: int = 3,
) -> DataFrame:
    """Writes the ids of all texts in ascending order of doc_id and returns the list of files:
    path, first_id, first_mark, documents, ids, base (ids in the files before).

    Each text's ids end with ``end_id``; a null text counts as empty; null doc_ids come first;
    repeated rows are written as often as they come; an empty table writes no file. Rows are
    range-partitioned by doc_id and a hash of the text, so that no single doc_id fills a task. Every
    task attempt writes a file of its own name, and only files of attempts that succeeded are in the
    list. Other columns of the input are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("mark"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("mark"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mark")

    def write(batches):
        encoder, writer, first, count = None, None, None, 0
        for batch in batches:
            for doc_id, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    encoder = encoder_of(tokenizer)
                    fs, root = open_fs(folder)
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.ids.zst"
                    writer = Writer(fs.open_output_stream(path, compression=None), encoder.size() > 1 << 16, frame_bytes, level)
                    first = (doc_id, mark)
                writer.add(doc_id, encoder.encode(text, end_id))
                count += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [path],
                    "first_id": pa.array([first[0]], pa.int64()),
                    "first_mark": pa.array([first[1]], pa.int64()),
                    "documents": pa.array([count], pa.int64()),
                    "ids": pa.array([writer.ids], pa.int64()),
                }
            )

    files = ordered.mapInArrow(write, "path string, first_id long, first_mark long, documents long, ids long")
    files = staged(files, "token-files")  # written once: the list names the files that count
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_mark").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, read back from them."""

    def run(batches):
        fs, _ = open_fs(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as source:
                    reader = Reader(source)
                    index = reader.index
                    for at in range(0, len(index), 10_000):
                        part = index[at : at + 10_000]
                        sums = [
                            zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for _, s, n in part.tolist()
                        ]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(part[:, 0], mask=part[:, 0] == NO_ID),
                                "start": pa.array(part[:, 1] + base),
                                "n_tokens": pa.array(part[:, 2].copy()),
                                "ids_crc32": pa.array(sums, pa.int64()),
                            }
                        )

    # a stated number of tasks: by size, adaptive execution would read all files in one
    listed = files.select("path", "base").repartition(max(1, files.count()))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    folder = new_path(spark, "token-ids")
    files = write_token_files(
        read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder
    )
    return read_token_files(files, folder)
