"""Token ids as flat binary shards with 64-bit offsets, read by memory map.

A dataset is a folder of pairs ``NNNNN.bin`` (token ids end to end, unsigned
little-endian integers) and ``NNNNN.idx`` (for n documents: n 64-bit ids, n
bytes that are 1 for a null id, n + 1 64-bit token offsets within the shard).
``manifest`` is a Parquet table with a row per shard: its documents, its
tokens, and its base, the number of tokens in all shards before it.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ondula.llm.common import Numbered, Ragged, bounded_batches, is_latin, shared_folder, stored, text_slices

# Distinct chunks that a Python worker remembers; beyond it starts anew.
CACHE_CHUNKS = 200_000
CACHE_CHARS = 4_000_000
READ_DOCS = 4096  # documents that a reading task takes at a time


# A tokenizer file with these steps can be applied chunk by chunk.
NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_blanks(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space, and gives runs of
    letters to a byte-level model, so that its file fits :class:`ChunkEncoder`."""
    said = json.loads(tokenizer.to_str())
    first, *rest = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (said.get("normalizer") or {}).get("normalizers") == NORMALIZER
        and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": SPLIT}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and [r.get("type") for r in rest] == ["ByteLevel"]
        and not rest[0].get("add_prefix_space")
        and said["model"]["type"] == "BPE"
    )


_MARK = r"([a-z])([.,])([ \n])"
# Texts that are cut as they stand: a character above U+00FF, or what may be a special token.
_AS_IS = r"[^\x{0}-\x{FF}]|<\|"


def chunks(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What texts hold between blanks and newlines, end to end, each different
    chunk once; and where every text's chunks begin and end.

    The tokenizer lower-cases anyway; before the cut there are fewer chunks
    (special tokens are looked for before that, so texts that may hold one
    stay), and a mark between a letter and white space is a piece of its own.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), _MARK, r"\1 \2\3")
    as_is = pc.match_substring_regex(texts, _AS_IS)
    cut = pc.split_pattern(pc.replace_substring(pc.if_else(as_is, texts, plain), "\n", " "), " ")
    return cut.flatten().dictionary_encode(), np.asarray(cut.offsets, dtype=np.int64)


class ChunkEncoder:
    """Encodes texts by the tokenizer through a table of their chunks.

    The tokenizer drops white space and never joins across it, so a text may
    be cut at blanks and newlines. A chunk of plain letters with at most one
    mark behind them goes to the model directly, lower-cased and in the
    model's byte alphabet; all others go through the whole tokenizer. A
    tokenizer file with other steps gets whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_chunks = cuts_at_blanks(self.tokenizer)
        self.marks = {m: [t.id for t in self.model.tokenize(m)] for m in ".,"}
        self.forget()

    def forget(self) -> None:
        self.fresh: list[tuple[str, str]] = []
        self.known = Numbered("", self.fresh, [0])
        self.held = 0
        self.ids = Ragged()

    def _learn(self) -> None:
        """Encode the chunks that have been numbered since the last time."""
        tokenize, marks = self.model.tokenize, self.marks
        ids: list = []
        rest: list[tuple[int, str]] = []
        for _, c in self.fresh:
            if c.isalpha():
                core, mark = c, None
            else:
                core, mark = c[:-1], marks.get(c[-1:])
                if mark is None or not core.isalpha():
                    rest.append((len(ids), c))
                    ids.append(())
                    continue
            if core.isascii():
                found = [t.id for t in tokenize(core.lower())]
            elif is_latin(core):
                found = [t.id for t in tokenize(_in_bytes(core.lower()))]
            else:
                rest.append((len(ids), c))
                ids.append(())
                continue
            ids.append(found if mark is None else found + mark)
        self.held += sum(len(c) for _, c in self.fresh)
        self.fresh.clear()
        done = self.tokenizer.encode_batch([c for _, c in rest], add_special_tokens=False)
        for (n, _), e in zip(rest, done):
            ids[n] = e.ids
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens)

    def encode(self, texts: list[str] | pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, ``end`` behind each text; ids of each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if not self.by_chunks:
            done = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            ids = [e.ids for e in done]
            lens = np.array([len(x) + 1 for x in ids], dtype=np.int64)
            flat = chain.from_iterable(chain(x, (end,)) for x in ids)
            return np.fromiter(flat, np.uint32, int(lens.sum())), lens
        if len(self.ids.lens) > CACHE_CHUNKS or self.held > CACHE_CHARS:
            self.forget()
        # a text may grow by the blanks before its marks
        found, starts = chunks(texts.cast(pa.large_string()))
        names = found.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        if self.fresh:
            self._learn()
        ids, lens = self.ids.take(numbers[np.asarray(found.indices)])
        edges = np.concatenate([[0], np.cumsum(lens)])[starts]
        return np.insert(ids, edges[1:], np.uint32(end)), np.diff(edges) + 1


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for the 256 bytes: visible
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _in_bytes(piece: str) -> str:
    """A piece in the byte alphabet of the model."""
    if piece.isascii():
        return piece
    return piece.encode().decode("latin-1").translate(_LETTERS)


def id_type(size: int) -> np.dtype:
    """The narrowest unsigned type that holds ``size`` different ids."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _put(files: fs.FileSystem, path: str, tries: str, parts: list[str]) -> None:
    """Give a finished attempt its name; a repeated task replaces it by the same."""
    for part in parts:
        files.move(f"{path}.{part}.{tries}", f"{path}.{part}")


_ENCODERS: dict[str, ChunkEncoder] = {}


def write_tokens(docs: DataFrame, tokenizer: str, end: int, folder: str) -> DataFrame:
    """Encode every text, append ``end``, and write shards in ascending order
    of (doc_id, text hash), null ids first.

    A null or empty text holds the end id alone; repeated rows each hold their
    ids; an empty table has no shard. ``tokenizer`` is a file that all
    executors have, ``folder`` a URI they share (any file system that pyarrow
    opens). Tasks write under names of their own attempt and rename, so a lost
    one can run again. Returns the manifest, which is also written: shard,
    docs, tokens, base.
    """
    dtype = id_type(Tokenizer.from_file(tokenizer).get_vocab_size())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tries = TaskContext.get().partitionId(), uuid.uuid4().hex
        # tasks fill the cores; threads of the library would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _ENCODERS.get(tokenizer)
        if encoder is None:
            encoder = _ENCODERS[tokenizer] = ChunkEncoder(tokenizer)
        path = None
        ids, nulls, lens = [], [], []
        for part in text_slices(batches, "text", 2 << 20):
            if path is None:
                files, root = _place(folder)
                path = f"{root}/{shard:05d}"
                out = files.open_output_stream(f"{path}.bin.{tries}")
            tokens, counts = encoder.encode(part.column(1).fill_null(""), end)
            out.write(tokens.astype(dtype).tobytes())
            ids.append(np.asarray(part.column(0).fill_null(0), dtype="<i8"))
            nulls.append(np.asarray(part.column(0).is_null(), dtype=np.uint8))
            lens.append(counts)
        if path is None:
            return
        out.close()
        ends = np.cumsum(np.concatenate(lens))
        with files.open_output_stream(f"{path}.idx.{tries}") as index:
            index.write(np.concatenate(ids).tobytes())
            index.write(np.concatenate(nulls).tobytes())
            index.write(np.concatenate([[0], ends]).astype("<u8").tobytes())
        _put(files, path, tries, ["bin", "idx"])
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "docs": [len(ends)], "tokens": [int(ends[-1])]},
            schema=pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    files, root = _place(folder)
    files.create_dir(root, recursive=True)
    spark = docs.sparkSession
    bounded_batches(spark)
    totals = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash")
        .select("doc_id", "text")
        .mapInArrow(run, "shard int, docs long, tokens long"),
        "token-shards",
    )
    # prefix sums over shards, whose number the cluster's settings fix
    rows, base = [], 0
    for t in totals.orderBy("shard").collect():
        rows.append((t["shard"], t["docs"], t["tokens"], base))
        base += t["tokens"]
    manifest = spark.createDataFrame(rows, "shard int, docs long, tokens long, base long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return manifest


def _mapped(folder: str, name: str) -> np.ndarray:
    """The bytes of a file: memory-mapped if local, else read."""
    files, root = _place(folder)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", dtype=np.uint8, mode="r")
    with files.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def read_tokens(
    spark: SparkSession, folder: str, dtype: np.dtype, digest: bool = False
) -> DataFrame:
    """Read a dataset: doc_id, start, n_tokens, and ``ids`` (array of int), or
    ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, n = f"{row['shard']:05d}", row["docs"]
                lo, hi = row["first"], min(n, row["first"] + READ_DOCS)
                index = _mapped(folder, f"{name}.idx")
                offsets = index[9 * n :].view("<u8")[lo : hi + 1].astype(np.int64)
                flat = _mapped(folder, f"{name}.bin").view(dtype)
                docs = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
                if digest:
                    last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs])
                else:
                    last = pa.array([x.astype(np.int32) for x in docs], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(
                            index[: 8 * n].view("<i8")[lo:hi],
                            mask=index[8 * n + lo : 8 * n + hi].astype(bool),
                        ),
                        pa.array(row["base"] + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        last,
                    ],
                    names,
                )

    out = "ids_crc32 long" if digest else "ids array<int>"
    names = ["doc_id", "start", "n_tokens", out.split()[0]]
    ranges = (
        spark.read.parquet(f"{folder}/manifest")
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(READ_DOCS).cast("long"))))
        .repartition("shard", "first")
    )
    return ranges.mapInArrow(run, f"doc_id long, start long, n_tokens long, {out}")


def token_files(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Write the dataset of ``docs`` to a new shared folder and read it back:
    doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    write_tokens(docs, tokenizer, end, folder)
    dtype = id_type(Tokenizer.from_file(tokenizer).get_vocab_size())
    return read_tokens(spark, folder, dtype, digest=True)
