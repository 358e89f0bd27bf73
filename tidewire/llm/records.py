"""Token ids as length-delimited binary files with an offset index (operator 13).

Files. A record is framed as in TFRecord files: its length (8 bytes, little-endian),
the length's masked CRC-32C, the data, the data's masked CRC-32C. The data are
the document's id (8 bytes), whether it has one (1), the bytes of a token (1: 2 or
4) and the tokens. Next to each ``*.records`` file an ``*.index`` file holds for
every record its offset and length in the file, its id, and how many tokens lie
before it and in it, closed by a masked CRC-32C, so that readers can fetch records
in any order. ``manifest.json`` lists the files in order with their first token's
place in the whole; a dataset without it isn't there.

Writing is a Spark data source: documents are dealt to ranges of ids, sorted within
them and written by one task a range. Every attempt of a task writes files of its
own; the commit on the driver lists those of the attempts that counted, so lost
executors and repeated tasks leave at most files that nobody lists. Places come
from the ranges' totals, one row a file.

Encoding is the tokenizers library's: its byte-pair model is asked for every distinct
word of a task, and texts of plain letters and signs are cut to words as its splitter
does. All other texts take the way of ``bpe.Codec``.

Order. Ascending ids; a null id stands where the smallest long does. Rows of one id
follow a hash of their place in the input's files, and an id with many rows is
spread over as many ranges as its share asks for. Null and empty texts are
documents with the end id only. Texts of any length are encoded whole. A table
without rows gives a dataset without files. Columns of the input besides id and
text are not read. Paths are those that pyarrow opens (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewire.llm._store import numbered, release, shared_dir, ship
from tidewire.llm.bpe import PLAIN_WORDS, Codec, Memory, _shared_file

FORMAT = "tidewire_records"
END_ID = 1
#: Bytes of text in a file: at most this, at least that (unless the cluster has tasks to spare).
MOST_TEXT, LEAST_TEXT = 256 << 20, 1 << 20
#: Bytes of records that are checked and decoded together.
READ_BYTES = 8 << 20
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8"), ("has_id", "u1"), ("before", "<u8"), ("n_tokens", "<u8")])
HEAD = struct.Struct("<qBB")
FRAME = 16  # bytes around the data of a record

# CRC-32C of many messages at once.

POLYNOMIAL = 0x82F63B78  # CRC-32C, bits reflected
CHUNK = 64


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1)
    low, high = np.arange(65_536) & 255, (np.arange(65_536) >> 8).astype(np.uint32)
    word = byte[(byte[low] ^ high) & 255] ^ (byte[low] >> 8)
    # Moving a checksum over CHUNK zero bytes is linear: kept as the images of its bytes, squared for twice as many.
    image = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(CHUNK // 2):
        image = word[image & 0xFFFF] ^ (image >> 16)
    moves = []
    for _ in range(40):
        table = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            table[bit // 8, (np.arange(256) >> (bit % 8)) & 1 == 1] ^= image[bit]
        moves.append(table)
        image = _moved(table, image)
    return word, moves


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


WORD, MOVES = _tables()


def masked_crc32c(messages: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of each message (of 4 bytes or more).

    Messages are cut into chunks whose checksums advance side by side, then are
    moved to their place and added.
    """
    if not messages:
        return np.empty(0, np.uint32)
    counts = np.array([-(-len(m) // CHUNK) for m in messages])
    # Zeros in front change nothing once the start value is folded into the first four bytes.
    padded = b"".join(x for m in messages for x in (bytes(-len(m) % CHUNK), (int.from_bytes(m[:4], "little") ^ 0xFFFFFFFF).to_bytes(4, "little"), memoryview(m)[4:]))
    words = np.frombuffer(padded, "<u2").reshape(-1, CHUNK // 2)
    crc = np.zeros(len(words), np.uint32)
    for k in range(CHUNK // 2):
        crc = WORD[(crc ^ words[:, k]) & 0xFFFF] ^ (crc >> 16)
    ends = np.cumsum(counts)
    behind = np.repeat(ends, counts) - 1 - np.arange(len(crc))
    for bit in range(int(behind.max(initial=0)).bit_length()):
        some = (behind >> bit) & 1 == 1
        crc[some] = _moved(MOVES[bit], crc[some])
    whole = np.bitwise_xor.reduceat(crc, ends - counts) ^ np.uint32(0xFFFFFFFF)
    return ((whole >> 15) | (whole << 17)) + np.uint32(0xA282EAD8)


def frame(data: list[bytes]) -> list[bytes]:
    """Framed records."""
    lengths = [struct.pack("<Q", len(d)) for d in data]
    heads, bodies = masked_crc32c(lengths), masked_crc32c(data)
    return [b"".join((n, struct.pack("<I", h), d, struct.pack("<I", b))) for n, h, d, b in zip(lengths, heads.tolist(), data, bodies.tolist(), strict=True)]


def unframe(framed: list[bytes], where: str) -> list[bytes]:
    """The data of framed records; a length or checksum that doesn't fit is an error."""
    lengths, data = [f[:8] for f in framed], [f[12:-4] for f in framed]
    whole = all(len(f) >= FRAME and int.from_bytes(n, "little") == len(d) for f, n, d in zip(framed, lengths, data, strict=True))
    if not whole or [int.from_bytes(f[8:12], "little") for f in framed] != masked_crc32c(lengths).tolist() or [int.from_bytes(f[-4:], "little") for f in framed] != masked_crc32c(data).tolist():
        raise ValueError(f"{where}: a record is damaged")
    return data


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# The data source.


@dataclasses.dataclass
class FileWritten(WriterCommitMessage):
    """What a task wrote: None if it had no rows. ``first`` and ``last`` are (id, tie)."""

    name: str | None = None
    records: int = 0
    tokens: int = 0
    size: int = 0
    first: tuple[int, int] | None = None
    last: tuple[int, int] | None = None


class RecordsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FileWritten:
        store, at = _open(self.path)
        name, out, index, offset, before, keys = f"part-{uuid.uuid4().hex}", None, [], 0, 0, []
        for batch in iterator:
            if not batch.num_rows:
                continue
            ids, ties, tokens = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tie", "tokens"))
            ids, ties, tokens = ids.to_pylist(), ties.to_pylist(), tokens.to_pylist()
            keys += [(SMALLEST if ids[k] is None else ids[k], ties[k]) for k in (0, -1)]
            framed = frame([HEAD.pack(i or 0, i is not None, self.width) + t for i, t in zip(ids, tokens, strict=True)])
            if out is None:
                store.create_dir(at, recursive=True)
                out = store.open_output_stream(f"{at}/{name}.records")
            out.write(b"".join(framed))
            rows = np.zeros(len(framed), INDEX)
            rows["length"], rows["n_tokens"] = [len(f) for f in framed], [len(t) // self.width for t in tokens]
            rows["doc_id"], rows["has_id"] = [i or 0 for i in ids], [i is not None for i in ids]
            for total, each, start in (("offset", "length", offset), ("before", "n_tokens", before)):
                rows[total] = start + np.cumsum(rows[each]) - rows[each]
            offset, before = offset + int(rows["length"].sum()), before + int(rows["n_tokens"].sum())
            index.append(rows)
        release()
        if out is None:
            return FileWritten()
        out.close()
        data = np.concatenate(index).tobytes()
        with store.open_output_stream(f"{at}/{name}.index") as f:
            f.write(data + struct.pack("<I", int(masked_crc32c([data])[0])))
        return FileWritten(name, sum(map(len, index)), before, offset, keys[0], keys[-1])

    def commit(self, messages: list[FileWritten | None]) -> None:
        store, at = _open(self.path)
        files, start = [], 0
        done = sorted((m for m in messages if m is not None and m.name), key=lambda m: (m.first, m.last))
        for m, after in zip(done, [*done, None][1:], strict=True):
            if after is not None and m.last > after.first:
                raise ValueError("rows were not dealt by ranges of ids")
            files.append({"name": m.name, "records": m.records, "tokens": m.tokens, "bytes": m.size, "start": start})
            start += m.tokens
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/manifest.part") as f:
            f.write(json.dumps({"files": files, "tokens": start}).encode())
        store.move(f"{at}/manifest.part", f"{at}/manifest.json")

    def abort(self, messages: list[FileWritten | None]) -> None:
        store, at = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                for kind in ("records", "index"):
                    store.delete_file(f"{at}/{m.name}.{kind}")


class RecordsFile(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class RecordsReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], seed: int | None):
        self.path, self.columns, self.seed = path, columns, seed

    def partitions(self) -> list[InputPartition]:
        store, at = _open(self.path)
        with store.open_input_stream(f"{at}/manifest.json") as f:
            files = [RecordsFile(x["name"], x["start"]) for x in json.loads(f.read())["files"]]
        if self.seed is not None:
            files = [files[k] for k in np.random.default_rng(self.seed).permutation(len(files))]
        return files or [RecordsFile("", 0)]

    def read(self, partition: RecordsFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, at = _open(self.path)
        with store.open_input_file(f"{at}/{partition.name}.index") as f:
            raw = f.read()
        if int.from_bytes(raw[-4:], "little") != int(masked_crc32c([raw[:-4]])[0]):
            raise ValueError(f"{partition.name}: the index is damaged")
        index = np.frombuffer(raw[:-4], INDEX)
        if self.seed is not None:
            name = int(partition.name[-8:], 16)
            index = index[np.random.default_rng([self.seed, name]).permutation(len(index))]
        cuts = np.cumsum(index["length"]) // READ_BYTES
        with store.open_input_file(f"{at}/{partition.name}.records") as f:
            for rows in np.split(index, np.flatnonzero(np.diff(cuts)) + 1):
                if self.seed is None:  # neighbours: one read
                    whole = f.read_at(int(rows["length"].sum()), int(rows["offset"][0]))
                    places = (rows["offset"] - rows["offset"][0]).tolist()
                    framed = [whole[a : a + n] for a, n in zip(places, rows["length"].tolist(), strict=True)]
                else:
                    framed = [f.read_at(n, a) for a, n in zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True)]
                yield self.batch(unframe(framed, partition.name), rows, partition.start)
        release()

    def batch(self, data: list[bytes], rows: np.ndarray, start: int) -> pa.RecordBatch:
        heads = [HEAD.unpack_from(d) for d in data]
        tokens = [np.frombuffer(d, f"<u{h[2]}", offset=HEAD.size) for d, h in zip(data, heads, strict=True)]
        made = {
            "doc_id": lambda: pa.array([h[0] if h[1] else None for h in heads], pa.int64()),
            "start": lambda: pa.array(rows["before"].astype(np.int64) + start),
            "n_tokens": lambda: pa.array([len(t) for t in tokens], pa.int64()),
            "tokens": lambda: pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary()),
            "ids": lambda: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate(tokens).astype(np.int32))),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


class RecordsSource(DataSource):
    """Options: ``path``; reading also ``seed``, for files and the records in them in a shuffled order; writing also ``width``, the bytes of a token."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, tokens binary, ids array<int>"

    def reader(self, schema: T.StructType) -> RecordsReader:
        seed = self.options.get("seed")
        return RecordsReader(self.options["path"], schema.names, None if seed is None else int(seed))

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordsWriter:
        return RecordsWriter(self.options["path"], int(self.options.get("width", 4)))


# Documents to records and back.

SMALLEST = -(2**63)


#: Texts that are cut as a whole, and their words (see ``bpe.PLAIN``: the same characters, and blanks).
PLAIN_TEXT = re.compile("[ \t\r\n!-~À-ÖØ-öø-ÿ]*")
PLAIN_FIND = re.compile(PLAIN_WORDS.pattern.replace("0-9]+", "0-9 \t\r\n]+"))


class WordCodec(Codec):
    """Encodes with the library's own model, word by word."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        super().__init__(file)
        self.model = Tokenizer.from_str(file).model
        self.words = Memory(self.word)
        self.plain = Memory(lambda word: self.word(word.translate(self.symbols)))

    def word(self, symbols: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(symbols)], self.kind).tobytes()

    def forget(self) -> None:
        super().forget()
        self.plain.old = {}

    def encode(self, text: str | None) -> np.ndarray:
        if not text or not self.restated or any(c in text for c in self.heads) or not PLAIN_TEXT.fullmatch(text):
            return super().encode(text)
        return np.frombuffer(b"".join(map(self.plain.__getitem__, PLAIN_FIND.findall(text.lower()))), self.kind)


_CODECS: dict[str, WordCodec] = {}


def codec(file: str) -> WordCodec:
    """The codec of a tokenizer file, built once a Python worker."""
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = WordCodec(file)
    return _CODECS[key]


def encode_ordered(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """``doc_id, tie, tokens`` (packed ids with the end id) dealt by ranges of ids and sorted, and the bytes of a token."""
    spark = docs.sparkSession
    ship(spark)
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"{doc_id} must hold whole numbers")
    file = _shared_file(spark, tokenizer)
    width = np.dtype(codec(file.value).kind).itemsize
    place = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(SMALLEST))
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    spare = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_TEXT))
    files = max(1, -(-total // MOST_TEXT), spare)
    borders = np.empty(0, np.int64)
    if files > 1:
        cut = docs.agg(F.percentile_approx(place, [k / files for k in range(1, files)], max(10_000, 4 * files)).alias("at")).first().at
        borders = np.sort(np.array(cut or [], np.int64))
    given = numbered(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "row")
    kept = given.select("doc_id", F.shiftrightunsigned(F.xxhash64("row"), 1).alias("tie"), "text")
    end = np.array([end_id], f"<u{width}").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_file = codec(file.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # long texts don't pile up
                ids, ties, texts = (batch.column(k).slice(at, 512) for k in range(3))
                tokens = [with_file.encode(t).astype(f"<u{width}", copy=False).tobytes() + end for t in texts.to_pylist()]
                # Borders that equal an id share its rows out by their tie.
                v = ids.fill_null(SMALLEST).to_numpy()
                low, high = np.searchsorted(borders, v, "left"), np.searchsorted(borders, v, "right")
                share = ties.to_numpy() / 2.0**63
                part = np.minimum(low + (share * (high - low + 1)).astype(np.int64), high)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, ties, pa.array(tokens, pa.binary())], names=["part", "doc_id", "tie", "tokens"])
        with_file.forget()
        release()

    packed = kept.mapInArrow(encode, "part int, doc_id bigint, tie bigint, tokens binary")
    dealt = packed.repartitionById(files, F.col("part")).sortWithinPartitions(F.coalesce("doc_id", F.lit(SMALLEST)), "tie")
    return dealt.select("doc_id", "tie", "tokens"), width


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes documents and writes them as a dataset at ``path``, which must not hold one yet."""
    spark = docs.sparkSession
    store, at = _open(path)
    if store.get_file_info(f"{at}/manifest.json").type != fs.FileType.NotFound:
        raise ValueError(f"{path} already holds a dataset")
    rows, width = encode_ordered(docs, tokenizer, end_id, doc_id, text)
    spark.dataSource.register(RecordsSource)
    rows.write.format(FORMAT).option("path", path).option("width", width).mode("append").save()


def read_records(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids"), seed: int | None = None) -> DataFrame:
    """A dataset's documents: ``doc_id``, ``start`` (tokens before it), ``n_tokens``, ``ids`` or ``tokens`` (little-endian, 4 bytes each).

    Checksums are checked. With a ``seed``, files and the records in them come in a shuffled order, by the offset index.
    """
    ship(spark)
    spark.dataSource.register(RecordsSource)
    kinds = {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "tokens": "binary", "ids": "array<int>"}
    reader = spark.read.format(FORMAT).schema(", ".join(f"{c} {kinds[c]}" for c in columns)).option("path", path)
    return (reader if seed is None else reader.option("seed", seed)).load()


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents written to a new dataset in the shared folder and read back with their tokens."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tidewire-records-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    write_records(docs, path, tokenizer)
    return read_records(spark, path, ("doc_id", "start", "n_tokens", "tokens"))
