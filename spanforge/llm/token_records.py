"""Token-id output: length-delimited binary records with masked checksums and an offset index.

A record file is a run of frames, each

    length      u64  little-endian, of the payload
    checksum    u32  masked CRC-32C of the eight length bytes
    payload     u8 whether there is a doc_id, i64 doc_id, u8 bytes of an id, then the token ids
    checksum    u32  masked CRC-32C of the payload

and its index file has ``i64 doc_id, u64 offset, u64 number of ids`` for each frame, for shuffled
reads. Ids take two bytes if the vocabulary lets them, else four. Documents lie in ascending ``doc_id`` order over all files (null first; equal ids by text).

Each task writes under a name of its own attempt and reports it; only reported files are read,
so attempts that were lost or ran twice leave nothing in the result. A task holds a few
megabytes of text and ids at a time.

Null and empty texts give the end id alone; repeated rows are written as often as they come; an
empty table gives no files. Other columns are not looked at.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import as_bytes, in_worker, small_batches, stored, table
from spanforge.session import checkpoint_root

END_ID = 1
#: Characters of a text that deal out equal ids, and records that are read back at a time.
DEALT, READ = 64, 20_000
MEMO = 700_000
PAYLOAD_HEAD, HEAD_SIZE = "<?qB", 10
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8")])
BLOCK = 256
#: Reversed polynomial of CRC-32C, and the constant that masked checksums add.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


def _byte_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = (values >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (values & np.uint32(1)))
    return values


TABLE = _byte_table()


def _zero_tables(n: int) -> list[np.ndarray]:
    """What ``n`` zero bytes make of each byte of a register."""
    tables = []
    for k in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(n):
            register = TABLE[register & np.uint32(255)] ^ (register >> np.uint32(8))
        tables.append(register)
    return tables


ZEROS = {BLOCK: _zero_tables(BLOCK), 8: _zero_tables(8)}


def masked_crc32c(parts: list[bytes], block: int = BLOCK) -> np.ndarray:
    """Masked CRC-32C of each of ``parts`` (four bytes or more), all in step.

    Every part is cut into blocks whose registers are computed side by side from zero; the
    checksum is linear, so they combine afterwards. Zeros in front of a part change nothing.
    """
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    blocks = -(-lengths // block)
    ends = np.cumsum(blocks) * block
    data = np.zeros(int(blocks.sum()) * block, np.uint8)
    for part, length, end in zip(parts, lengths, ends, strict=True):
        data[end - length : end] = np.frombuffer(part, np.uint8)
        data[end - length : end - length + 4] ^= np.uint8(255)
    columns = np.ascontiguousarray(data.reshape(-1, block).T)
    each = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        each = TABLE[(each ^ column) & np.uint32(255)] ^ (each >> np.uint32(8))
    order = np.argsort(-blocks, kind="stable")
    begins, counts = (ends // block - blocks)[order], blocks[order]
    register = np.zeros(len(parts), np.uint32)
    zeros = ZEROS[block]
    for t in range(int(counts[0]) if len(counts) else 0):
        active = int(np.searchsorted(-counts, -t, side="left"))
        old = register[:active]
        shifted = zeros[0][old & np.uint32(255)]
        for k in (1, 2, 3):
            shifted = shifted ^ zeros[k][(old >> np.uint32(8 * k)) & np.uint32(255)]
        register[:active] = shifted ^ each[begins[:active] + t]
    crc = np.empty_like(register)
    crc[order] = register ^ np.uint32(0xFFFFFFFF)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    of_heads = masked_crc32c(heads, 8).astype("<u4")
    of_payloads = masked_crc32c(payloads).astype("<u4")
    return [
        b"".join((h, a.tobytes(), p, b.tobytes()))
        for h, a, p, b in zip(heads, of_heads, payloads, of_payloads, strict=True)
    ]


def unframed(stream: pa.NativeFile, most: int = 2_000_000) -> Iterator[bytes]:
    """Payloads of a record file, every checksum verified."""

    def verified() -> Iterator[bytes]:
        good = masked_crc32c([h for h, _, _, _ in group], 8) == [a for _, a, _, _ in group]
        good &= masked_crc32c([p for _, _, p, _ in group]) == [b for _, _, _, b in group]
        if not good.all():
            raise ValueError("checksum mismatch in a record file")
        for _, _, payload, _ in group:
            yield payload

    group, held = [], 0
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError("record file ends inside a frame")
        length = int.from_bytes(head[:8], "little")
        body = stream.read(length + 4)
        if len(body) < length + 4:
            raise ValueError("record file ends inside a frame")
        group.append((head[:8], int.from_bytes(head[8:], "little"), body[:-4], int.from_bytes(body[-4:], "little")))
        held += length
        if held > most:
            yield from verified()
            group, held = [], 0
    if group:
        yield from verified()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    """``doc_id`` and the ids, as little-endian u32, of a payload."""
    known, doc_id, width = struct.unpack_from(PAYLOAD_HEAD, payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=HEAD_SIZE).astype("<u4")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


#: Marks that are cut off the end of a word, and where letters begin that may not be cut behind or
#: folded: below it no version of the tables of letters differs, and letters do not combine.
MARKS, FAR_LETTERS = string.punctuation, "\u0500"
#: Words whose ids are laid out at a time.
LAID_OUT = 500_000


class Encoder:
    """Token ids of texts as little-endian bytes, by distinct words with a bounded memory.

    White space always ends a piece of this tokenizer, so that the ids of a text are those of
    its words in a row. Marks behind a letter or digit are a piece of their own, and letters are
    lower-cased, so that most words are known by their stem. A word that holds an added token of
    the tokenizer is encoded whole. Words are split, told apart and laid out in Arrow and numpy;
    only those that differ within a call are looked at one by one.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end_id], self.kind).tobytes()
        self.known: dict[str, bytes] = {}  # stems and marks
        self.words: dict[str, bytes] = {}
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # Tokens may be told to match the normalised text; letters of either case cover that.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        # No word of letters alone holds an added token.
        self.marked = not any(t.isalpha() for t in added)
        pieces = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True

    def learn(self, words: list[str]) -> None:
        """Encode new words; those of letters alone in long lines, told apart by word ends."""
        plain = [w for w in words if w.isalpha()]
        alone = [w for w in words if not w.isalpha()]
        groups = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        lines = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, line in zip(groups, lines, strict=True):
            ids = np.array(line.ids, self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(cuts) != len(group):
                alone += group
                continue
            data = ids.tobytes()
            for word, begin, end in zip(group, [0, *cuts], cuts, strict=False):
                self.known[word] = data[begin:end]
        found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        for word, encoding in zip(alone, found, strict=True):
            self.known[word] = np.array(encoding.ids, self.kind).tobytes()

    def parts(self, word: str) -> tuple[str, str]:
        """The stem that a word is known by and the marks behind it; their ids in a row are its own."""
        if self.marked and word.isascii() and word.isalpha():
            return word.lower(), ""
        if self.added and self.added.search(word):
            return word, ""
        stem = word.rstrip(MARKS)
        last = stem[-1:]
        if not ("0" <= last <= "9" or (last < FAR_LETTERS and last.lower().isalpha())):
            return word, ""
        marks = word[len(stem) :]
        if stem.isalpha() and (stem.isascii() or max(stem) < FAR_LETTERS):
            lower = stem.lower()
            # Sigma is lower-cased by its place in a word, and a few letters become two.
            if len(lower) == len(stem) and "\u03a3" not in stem:
                stem = lower
        return stem, marks

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        distinct = split.flatten().dictionary_encode()
        words = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > MEMO:
            self.known.clear()
        if len(self.words) > MEMO // 2:
            self.words.clear()
        new = [(word, *self.parts(word)) for word in words if word not in self.words]
        stems = {stem for _, stem, _ in new}.union({marks for _, _, marks in new})
        self.learn(list(stems.difference(self.known)))
        known = self.known
        for word, stem, marks in new:
            self.words[word] = known[stem] + known[marks]
        pieces = list(map(self.words.__getitem__, words))
        pool = np.frombuffer(b"".join(pieces), self.kind)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        starts = np.cumsum(lengths) - lengths
        each = distinct.indices.to_numpy()
        laid_out = []
        for at in range(0, len(each), LAID_OUT):
            some = each[at : at + LAID_OUT]
            n = lengths[some]
            places = np.repeat(starts[some] - (np.cumsum(n) - n), n)
            places += np.arange(len(places))
            laid_out.append(pool[places].tobytes())
        data = b"".join(laid_out)
        after = np.concatenate([[0], np.cumsum(lengths[each])])
        cuts = (after[split.offsets.to_numpy()] * self.width).tolist()
        return [data[a:b] + self.end for a, b in zip(cuts, cuts[1:], strict=False)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def reading_order() -> list[Column]:
    """Columns that sort a table read from files as its files hold it.

    Spark numbers the files of an ordered result in its order; a large file is read in blocks,
    each from its first row to its last.
    """
    number = F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1).try_cast("long")
    return [number, F.input_file_block_start(), F.monotonically_increasing_id()]


def write_records(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, order: list[Column] | None = None
) -> DataFrame:
    """Write ``docs`` as record files below ``folder``; one row per file that counts:
    ``shard, records_path, index_path, n_records, n_tokens``.

    Shards and their records go by ``order``, then by ``doc_id`` and text. Without an order, equal
    and null ids are dealt by the beginning of their text, so that they need not share a task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        encoder = in_worker(f"encoder {path} {end_id}", lambda: Encoder(path, end_id))
        shard = TaskContext.get().partitionId()
        store, place = file_system(folder)
        name = f"{place}/part-{shard:06d}-{uuid.uuid4().hex}"
        records = index = None
        at = n_records = n_tokens = 0
        for batch in small_batches(batches, 2_000_000):
            if records is None:
                store.create_dir(place, recursive=True)
                records = store.open_output_stream(name + ".rec")
                index = store.open_output_stream(name + ".idx")
            ids = encoder.encode(as_bytes(batch.column("text")))
            doc_ids = batch.column("doc_id").to_pylist()
            framed = frames([struct.pack(PAYLOAD_HEAD, d is not None, d or 0, encoder.width) + x for d, x in zip(doc_ids, ids, strict=True)])
            entries = np.zeros(len(ids), INDEX)
            entries["doc_id"] = [d or 0 for d in doc_ids]
            entries["offset"] = at + np.concatenate([[0], np.cumsum([len(x) for x in framed])[:-1]])
            entries["n_tokens"] = [len(x) // encoder.width for x in ids]
            records.write(b"".join(framed))
            index.write(entries.tobytes())
            at += sum(map(len, framed))
            n_records += len(ids)
            n_tokens += int(entries["n_tokens"].sum())
        if records is not None:
            records.close()
            index.close()
            yield pa.RecordBatch.from_pydict({
                "shard": [shard], "records_path": [name + ".rec"], "index_path": [name + ".idx"],
                "n_records": [n_records], "n_tokens": [n_tokens],
            })

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keys = [k.alias(f"key{n}") for n, k in enumerate(order or [doc_id, F.substring(text, 1, DEALT)])]
    names = [f"key{n}" for n in range(len(keys))]
    ordered = docs.select(doc_id.alias("doc_id"), text.alias("text"), *keys)
    ordered = ordered.repartitionByRange(*names).sortWithinPartitions(*names, "doc_id", "text").drop(*names)
    shape = "shard long, records_path string, index_path string, n_records long, n_tokens long"
    return stored(ordered.mapInArrow(write, shape), "shards")


def read_records(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read back from the files.

    ``start`` counts the ids before a record over all files. The running sum over shards has a
    row per file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # A number given by hand is kept: the few rows would otherwise all be read by one task.
    placed = placed.repartition(max(1, shards.count()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)

        def rows_of(shard: dict) -> Iterator[tuple]:
            at = shard["start"]
            with store.open_input_stream(shard["records_path"], buffer_size=1 << 20) as stream:
                for payload in unframed(stream):
                    doc_id, ids = parsed(payload)
                    yield doc_id, at, len(ids), zlib.crc32(ids.tobytes())
                    at += len(ids)

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for shard in batch.to_pylist():
                every = rows_of(shard)
                while rows := list(islice(every, READ)):
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_indexed(index_path: str, records_path: str, folder: str, which: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of the records at the given places of one file, by its offset index."""
    store, _ = file_system(folder)
    with store.open_input_stream(index_path) as stream:
        entries = np.frombuffer(stream.read(), INDEX)
    out = []
    with store.open_input_file(records_path) as stream:
        for place in which:
            stream.seek(int(entries["offset"][place]))
            out.append(parsed(next(unframed(stream, 0))))
    return out


def record_digests(docs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared storage and read the records back."""
    folder = f"{checkpoint_root(docs.sparkSession).rstrip('/')}/llm-records-{uuid.uuid4().hex}"
    return read_records(write_records(docs, folder, order=order), folder)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_digests(table(spark, sf_dir, "documents"))
