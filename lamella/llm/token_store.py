"""Token-id files under a canonical, length-limited Huffman code.

Documents are tokenised where they are read, and their ids written once to the shared
folder with the range of document ids that each belongs to.  The ids' global counts
give code lengths (package-merge, so that no code is longer than the decoding table is
wide).  The ranges, whose number follows the bytes of text, are sorted and stream
through a packer that holds one block at a time, so that memory does not grow with
the size of a range.  A block stands for itself: it holds its code lengths, its documents' ids and counts, its bits, and a bit offset for each
``CHECKPOINT`` ids, from which decoding starts at many places at once.

The files are Parquet with one row per block, so any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbits as tb
from .shared import tasks, written
from .tokens import encoder, with_end

CHECKPOINT = 256
BLOCK_IDS = 1 << 20
#: Bytes of text in a range of document ids, on average and at most.
RANGE_BYTES = 4 << 30
#: Longest code in bits; the decoding table has 2**LONGEST entries.
LONGEST = 16
CODED = "part int, id long, width int, ids binary"
BLOCK = "part int, block int, n_ids long, doc_ids binary, doc_tokens binary, missing_id boolean, code_lengths binary, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (0 where the count is 0), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    merged, levels = weights, []  # levels: which of a level's items are single symbols
    single = np.ones(len(weights), bool)
    for _ in range(longest - 1):
        levels.append(single)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        merged, single = both[rank], rank < len(weights)
    levels.append(single)
    take = 2 * len(weights) - 2
    for single in reversed(levels):
        n_single = int(single[:take].sum())
        lengths[order[:n_single]] += 1
        take = 2 * (take - n_single)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: ascending by (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        codes[ids] = code + np.arange(len(ids))
        code = (code + len(ids)) << 1
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids end to end, first bit highest, and the bit offset of each CHECKPOINT-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    code = codes[ids]
    word, room = at >> 6, 64 - (at & 63) - size
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words = np.zeros(int((end[-1] + 63) >> 6) + 1, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int((end[-1] + 7) >> 3)], at[::CHECKPOINT].astype(np.uint64)


def unpack_bits(bits: bytes, checkpoints: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The n ids; all checkpoints advance together, one table look-up per id."""
    if not n:
        return np.zeros(0, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spread = 1 << (LONGEST - lengths[order].astype(np.int64))
    symbol, width = np.repeat(order, spread).astype(np.uint32), np.repeat(lengths[order], spread).astype(np.int64)
    if len(symbol) < 1 << LONGEST:  # one id only
        symbol, width = np.resize(symbol, 1 << LONGEST), np.resize(width, 1 << LONGEST)
    data = np.frombuffer(bits + bytes(CHECKPOINT * LONGEST // 8 + 4), np.uint8)
    wide = (data[:-2].astype(np.uint32) << np.uint32(16)) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | data[2:]
    at = checkpoints.astype(np.int64)
    out = np.empty((min(CHECKPOINT, n), len(at)), np.uint32)
    for k in range(len(out)):
        look = (wide[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[k] = symbol[look]
        at += width[look]
    return out.T.ravel()[:n] if len(out) == CHECKPOINT else out[:, 0]


def write_ids(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every text (tokenizer's, then ``end_id``) in ascending order of id, in blocks of
    whole texts with at most ``block_ids`` ids each (a longer text is a block alone).

    Cases: null and empty texts have the one id ``end_id``; rows that repeat an id stand next to
    each other, by their ids; null ids come last; an empty table gives an empty folder of files.
    Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    n = max(tasks(spark), -(-size // RANGE_BYTES))
    bounds = np.array(plain.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [], np.float64)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in tb.slices(batches):
            ids, first = with_end(*enc.encode(*tb.text_buffer(batch.column("text"))), end_id)
            key = np.asarray(pc.cast(pc.fill_null(batch.column("id"), np.iinfo(np.int64).max), pa.float64(), safe=False))
            narrow = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
            width = narrow.dtype.itemsize
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(narrow.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, key).astype(np.int32)), batch.column("id"), pa.array(np.full(len(key), width, np.int32)), blobs], names=["part", "id", "width", "ids"])

    coded = written(plain.mapInArrow(tokenise, CODED), "coded")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(flat(batch))
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["token", "n"])

    seen = coded.select("width", "ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # one row per id of the vocabulary
    counts = np.zeros(int(pc.max(seen.column("token")).as_py() or 0) + 1, np.int64)
    counts[np.asarray(seen.column("token"))] = np.asarray(seen.column("n"))
    book = spark.sparkContext.broadcast(code_lengths(counts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of (part, id, ids), whatever their number, and leave a block at a time."""
        lengths = book.value
        codes, packed_book = canonical(lengths), zlib.compress(lengths.tobytes())
        waiting, held, part, number = [], 0, None, 0

        def block() -> pa.RecordBatch:
            mine = pa.Table.from_batches(waiting).combine_chunks()
            ids, doc_ids = flat(mine), mine.column("id")
            tokens = tokens_of(mine)
            bits, marks = pack_bits(ids, lengths, codes)
            names = np.asarray(pc.fill_null(doc_ids, 0)).astype("<i8").tobytes()
            if doc_ids.null_count:  # null ids are marked by a bit each
                names += np.packbits(np.asarray(pc.is_null(doc_ids))).tobytes()
            values = (part, number, len(ids), names, tokens.astype("<i8").tobytes(), doc_ids.null_count > 0, packed_book, marks.astype("<u4").tobytes() if len(bits) < 1 << 28 else marks.astype("<u8").tobytes(), bits)
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
            columns = [c.split() for c in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, columns, strict=True)], names=[c for c, _ in columns])

        for batch in batches:
            tokens, parts = tokens_of(batch), np.asarray(batch.column("part"))
            upto, at = np.cumsum(tokens), 0
            while at < batch.num_rows:
                if held and (parts[at] != part or held + tokens[at] > block_ids):
                    yield block()
                    waiting, held, number = [], 0, number + 1
                if parts[at] != part:
                    part, number = int(parts[at]), 0
                before = upto[at] - tokens[at]
                to = max(at + 1, int(np.searchsorted(upto, before + block_ids - held, "right")))
                to = min(to, int(np.searchsorted(parts, part, "right")))
                waiting.append(batch.slice(at, to - at))
                held += int(upto[to - 1] - before)
                at = to
        if held:
            yield block()

    ordered = coded.repartitionById(n, "part").sortWithinPartitions("part", F.asc_nulls_last("id"), "ids")
    ordered.mapInArrow(pack, BLOCK).write.option("compression", "none").parquet(path)


def flat(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The ids of all rows of CODED, end to end."""
    width = np.asarray(table.column("width"))
    buf, offs = tb.text_buffer(table.column("ids"))
    if not len(width) or (width == 2).all():
        return np.frombuffer(buf.tobytes(), "<u2").astype(np.uint32)
    raw = buf.tobytes()
    return np.concatenate([np.frombuffer(raw[a:z], f"<u{w}").astype(np.uint32) for a, z, w in zip(offs[:-1], offs[1:], width, strict=True)])


def tokens_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.asarray(pc.binary_length(table.column("ids"))).astype(np.int64) // np.asarray(table.column("width"))


def read_ids(spark: SparkSession, path: str, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """Returns ``id_col, start, n_tokens, ids_crc32`` for each document of the files, and ``ids`` if asked for.

    start is the number of ids of all documents before it.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    kinds = "part int, block int, id long, inner long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["doc_tokens"], "<i8")
                doc_ids = np.frombuffer(row["doc_ids"], "<i8", len(tokens))
                null = np.unpackbits(np.frombuffer(row["doc_ids"], np.uint8, -1, 8 * len(tokens)), count=len(tokens)).astype(bool) if row["missing_id"] else None
                lengths = np.frombuffer(zlib.decompress(row["code_lengths"]), np.uint8)
                marks = np.frombuffer(row["checkpoints"], "<u4" if len(row["bits"]) < 1 << 28 else "<u8")
                ids = unpack_bits(row["bits"], marks, row["n_ids"], lengths)
                first = np.concatenate([[0], np.cumsum(tokens)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                n = len(tokens)
                columns = [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(doc_ids, mask=null), pa.array(first[:-1]), pa.array(tokens), pa.array(crc, pa.int64())]
                names = ["part", "block", "id", "inner", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    sizes = blocks.select("part", "block", "n_ids")
    parts, total = [], 0
    for r in sorted(sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # one row per part
        parts.append((r["part"], total))
        total += r["n"]
    before = spark.createDataFrame(parts, "part int, before long")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    offsets = sizes.withColumn("in_part", inside).join(before, "part").select("part", "block", (F.col("in_part") + F.col("before")).alias("offset"))
    out = blocks.drop("in_part").mapInArrow(decode, kinds).join(offsets, ["part", "block"])
    return out.select(F.col("id").alias(id_col), (F.col("inner") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
