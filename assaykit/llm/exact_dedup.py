"""Exact duplicates by a Golomb-coded exchange of fingerprints.

1. A sender, which is as many partitions of the scan as make its messages PER_MESSAGE fingerprints long, sorts the
   fingerprints of its texts, cuts them by owner (the leading bits) and sends each owner the differences in Golomb code
   with a power of two as divisor.
2. An owner decodes what all senders sent, finds the fingerprints that occur twice, and returns to each sender a bitmap
   over what that sender had sent.
3. Each partition scans its texts again and lets through only the rows whose bit is set, the suspects.
4. Suspects are compared byte by byte: equal texts are grouped, and the row with the least id stays.

A fingerprint has as many bits as tell the rows apart with SPARE_BITS to spare, so a message takes some 20 to 40 bits a
row, whatever the number of partitions, and the text of a row that has no copy never moves.

Defined results. A null text has no copies and stays; empty texts are copies of each other. The copy that stays is
the one with the least id, a null id after all others, and among equal ids the first in the scan. Repeated rows are
copies, whatever their ids. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ROW_BITS, file_by_partition, filter_rows, materialise, read_own, small_batches, stable, with_row_id

SPARE_BITS = 16
#: Fingerprints that an owner holds at once, at most, on average, and those of a message, at least, on average.
PER_OWNER = 1 << 22
PER_MESSAGE = 256
_SENT = "row long, owner long, n long, code binary"
_MEMBER = -1


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: a byte for the remainder's width, the quotients in unary, then the remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(0, int(np.log2(max(1.0, 0.6931 * float(gaps.mean())))))
    stops = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1) - 1
    unary = np.zeros(stops[-1] + 1, np.uint8)
    unary[stops] = 1
    low = (gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return bytes([width]) + np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def golomb_decode(code: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    width = code[0]
    low_bytes = (n * width + 7) // 8
    split = len(code) - low_bytes
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(code[1:split], np.uint8)))[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(width)
    if width:
        low = np.unpackbits(np.frombuffer(code[split:], np.uint8))[: n * width].reshape(n, width).astype(np.uint64)
        gaps += (low << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def plan(n: int, partitions: int, per_owner: int = PER_OWNER, per_message: int = PER_MESSAGE) -> tuple[int, int, int]:
    """Bits of a fingerprint, leading bits that tell its owner, and how many senders there are, for so many rows."""
    bits = min(64, max(16, int(np.ceil(np.log2(max(2, n)))) + SPARE_BITS))
    owner_bits = min(bits - 1, max(0, (n - 1) // per_owner).bit_length())
    return bits, owner_bits, max(1, min(partitions, n // (per_message << owner_bits)))


def messages(hashed: DataFrame, bits: int, owner_bits: int, senders: int) -> DataFrame:
    """What the senders send: row (of the sender's first partition), owner, n, code; and for each partition a row with
    _MEMBER as owner, n texts, and its sender's row as code. hashed has row and print."""
    shift, scale = np.uint64(bits - owner_bits), np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, members = [], {}
        for b in batches:
            partition, there = b.column(0).to_numpy() >> ROW_BITS, b.column(1).is_valid().to_numpy(zero_copy_only=False)
            for p in np.unique(partition).tolist():
                members[p] = members.get(p, 0) + int(there[partition == p].sum())
            parts.append(_prints(b.column(1).drop_null(), scale))
        if not members:
            return
        row = min(members) << ROW_BITS
        values = np.sort(np.concatenate(parts))
        owner = (values >> shift).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(values)] if len(values) else [0]
        sent = [(row, int(owner[a]), z - a, golomb_encode(values[a:z] - (np.uint64(owner[a]) << shift))) for a, z in zip(cuts[:-1], cuts[1:])]
        sent += [(p << ROW_BITS, _MEMBER, n, row.to_bytes(8, "little")) for p, n in members.items()]
        rows, owners, sizes, codes = zip(*sent)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (rows, owners, sizes)), pa.array(codes, pa.binary())], ["row", "owner", "n", "code"])

    # partitions of one sender follow one another in one task; nothing is shuffled
    return hashed.select("row", "print").coalesce(senders).mapInArrow(send, _SENT)


def _prints(column: pa.Array, scale: np.uint64) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> scale


def _suspects(docs: DataFrame) -> DataFrame:
    """(row, doc_id, print, text) of the rows whose fingerprint occurs twice; docs has row, doc_id and text."""
    spark, n = docs.sparkSession, docs.count()
    hashed = docs.withColumn("print", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    bits, owner_bits, senders = plan(n, hashed._jdf.queryExecution().toRdd().getNumPartitions())
    shift, scale = np.uint64(bits - owner_bits), np.uint64(64 - bits)
    sent_path = file_by_partition(messages(hashed, bits, owner_bits, senders), "fingerprints", local=True)

    def own(group: pd.DataFrame) -> pd.DataFrame:
        values = [golomb_decode(c, k) for c, k in zip(group["code"], group["n"])]
        found, times = np.unique(np.concatenate(values), return_counts=True)
        twice = found[times > 1]
        bitmaps = [np.packbits(np.isin(v, twice)).tobytes() for v in values]
        return pd.DataFrame({"row": group["row"], "owner": group["owner"], "bitmap": bitmaps})

    sent = spark.read.schema(_SENT).parquet(sent_path).where(F.col("owner") != _MEMBER)
    returned = sent.groupBy("owner").applyInPandas(own, "row long, owner long, bitmap binary")
    back_path = file_by_partition(returned, "bitmaps")

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, seen, expected = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if twice is None:
                partition = b.column(0)[0].as_py() >> ROW_BITS
                own = read_own(sent_path, partition, ["owner", "n", "code"]).filter(pc.field("owner") == _MEMBER).to_pydict()
                if len(own["n"]) != 1:
                    raise RuntimeError("the scan changed between its passes: a partition wasn't there before")
                expected, sender = own["n"][0], int.from_bytes(own["code"][0], "little") >> ROW_BITS
                codes = read_own(sent_path, sender, ["owner", "n", "code"]).filter(pc.field("owner") != _MEMBER).to_pydict()
                maps = dict(zip(*read_own(back_path, sender, ["owner", "bitmap"]).to_pydict().values()))
                parts = [np.zeros(0, np.uint64)]
                for owner, k, code in zip(codes["owner"], codes["n"], codes["code"]):
                    bit = np.unpackbits(np.frombuffer(maps[owner], np.uint8))[:k].astype(bool)
                    parts.append(golomb_decode(code, k)[bit] + (np.uint64(owner) << shift))
                twice = np.unique(np.concatenate(parts))
            there = b.column(3).is_valid()
            seen += there.true_count
            mine = _prints(b.column(3).fill_null(0), scale)
            yield b.filter(pa.array(np.isin(mine, twice) & there.to_numpy(zero_copy_only=False)))
        if seen != expected:
            raise RuntimeError(f"the scan changed between its passes: {expected} texts before, {seen} now")

    found = hashed.select("row", "doc_id", "text", "print").mapInArrow(let_through, "row long, doc_id long, text string, print long")
    return materialise(found, "suspects")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document that another, kept one equals byte for byte: row (its place in the scan), mark, doc_id,
    kept_doc_id and copies (documents with this text). docs must be stable()."""
    slim = with_row_id(small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "row")
    suspects = _suspects(slim)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = (
        suspects.groupBy("print", "text").agg(first.alias("kept"), F.count("*").alias("copies")).where("copies > 1")
        .select("print", F.sha2("text", 256).alias("sha"), F.col("kept.row").alias("kept_row"), F.col("kept.doc_id").alias("kept_doc_id"), "copies")
    )
    member = suspects.select("row", "doc_id", "print", F.sha2("text", 256).alias("sha"))
    return member.join(groups, ["print", "sha"]).where("row != kept_row").select("row", F.col("print").alias("mark"), "doc_id", "kept_doc_id", "copies")


def find_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept_doc_id, copies for each document that is dropped; see the module's text for edge cases."""
    return exact_duplicates(stable(docs), id_col, text_col).drop("row", "mark")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of find_exact_duplicates, with all columns as they were."""
    docs = stable(docs)
    return filter_rows(docs, exact_duplicates(docs, id_col, text_col), False, text_col)
