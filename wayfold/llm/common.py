"""Helpers that several operators share: shared tables, scans and blocked bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import saved, shared_dir  # noqa: F401

#: Cells of one bitmap block; a block is 8 KB.
BLOCK_BITS = 16

#: Bytes of one Arrow batch on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session does already: by rows alone, long texts make batches of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(names: list[str], want: str) -> str:
    """``want``, behind as many underscores as set it apart from ``names``."""
    taken = {n.lower() for n in names}
    while want.lower() in taken:
        want = "_" + want
    return want


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in runs of about ``limit`` bytes; null is empty. A longer text is a run of its own."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    start, run, size = 0, [], 0
    for k, value in enumerate(col):
        text = value.as_py() or b""
        if run and size + len(text) > limit:
            yield start, run
            start, run, size = k, [], 0
        run.append(text)
        size += len(text) + 1
    if run:
        yield start, run


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column of ``counts[i]`` values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    flat = pa.array(values if kind is not None else np.ascontiguousarray(values).view(np.int64), type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def blocks_of(cells: np.ndarray, counts: np.ndarray, row: int) -> Iterator[dict]:
    """Sorted distinct cells, with counts (255 at most), cut into blocks that can be merged apart from each other."""
    which = (cells >> BLOCK_BITS).astype(np.int64)
    edges = np.flatnonzero(np.diff(which, prepend=-1, append=-1 if len(which) == 0 else which[-1] + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield {"line": row, "block": int(which[a]), "low": (cells[a:b] & 0xFFFF).astype("<u2").tobytes(), "n": np.minimum(counts[a:b], 255).astype(np.uint8).tobytes()}


BLOCKS = "line int, block long, low binary, n binary"


def merged_bits(partial: DataFrame, least: int) -> DataFrame:
    """(line, block, bits): the cells whose counts over all partial blocks reach ``least``.

    Each task adds up one block after the other, row by row, so no number of partial sketches fills its memory."""

    def run(batches):
        count, at = np.zeros(1 << BLOCK_BITS, np.int64), None
        done = lambda: {"line": at[0], "block": at[1], "bits": np.packbits(count >= least).tobytes()}
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != row[:2]:
                    if at is not None:
                        out.append(done())
                        count[:] = 0
                    at = row[:2]
                count[np.frombuffer(row[2], "<u2")] += np.frombuffer(row[3], np.uint8)  # the cells of a row are distinct
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    schema = pa.schema([("line", pa.int32()), ("block", pa.int64()), ("bits", pa.binary())])
    dealt = partial.select("line", "block", "low", "n").repartition("line", "block").sortWithinPartitions("line", "block")
    return dealt.mapInArrow(run, "line int, block long, bits binary")


def gathered_bits(merged: DataFrame, lines: int, bits: int) -> np.ndarray:
    """The bitmap of ``lines`` rows of 2**bits cells, on the driver; its size is fixed by the two parameters."""
    out = np.zeros((lines, 1 << max(bits, BLOCK_BITS) >> 3), np.uint8)
    step = 1 << BLOCK_BITS >> 3
    for row in merged.toLocalIterator():
        out[row["line"], row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return out


def bit_at(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & np.uint8(1)
