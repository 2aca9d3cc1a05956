"""PLINK BED, BIM and FAM. Rows are packed and unpacked in Arrow batches; tasks read and write at their places of a file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from math import isfinite

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from locusframe.functions.text import marker_id
from locusframe.operators.guards import require
from locusframe.operators.numbering import numbered
from locusframe.operators.packed import matrix
from locusframe.sources.placed import write_rows

MAGIC = b"\x6c\x1b\x01"
#: Two-bit codes of the dosages 0, 1, 2 and of a missing one (last).
CODES = np.array([0b00, 0b10, 0b11, 0b01], np.uint8)
_DOSAGE = np.array([0, -1, 1, 2], np.int8)


def pack(dosages: np.ndarray) -> np.ndarray:
    """Rows of -1, 0, 1, 2 as rows of bytes, four samples each, the first in the lowest bits."""
    require(bool(np.isin(dosages, (-1, 0, 1, 2)).all()), "dosages other than -1, 0, 1, 2")
    codes = CODES[dosages]  # -1 takes the last one
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4))).reshape(len(codes), -1, 4)
    return (codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8)


def unpack(data: np.ndarray, samples: int) -> np.ndarray:
    two = (data[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return _DOSAGE[two.reshape(len(data), -1)[:, :samples]]


def packed_rows(geno: DataFrame) -> DataFrame:
    """The other columns with ``bed``, the packed dosages."""
    fields = [f for f in geno.schema if f.name != "dosages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pack(matrix(batch.column("dosages")))
            yield batch.select([f.name for f in fields]).append_column("bed", pa.array([r.tobytes() for r in rows], pa.binary()))

    return geno.select(*(f.name for f in fields), "dosages").mapInArrow(run, StructType([*fields, StructField("bed", BinaryType())]))


def write_plink(geno: DataFrame, samples: list[str], phenotypes: dict[str, list[float]], prefix: str, structure: DataFrame | None = None) -> dict[str, object]:
    """prefix.bed and .bim, a .fam for each trait, a list of marker ids for each chromosome and, for ``structure``
    (variant_index), of its markers; returns what was written.

    Marker ids are unique whatever the names of the variants; variant_index must count from 0 without a gap. Tasks write
    at their places of the files, and twelve rows of the BED file are read back and compared.
    """
    for trait, values in phenotypes.items():
        require(len(values) == len(samples) and all(map(isfinite, values)), f"{trait}: {len(samples)} finite values are needed")
    rows = numbered(packed_rows(geno.select("variant_index", "CHR", "pos", "dosages")), [F.col("variant_index")], "_number")
    width, n = -(-len(samples) // 4), rows.count()
    off = rows.filter((F.col("_number") != F.col("variant_index")) | (F.length("bed") != width) | F.col("CHR").isNull() | F.col("pos").isNull()).limit(1).collect()
    require(not off, f"variant_index isn't 0 to {n - 1}, or a row has no place or not {len(samples)} samples: {[r['variant_index'] for r in off]}")
    rows = rows.withColumn("id", marker_id(F.col("variant_index")))
    write_rows(rows, "bed", f"{prefix}.bed", MAGIC)
    cells = [F.col(c).cast("string") for c in ("CHR", "id")] + [F.lit("0"), F.col("pos").cast("string"), F.lit("A"), F.lit("G\n")]
    write_rows(rows.select(F.concat_ws("\t", *cells).alias("line")), "line", f"{prefix}.bim")
    line = F.concat("id", F.lit("\n")).alias("line")
    chromosomes = sorted(r["CHR"] for r in rows.select("CHR").distinct().collect())
    lists = {int(c): write_rows(rows.filter(F.col("CHR") == c).select(line), "line", f"{prefix}.chr{c}_snps.txt") for c in chromosomes}
    if structure is not None:
        own = numbered(structure.select("variant_index").distinct().join(rows.select("variant_index", "id"), "variant_index"), [F.col("variant_index")], "_number")
        require(own.count() == structure.count(), "structure markers repeat or aren't among the variants")
        write_rows(own.select(line), "line", f"{prefix}.structure_snps.txt")
    for trait, values in phenotypes.items():
        with open(f"{prefix}.{trait}.fam", "w", newline="\n") as fam:
            fam.writelines(f"{s} {s} 0 0 0 {v:.12g}\n" for s, v in zip(samples, values, strict=True))
    checked = sorted({round(k * (n - 1) / 11) for k in range(12)}) if n else []
    with open(f"{prefix}.bed", "rb") as bed:
        for r in geno.filter(F.col("variant_index").isin(checked)).select("variant_index", "dosages").collect():
            bed.seek(len(MAGIC) + r["variant_index"] * width)
            got = unpack(np.frombuffer(bed.read(width), np.uint8)[None], len(samples))[0]
            require(got.tolist() == list(r["dosages"]), f"row {r['variant_index']} of the BED file differs from its dosages")
    return {"variants": n, "samples": len(samples), "bytes_per_variant": width, "bed_bytes": os.path.getsize(f"{prefix}.bed"), "chromosomes": lists, "checked": checked}


def read_bed(spark: SparkSession, path: str, samples: int, task_bytes: int = 32 << 20) -> DataFrame:
    """variant_index and dosages of a SNP-major file, which each task reads a range of; the driver reads its first bytes.

    ``path`` is a URI that pyarrow knows, or a path of a folder that all executors share.
    """
    require(samples > 0, "a BED file needs samples")
    width = -(-samples // 4)
    uri = path if "://" in path else os.path.abspath(path)
    files, name = FileSystem.from_uri(uri)
    size = files.get_file_info(name).size or 0
    require(size >= len(MAGIC) and (size - len(MAGIC)) % width == 0, f"{path}: not a BED file of {samples} samples")
    with files.open_input_file(name) as f:
        require(f.read(len(MAGIC)) == MAGIC, f"{path}: not a SNP-major BED file")
    rows, step, chunk = (size - len(MAGIC)) // width, max(1, task_bytes // width), max(1, (4 << 20) // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = FileSystem.from_uri(uri)
        with own.open_input_file(at) as f:
            for batch in batches:
                for start in batch.column("id").to_pylist():
                    for first in range(start, min(start + step, rows), chunk):
                        n = min(chunk, start + step - first, rows - first)
                        f.seek(len(MAGIC) + first * width)
                        dosages = unpack(np.frombuffer(f.read(n * width), np.uint8).reshape(n, width), samples)
                        ends = pa.array(np.arange(n + 1, dtype=np.int32) * samples)
                        yield pa.record_batch([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(ends, pa.array(dosages.ravel()))], ["variant_index", "dosages"])

    return spark.range(0, rows, step, numPartitions=max(1, -(-rows // step))).mapInArrow(run, "variant_index long, dosages array<tinyint>")


def kinship_text(k: np.ndarray, path: str, loco: bool = False) -> None:
    """A symmetric, positive semi-definite matrix as text; eigenvalues a little below 0 are cut off."""
    require(float(np.abs(k - k.T).max()) <= 1e-8, "the matrix isn't symmetric")
    k = (k + k.T) / 2
    values, vectors = np.linalg.eigh(k)
    require(float(values[0]) >= -1e-7, "the matrix has negative eigenvalues")
    if loco:
        k = (vectors * np.maximum(values, 0)) @ vectors.T
    np.savetxt(path, k, fmt="%.15g", delimiter="\t", newline="\n")


def covariate_text(pcs: np.ndarray, k: int, path: str) -> None:
    np.savetxt(path, np.hstack((np.ones((len(pcs), 1)), pcs[:, :k])), fmt="%.15g", delimiter="\t", newline="\n")
