"""Sinks (S7): Parquet / CSV writers for exports.

* ``write_frame``: distributed write, one header row of column names (CSV)
  or the schema with column metadata (Parquet). The column dictionary is
  written beside it by the job.
* ``write_two_row_csv``: the reference's download format — a group row and
  a label row above the data — as a folder: the first part file holds the two
  header rows (from the schema, never from collected data), the others the
  sorted body; concatenated in name order they are the download.
* ``write_download``: the same bytes as ONE file, joined by the file system:
  no row passes through a single task or the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from regionpanel.functions.keys import qcol
from regionpanel.operators.headers import two_row_header


FORMATS = ("parquet", "csv", "orc", "json")


def write_frame(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Distributed write (one task per partition)."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_two_row_csv(df: DataFrame, path: str, order_by: tuple[str, ...] = ("state_id", "county_id")) -> None:
    names = [f"c{i}" for i in range(len(df.columns))]
    head = df.sparkSession.createDataFrame([tuple(r) for r in two_row_header(df)], ", ".join(f"{n} string" for n in names)).coalesce(1)
    keys = [qcol(c).asc_nulls_last() for c in order_by if c in df.columns]
    body = df.orderBy(*keys) if keys else df
    body = body.select(*[qcol(c).cast("string").alias(n) for c, n in zip(df.columns, names)])
    head.union(body).write.mode("overwrite").option("header", False).option("emptyValue", "").csv(path)


COPY_BYTES = 8 << 20


def _copy_parts(target: str):
    """Each row names a part, its size and the byte of ``target`` where it belongs."""
    def run(frames):
        import os

        for frame in frames:
            for source, offset, size in zip(frame["path"], frame["offset"], frame["size"]):
                out = os.open(target, os.O_WRONLY)
                try:
                    with open(source, "rb") as part:
                        at = int(offset)
                        while body := part.read(COPY_BYTES):
                            while body:
                                n = os.pwrite(out, body, at)
                                body, at = body[n:], at + n
                    os.fsync(out)
                finally:
                    os.close(out)
                if at != offset + size:
                    raise RuntimeError(f"{source} changed its size while it was copied")
            yield frame[["path"]]
    return run


def join_parts(spark, folder: str, target: str) -> int:
    """The part files of ``folder``, in name order, as the one file ``target``; returns its bytes.

    Where the file system joins files by itself (HDFS), it is asked to, and no
    byte moves. On a local or mounted file system every part has its place in
    the target - the sizes of the parts before it, added up - and tasks copy the
    parts there side by side. The driver sees one name and size per part. The
    target appears under its name when it is whole."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath().getName(), s.getLen(), s.getPath()) for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    total = sum(size for _, size, _ in parts)
    aside = jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}.part")
    if fs.getUri().getScheme() == "file":
        local = lambda p: p.toUri().getPath()
        fs.mkdirs(aside.getParent())
        open(local(aside), "wb").close()
        import os
        os.truncate(local(aside), total)
        rows, offset = [], 0
        for _, size, p in parts:
            rows.append((local(p), offset, size))
            offset += size
        plan = spark.createDataFrame(rows, "path string, offset long, size long").repartition(max(1, len(rows)), "offset")
        if plan.mapInPandas(_copy_parts(local(aside)), "path string").count() != len(rows):
            raise RuntimeError(f"not every part reached {target}")
    else:
        full = [p for _, size, p in parts if size]
        fs.create(aside, True).close()
        if full:
            sources = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(full))
            for i, p in enumerate(full):
                sources[i] = p
            fs.concat(aside, sources)  # a file system that cannot says so
    final = jvm.org.apache.hadoop.fs.Path(target)
    fs.delete(final, False)
    if not fs.rename(aside, final):
        raise RuntimeError(f"{target} could not be renamed into place")
    return total


def write_download(df: DataFrame, target: str, order_by: tuple[str, ...] = ("state_id", "county_id"), keep_parts: bool = False) -> int:
    """S7, the download: one CSV file, group row and label row first, the body sorted."""
    spark = df.sparkSession
    parts = f"{target}.parts-{uuid.uuid4().hex}"
    write_two_row_csv(df, parts, order_by)
    size = join_parts(spark, parts, target)
    if not keep_parts:
        p = spark._jvm.org.apache.hadoop.fs.Path(parts)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return size
