"""Search in the JVM: groups of questions and tiles of texts as bytes, between them plain loops.

The loops are in ``Scan.java`` beside this file. Spark's own Java compiler (Janino, which
it uses for the code it generates) translates them once an application, and they reach the
executors as a jar. Tiles lie as files in the shared folder; a task holds one group of
questions and reads all tiles, or its part of them where groups are fewer than cores.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.storage import scratch, shared_dir, write_through

#: Texts of a tile; their sums in 64 bits lie in a near cache, and their numbers in 16 bits.
TILE = 16_384
_NAME = "marram_scan"
_MADE: dict[str, object] = {}
_KEPT: dict[tuple[str, ...], list[str] | None] = {}
BEST, BEFORE, NEAREST = range(3)


def ready(spark: SparkSession) -> bool:
    """Makes the loops known to the session; False where its JVM is out of reach or has no compiler."""
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        try:
            jvm = spark._jvm
            # a module that Spark asks for itself
            jvm.java.lang.Class.forName("jdk.incubator.vector.ByteVector")
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
            compiler.cook(Path(__file__).with_name("Scan.java").read_text())
            codes = compiler.getBytecodes()
            jar = Path(tempfile.mkdtemp(prefix="marram-jar-")) / f"scan-{uuid.uuid4().hex}.jar"
            with zipfile.ZipFile(jar, "w") as z:
                for name in codes.keySet().toArray():
                    z.writestr(name.replace(".", "/") + ".class", bytes(codes[name]))
            spark.sparkContext._jsc.sc().addJar(str(jar))
            _MADE[app] = compiler.getClassLoader().loadClass("marram.Scan").newInstance()
        except Exception:  # the numpy form gives the same rows
            _MADE[app] = None
    if _MADE[app] is None:
        return False
    spark._jsparkSession.udf().register(_NAME, _MADE[app], spark._jsparkSession.parseDataType('"binary"'))
    return True


def pack(*parts) -> bytes:
    """Whole numbers in 64 bits, doubles, and arrays as they lie."""
    return b"".join(np.ascontiguousarray(p).tobytes() if isinstance(p, np.ndarray) else struct.pack("<d" if isinstance(p, float) else "<q", p) for p in parts)


def tiles(table: DataFrame, name: str, write: Callable[[pa.RecordBatch], bytes | None]) -> list[str] | None:
    """Files of ``TILE`` rows of ``table`` at most, as ``write`` forms them; None if it refuses one."""
    folder = scratch(table.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        held, n, paths = [], 0, []

        def put() -> None:
            data = write(pa.concat_batches(held))
            paths.append(None if data is None else f"{folder}/{uuid.uuid4().hex}")
            if data is not None:
                with fs.open_output_stream(f"{path}/{paths[-1].rpartition('/')[2]}") as f:
                    f.write(pack(len(data)) + pa.compress(data, codec="zstd", asbytes=True))
            held.clear()

        for b in batches:
            while b.num_rows:
                part = b.slice(0, TILE - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == TILE:
                    put()
                    n = 0
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    found = [r["path"] for r in table.mapInArrow(run, "path string").collect()]
    return None if None in found else sorted(found)


def kept(table: DataFrame, files: list[str], name: str, write: Callable[[pa.RecordBatch], bytes | None]) -> list[str] | None:
    """:func:`tiles` of a table that ``files`` hold; those of a table in the shared folder, whose files have names of their own, are made once."""
    spark, key = table.sparkSession, tuple(files)
    if key in _KEPT and _there(spark, _KEPT[key]):
        return _KEPT[key]
    made = tiles(table, name, write)
    if files and files[0].removeprefix("file:").lstrip("/").startswith(shared_dir(spark).removeprefix("file:").lstrip("/")):
        _KEPT[key] = made
    return made


def _there(spark: SparkSession, files: list[str] | None) -> bool:
    """Whether tiles are still in the shared folder; a scope may have ended since."""
    if not files:
        return True
    p = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def over(queries: DataFrame, files: list[str], mode: int, k: int, numbers: tuple[float, float, float], form: Callable[[pa.RecordBatch], bytes], names: str, group: int) -> DataFrame:
    """``query_id, doc, score`` of the best, or ``query_id, n`` of the texts before a goal, of groups of ``queries`` and parts of the files.

    ``form`` packs the rows of a group; ``query_id`` is its first column, and ``names`` the
    type of the result's ``doc``.
    """
    spark, kind = queries.sparkSession, dict(queries.dtypes)["query_id"]
    ddl = f"query_id {kind}, n long" if mode == BEFORE else f"query_id {kind}, doc {names}, score double"
    cores = spark.sparkContext.defaultParallelism
    queries = write_through(queries, "queries")
    n = queries.count()
    if not n or not files:
        return spark.createDataFrame([], ddl)
    # whole rounds of the cores; a group is never larger than asked for
    groups = -(-n // group)
    groups = -(-groups // cores) * cores if n >= 64 * cores else groups
    splits = min(len(files), max(1, cores // groups))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            b = pa.concat_batches(held)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([form(b)], pa.binary())], names=["ids", "given"])

    def setup(own: list[str]):
        paths = "\n".join(own).encode()
        return F.lit(bytearray(pack(mode, k, *map(float, numbers), len(paths)) + paths))

    packed = queries.repartition(groups).mapInArrow(gather, f"ids array<{kind}>, given binary")
    if splits == 1:
        asked = packed.withColumn("setup", setup(files))
    else:
        asked = packed.withColumn("setup", F.explode(F.array(*(setup(files[i::splits]) for i in range(splits))))).repartition(groups * splits)
    found = asked.select("ids", F.call_udf(_NAME, "given", "setup").alias("found"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, data = b.column(0).slice(i, 1).flatten(), np.frombuffer(b.column(1)[i].as_buffer(), np.uint8)
                m = len(ids)
                if mode == BEFORE:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(data.view(np.int64))], names=["query_id", "n"])
                    continue
                hits = data[: 4 * m].view(np.int32)
                rest, who = data[4 * m :].tobytes(), np.repeat(np.arange(m), hits)
                doc, score = np.frombuffer(rest, np.int64, len(who)), np.frombuffer(rest, np.float64, len(who), 8 * len(who))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array(doc), pa.array(score)], names=["query_id", "doc", "score"])

    return found.mapInArrow(spell, ddl)
