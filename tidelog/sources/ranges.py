"""Parts of files: their first bytes, the lines from an offset on, and whether they can be read at all.

Spark's readers take files from their first byte to their last. Where a bounded part is asked for, tasks open the file
themselves and read that part, in pieces of a few MB; what is dealt to them are paths and offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

#: Bytes that one task takes of a file, and that it reads at once.
RANGE, PIECE = 4 << 20, 4 << 20


def opened(path: str):
    """A file of a store that Arrow knows, for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def stored_at(path: str):
    """(store, name there) of a path."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)


def below(path: str, recursive: bool) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a file) of what is in a folder, hidden names apart; of a file itself."""
    from pyarrow import fs

    store, name = stored_at(path)
    root = "file:" if path.startswith(("/", "file:")) else path.removesuffix(name.rstrip("/")) if path.endswith(name) else path[: path.index("://") + 3]
    if (info := store.get_file_info(name)).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    for f in [info] if info.is_file else store.get_file_info(fs.FileSelector(name, recursive=recursive)):
        if not any(part.startswith(("_", ".")) for part in f.path[len(name) :].split("/")):
            yield root + f.path, f.is_file


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Dealt out over as many tasks as a shuffle has: rows are small, what they stand for is not, so tasks aren't merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` and ``value``, the text of each file below ``paths``.

    Tasks list the folders in the first ones and then read the files, so the names of very many small files don't
    pass through the driver, nor is a task planned for a few of them.
    """

    def listing(recursive: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    found = [x for x in below(path, recursive) if x[1] or not recursive]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string())], ["path"])

        return rows

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            for at in range(0, len(names), 100):
                values = []
                for path in names[at : at + 100]:
                    with opened(path) as f:
                        values.append(f.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100], pa.string()), pa.array(values, pa.string())], ["path", "value"])

    roots = spark.createDataFrame([(p,) for p in ([paths] if isinstance(paths, str) else paths)], "path string")
    folders = dealt(roots.mapInArrow(listing(False), "path string"), "path")
    return dealt(folders.mapInArrow(listing(True), "path string"), "path").mapInArrow(texts, "path string, value string")


def write_files(files: DataFrame) -> None:
    """Write files (``path``, ``content``) as they are, over what is there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, content in zip(paths, batch.column("content").to_pylist(), strict=True):
                store, name = stored_at(path)
                if (folder := path.rsplit("/", 1)[0]) not in made:
                    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    made.add(folder)
                with store.open_output_stream(name, compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    files.select("path", "content").mapInArrow(rows, "path string").write.format("noop").mode("overwrite").save()


def write_lines(lines: DataFrame, *order: str) -> None:
    """Write files of the lines ``raw`` of each ``path``, in the order of the columns ``order``, over what is there.

    One task writes a file, as its sorted lines come; ``ended`` says whether a line end follows the last one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, path, ended, out = set(), None, False, None
        try:
            for batch in batches:
                runs = pc.run_end_encode(batch.column("path"))
                first = 0
                for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if name != path:
                        if out is not None:
                            out.write(b"\n" if ended else b"")
                            out.close()
                        store, where = stored_at(name)
                        if (folder := where.rsplit("/", 1)[0]) not in made:
                            store.create_dir(folder, recursive=True)
                            made.add(folder)
                        path, out = name, store.open_output_stream(where, compression=None)
                    elif first == 0:
                        out.write(b"\n")
                    raw = batch.column("raw").slice(first, end - first)
                    out.write(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), raw), "\n")[0].as_buffer())
                    ended, first = batch.column("ended")[end - 1].as_py(), end
                yield pa.RecordBatch.from_arrays([pa.array(runs.values.to_pylist(), pa.string())], ["path"])
            if out is not None:
                out.write(b"\n" if ended else b"")
        finally:
            if out is not None:
                out.close()

    dealt(lines, "path").sortWithinPartitions("path", *order).select("path", "raw", "ended").mapInArrow(rows, "path string").write.format("noop").mode("overwrite").save()


def listed(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """``path`` and ``size`` of files, from the listing; no content is read. Empty files hold nothing and are not listed."""
    return spark.read.format("binaryFile").options(**options).load(paths).select("path", F.col("length").alias("size"))


def head_hashes(files: DataFrame) -> DataFrame:
    """``path``, ``size``, ``length`` and ``sha256`` (hex) of the first ``length`` bytes of each file; no more is read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with opened(path) as f:
                    hashes.append(hashlib.sha256(f.read_at(length, 0) if length else b"").hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], [*batch.schema.names, "sha256"])

    return files.select("path", "size", F.col("length").cast("bigint")).mapInArrow(rows, "path string, size long, length long, sha256 string")


def head_bytes(files: DataFrame) -> DataFrame:
    """``log``, ``path`` and ``head``, the first ``length`` bytes of each file; no more is read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with opened(path) as f:
                    heads.append(f.read_at(length, 0) if length else b"")
            yield pa.RecordBatch.from_arrays([batch.column("log"), batch.column("path"), pa.array(heads, pa.binary())], ["log", "path", "head"])

    return files.select("log", "path", F.col("length").cast("bigint")).mapInArrow(rows, "log string, path string, head binary")


def line_ends(path: str, low: int, high: int) -> int:
    """Line ends among the bytes from ``low`` to ``high``."""
    n = 0
    with opened(path) as f:
        while low < high:
            data = f.read_at(min(PIECE, high - low), low)
            if not data:
                break
            n += data.count(b"\n")
            low += len(data)
    return n


def lines_from(path: str, low: int, high: int, size: int, begins: bool) -> Iterator[list[tuple[int, bytes, bool]]]:
    """(offset, bytes, whether an end follows) of the lines that begin from ``low`` to ``high``, in lists of a few MB.

    Where ``begins`` is false, a line begins after the first line end at ``low - 1`` or later. Nothing beyond ``size``
    is read.
    """
    with opened(path) as f:
        at, held, skipping = low - (not begins), [], not begins
        start = at
        while True:
            data = f.read_at(min(PIECE, size - at), at) if at < size else b""
            at += len(data)
            last = at >= size or not data
            if skipping and (cut := data.find(b"\n")) >= 0:
                start, data, skipping = at - len(data) + cut + 1, data[cut + 1 :], False
            if not skipping:
                held.append(data)
                if b"\n" in data:
                    parts = b"".join(held).split(b"\n")
                    held = [parts.pop()]
                    found = []
                    for part in parts:
                        if start >= high:
                            break
                        found.append((start, part, True))
                        start += len(part) + 1
                    if found:
                        yield found
                if start >= high:
                    return
            if last:
                if not skipping and any(held):
                    yield [(start, b"".join(held), False)]
                return


def read_from(files: DataFrame) -> DataFrame:
    """Numbered lines of files (``path``, ``from_byte``, ``first_line``, ``size``), from a byte where a line begins on.

    ``file_id``, ``path``, ``line_no``, ``byte_offset``, ``raw`` and ``terminated``. Files are cut into ranges; their line
    ends are counted first, so the ranges of one large file are numbered and read by many tasks. A line that goes on
    beyond its range is read to its end; bytes from ``size`` on are left for later.
    """
    wanted = files.filter("from_byte < size").select("path", "from_byte", "first_line", "size")
    low = F.explode(F.sequence("from_byte", F.col("size") - 1, F.lit(RANGE).cast("bigint")))
    ranges = wanted.withColumn("low", low).withColumn("high", F.least(F.col("low") + RANGE, "size"))
    ranges = dealt(ranges, "path", "low")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [line_ends(r["path"], r["low"] - (r["low"] > r["from_byte"]), r["high"] - 1) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "ends"])

    order = ["path", "from_byte", "first_line", "size", "low", "high"]
    ranges = ranges.select(*order).mapInArrow(counted, "path string, from_byte long, first_line long, size long, low long, high long, ends long")
    before = F.coalesce(F.sum("ends").over(Window.partitionBy("path").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    ranges = ranges.withColumn("first_line", F.col("first_line") + before + (F.col("low") > F.col("from_byte")).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["first_line"]
                for found in lines_from(r["path"], r["low"], r["high"], r["size"], r["low"] == r["from_byte"]):
                    raw = [b[:-1] if b.endswith(b"\r") else b for _, b, _ in found]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["path"]] * len(found), pa.string()), pa.array(range(n, n + len(found)), pa.int64()), pa.array([o for o, _, _ in found], pa.int64()),
                        pa.array([b.decode("utf-8", "replace") for b in raw], pa.string()), pa.array([ended for _, _, ended in found], pa.bool_()), pa.array([len(b) + ended for _, b, ended in found], pa.int64())],
                        ["path", "line_no", "byte_offset", "raw", "terminated", "size"])
                    n += len(found)

    lines = dealt(ranges, "path", "low").select(*order).mapInArrow(read, "path string, line_no long, byte_offset long, raw string, terminated boolean, size long")
    return lines.select(F.xxhash64("path").alias("file_id"), "path", "line_no", "byte_offset", "raw", "terminated", "size")


def why_unreadable(path: str) -> str | None:
    """What keeps a file from being read to its end, in pieces; None where nothing does."""
    try:
        with opened(path) as f:
            unzip = zlib.decompressobj(31) if path.endswith(".gz") else None
            ended, at = True, 0
            while data := f.read_at(PIECE, at):
                at += len(data)
                while unzip and data:
                    unzip.decompress(data, 4 * PIECE)
                    ended, data = unzip.eof, unzip.unconsumed_tail or unzip.unused_data
                    if ended:  # members follow each other
                        unzip = zlib.decompressobj(31)
    except zlib.error:
        return "corrupt gzip stream"
    except OSError as e:
        return f"unreadable: {type(e).__name__}"
    return None if ended else "truncated gzip stream"


def rejects(files: DataFrame) -> DataFrame:
    """``path`` and ``error`` of the listed files (``path``, ``size``) that can't be read to their end."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            found = [(p, e) for p in paths if (e := why_unreadable(p)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["path", "error"])

    return files.filter("size > 0").select("path").mapInArrow(rows, "path string, error string")
