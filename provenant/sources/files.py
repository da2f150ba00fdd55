"""File sources (#1-#4, #7): contents, includes lists, path lists, markers.

Order inside a text file matters (a Record keeps entry order).  Lines are
read with Spark's text source; their order is recovered from the split's
byte offset (``_metadata.file_block_start``) and the row's place inside the
split, then numbered per file with the distributed numbering -- no file is
read whole into one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.operators.numbering import number_rows
from provenant.session import materialize
from provenant.sources.filesystems import LOCAL, default_root, open_path

#: contents read into one batch
READ_BYTES = 8 << 20
#: bytes of files dealt to one task, where there are many
TASK_BYTES = 128 << 20
#: files written into one folder
FOLDER_FILES = 1_000
WS = r"^\s+|\s+$"


def strip_scheme(col: str | Column) -> Column:
    """``file:/x/y`` -> ``/x/y`` where the local file system is the session's
    default (other schemes kept)."""
    c = F.col(col) if isinstance(col, str) else col
    spark = SparkSession.getActiveSession()
    if spark is not None and default_root(spark) != LOCAL:
        return c
    return F.regexp_replace(c, r"^file:(//)?(?=/)", "")


def scan_contents(spark: SparkSession, location: str, asked: DataFrame | None = None,
                  strict: bool = True, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """#1: ``(path, length, content)`` of every file under ``location``.

    With ``asked`` (a frame of ``path``), the asked-for files of ``location``
    are read by their paths (:func:`read_contents`): others are never opened,
    and no bytes are joined.  A missing file fails the job (``strict``) or has
    a null content and ``present = false``.

    A folder is listed by the executors (:func:`list_files`), and its files are
    dealt to tasks by number and bytes.  Files without any byte give no row.
    """
    if asked is not None:
        return read_contents(asked.select("path"), strict=strict, under=location)
    if recursive:
        files = list_files(spark, location, glob).where("size > 0")
        return read_contents(dealt(files.select("path", "size"), "size").select("path")).drop("present")
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(location).select(strip_scheme("path").alias("path"), "length", "content")


def _name_pattern(glob: str) -> str:
    """A regular expression for a file name pattern with ``*``, ``?``,
    ``[a-z]``, ``{one,other}`` and a backslash before a plain sign."""
    out, depth = "", 0
    for token in re.findall(r"\\.|\[[!^]?\]?[^\]]*\]|.", glob, re.DOTALL):
        if token == "{":
            out, depth = out + "(?:", depth + 1
        elif token == "}" and depth:
            out, depth = out + ")", depth - 1
        elif token == "," and depth:
            out += "|"
        elif len(token) > 1 and token[0] == "[":
            out += "[" + ("^" + token[2:] if token[1] in "!^" else token[1:])
        else:
            out += {"*": ".*", "?": "."}.get(token) or re.escape(token[-1])
    return out


def list_files(spark: SparkSession, location: str, glob: str | None = None) -> DataFrame:
    """``(path, size)`` of every file at or below ``location`` whose name
    matches ``glob``, stored once.

    Folders are looked into level by level, those of a level dealt to all
    tasks: nothing is listed or kept on the driver.  Names that Spark's file
    sources pass over (``_x`` without ``=``, ``.x``) are passed over here too.
    Wildcards in ``location`` are left to Spark's own listing."""
    if re.search(r"[*?\[{]", location):
        r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        r = r.option("pathGlobFilter", glob) if glob else r
        return materialize(r.load(location).select(strip_scheme("path").alias("path"), F.col("length").alias("size")))
    root = default_root(spark)
    name = re.compile(_name_pattern(glob) if glob else ".*", re.DOTALL)
    schema = "path string, folder boolean, size bigint"

    def look(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        def rows(path):
            fs, local = open_path(path, root)
            at = fs.get_file_info(local)
            if at.type == pafs.FileType.NotFound:
                raise FileNotFoundError(f"missing: {path}")
            if at.type != pafs.FileType.Directory:
                yield path, at
                return
            for info in fs.get_file_info(pafs.FileSelector(local)):
                hidden = info.base_name.startswith(".") or info.base_name.startswith("_") and "=" not in info.base_name
                if not hidden and not info.base_name.endswith("._COPYING_"):
                    yield f"{path.rstrip('/')}/{info.base_name}", info

        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = [(p, i.type == pafs.FileType.Directory, i.size) for p, i in rows(path)
                         if i.type == pafs.FileType.Directory or name.fullmatch(i.base_name)]
                for at in range(0, len(found), 10_000):
                    cols = zip(*found[at:at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64()))],
                                                     names=["path", "folder", "size"])

    if root == LOCAL:
        location = re.sub(r"^file:(//)?(?=/)", "", location)
    elif not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", location):
        location = root + "/" + location.lstrip("/")
    level = spark.range(0, 1, 1, 1).select(F.lit(location).alias("path"))
    found = None
    while True:
        listed = materialize(level.mapInArrow(look, schema))
        own = listed.where("not folder").select("path", "size")
        found = own if found is None else found.unionByName(own)
        level = listed.where("folder").select("path")
        n = level.count()
        if not n:
            return found
        level = level.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))


def dealt(files: DataFrame, size_col: str, *by: str) -> DataFrame:
    """``files`` dealt anew: four tasks a core, if there are as many rows, and
    more where a task would get more than ``TASK_BYTES``.  (Rows that name files
    are short; what a task reads is not told by their own bytes.)"""
    n, total = files.agg(F.count("*"), F.sum(size_col)).first()
    tasks = max(1, min(n, 4 * files.sparkSession.sparkContext.defaultParallelism), -(-int(total or 0) // TASK_BYTES))
    return files.repartition(tasks, *by)


def write_files(rows: DataFrame, location: str, name_col: str, line_col: str, spread: bool = False) -> None:
    """Write the rows as text files below ``location``: the consecutive rows of
    a task with one name are the lines of one file (a null is an empty line).

    ``name_col`` is the file's path below ``location``; with ``spread`` the
    files of a task lie in numbered folders, ``task=<task>/<folder>/<name>``, of
    ``FOLDER_FILES`` files at most.  Executors write the
    files themselves through ``pyarrow.fs``, and a file appears under its name
    when it is whole: a task that is run again writes the same files, and the
    driver neither lists nor moves any."""
    root = default_root(rows.sparkSession)

    def write(batches):
        import itertools
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = open_path(location.rstrip("/"), root)
        task = TaskContext.get().partitionId()
        n, made, now, at, stream, draft = 0, None, None, None, None, None

        def close():
            if stream is not None:
                stream.close()
                fs.move(draft, at)

        for batch in batches:
            pairs = zip(batch.column(name_col).to_pylist(), batch.column(line_col).to_pylist())
            for name, group in itertools.groupby(pairs, lambda x: x[0]):
                if name != now or stream is None:
                    close()
                    now, at = name, f"{base}/task={task}/{n // FOLDER_FILES}/{name}" if spread else f"{base}/{name}"
                    folder = at.rpartition("/")[0]
                    if folder != made:
                        fs.create_dir(folder, recursive=True)
                    made, draft, n = folder, f"{folder}/.{uuid.uuid4().hex}", n + 1
                    stream = fs.open_output_stream(draft, compression=None)
                stream.write(b"".join((line or "").encode() + b"\n" for _, line in group))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    def folder(_):
        fs, base = open_path(location.rstrip("/"), root)
        fs.create_dir(base, recursive=True)

    rows.sparkSession.range(0, 1, 1, 1).foreachPartition(folder)
    rows.select(name_col, line_col).mapInArrow(write, "n bigint").agg(F.sum("n")).first()


def read_lines(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """The columns of ``paths`` with ``value``, a line of the file that
    ``path_col`` names; lines without any sign are left out.  Files are read in
    pieces by the task that holds the row."""
    root = default_root(paths.sparkSession)
    names = paths.columns
    schema = T.StructType([*paths.schema.fields, T.StructField("value", T.BinaryType())])

    def read(batches):
        import pyarrow as pa

        def lines(path):
            fs, local = open_path(path, root)
            rest = b""
            with fs.open_input_stream(local) as f:
                while piece := f.read(1 << 20):
                    *whole, rest = (rest + piece).replace(b"\r", b"\n").split(b"\n")
                    yield whole
            yield [rest]

        for batch in batches:
            at, held, size = [], [], 0

            def flush():
                part = batch.take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*names, "value"])

            for i, path in enumerate(batch.column(path_col).to_pylist()):
                for whole in lines(path):
                    some = [line for line in whole if line.strip()]
                    at += [i] * len(some)
                    held += some
                    size += sum(map(len, some))
                    if size > READ_BYTES:
                        yield flush()
                        at, held, size = [], [], 0
            if held:
                yield flush()

    return paths.mapInArrow(read, schema).withColumn("value", F.col("value").cast("string"))


def read_contents(paths: DataFrame, path_col: str = "path", strict: bool = True, under: str | None = None) -> DataFrame:
    """The columns of ``paths`` with ``length``, ``content``, ``present`` of the
    file that ``path_col`` names, opened by the task that holds the row.

    A file outside the folder ``under`` counts as missing.  A batch holds
    ``READ_BYTES`` of contents, or one larger file (2 GB at most, as a row)."""
    root = default_root(paths.sparkSession)
    folder = None if under is None else re.sub(r"^file:(//)?(?=/)", "", under).rstrip("/") + "/"
    own = paths.columns
    schema = T.StructType([*paths.schema.fields, T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
                           T.StructField("present", T.BooleanType())])

    def read(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            start, held, size = 0, [], 0

            def flush(stop):
                part = batch.slice(start, stop - start)
                return pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([None if c is None else len(c) for c in held], pa.int64()),
                     pa.array(held, pa.binary()), pa.array([c is not None for c in held], pa.bool_())], names=[*own, "length", "content", "present"])

            for i, p in enumerate(batch.column(path_col).to_pylist()):
                data = None
                if p is not None and (folder is None or p.startswith(folder)):
                    fs, local = open_path(p, root)
                    if fs.get_file_info(local).type == pafs.FileType.File:
                        with fs.open_input_stream(local) as f:
                            data = f.read()
                if data is None and strict:
                    raise FileNotFoundError(f"missing file: {p}")
                if held and size + len(data or b"") > READ_BYTES:
                    yield flush(i)
                    start, held, size = i, [], 0
                held.append(data)
                size += len(data or b"")
            if held:
                yield flush(batch.num_rows)

    return paths.mapInArrow(read, schema)


def _ordered_lines(spark: SparkSession, location: str, line_sep: str | None = None) -> DataFrame:
    r = spark.read
    if line_sep is not None:
        r = r.option("lineSep", line_sep)
    return r.text(location).select(
        "value",
        strip_scheme(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
    )


def parse_include_line(line: str | Column) -> Column:
    """An includes line to a path: text before the first '#', trimmed;
    null when nothing is left (blank or comment line)."""
    c = F.col(line) if isinstance(line, str) else line
    p = F.regexp_replace(F.substring_index(c, "#", 1), WS, "")
    return F.when(p != "", p)


def scan_includes(spark: SparkSession, location: str) -> DataFrame:
    """#2: ``(source_file, entry_pos, file, full_path)``: one path per line,
    '#' starts a comment, blank lines dropped; ``entry_pos`` counts kept
    lines from 0.  A relative path is completed with the includes file's own
    folder (``full_path``), as documented for includes files."""
    lines = _ordered_lines(spark, location).select(
        "source_file", "_blk", "_mid", parse_include_line("value").alias("file")
    ).where(F.col("file").isNotNull())
    numbered = number_rows(lines, ["_blk", "_mid"], ["source_file"], out="entry_pos")
    folder = F.regexp_replace("source_file", r"/[^/]*$", "")
    return numbered.select("source_file", "entry_pos", "file", complete_path("file", folder).alias("full_path"))


def complete_path(path: str | Column, folder: Column) -> Column:
    """A relative path below ``folder``; absolute ones and URIs as they are."""
    c = F.col(path) if isinstance(path, str) else path
    return F.when(c.startswith("/") | c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), c).otherwise(F.concat(folder, F.lit("/"), c))


def listed_files(spark: SparkSession, location: str) -> DataFrame:
    """``(source_file)`` of the files that a text scan of ``location`` reads;
    names only, from their metadata (files without any byte give no row)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location).select(
        strip_scheme("path").alias("source_file"))


def includes_from_text(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """#2 on a text column: every line of every (whole) text parsed as an
    includes line; ``entry_pos`` numbers the kept lines per ``key``."""
    lines = df.select(key, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    kept = lines.select(key, F.col("line_no").cast("bigint").alias("line_no"),
                        parse_include_line("line").alias("file")).where(F.col("file").isNotNull())
    return number_rows(kept, ["line_no"], [key], out="entry_pos").select(key, "entry_pos", "line_no", "file")


def scan_path_list(spark: SparkSession, location: str, sep: str = "\n") -> DataFrame:
    """#3/#4: a path list, newline- or NUL-separated.

    Newline lists may not contain a NUL byte (the job fails); NUL lists drop
    empty items.  ``(source_file, entry_pos, path)``.
    """
    lines = _ordered_lines(spark, location, None if sep == "\n" else sep)
    if sep == "\n":
        path = F.when(F.instr("value", "\u0000") > 0,
                      F.raise_error(F.lit("NUL byte in a newline-separated path list"))).otherwise(F.col("value"))
        lines = lines.select("source_file", "_blk", "_mid", path.alias("path"))
    else:
        lines = lines.select("source_file", "_blk", "_mid", F.col("value").alias("path")).where(F.col("path") != "")
    numbered = number_rows(lines, ["_blk", "_mid"], ["source_file"], out="entry_pos")
    return numbered.select("source_file", "entry_pos", "path")


def scan_status(spark: SparkSession, run_dir: str) -> DataFrame:
    """#7: marker files ``<run_dir>/<vs_id>/status.<state>`` as
    ``(vs_id, marker)``, listed by the executors.

    One task lists the names of the run folder (names only, no file); they
    are dealt to all tasks, which look into the folders as
    :func:`probe_status` does.  Nothing is listed or kept on the driver."""
    root = default_root(spark)

    def names(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            if not batch.num_rows:
                continue
            fs, base = open_path(run_dir.rstrip("/"), root)
            found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.Directory]
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at:at + 10_000], pa.string())], names=["vs_id"])

    listed = spark.range(0, 1, 1, 1).mapInArrow(names, "vs_id string")
    return _probe(listed.repartition(4 * spark.sparkContext.defaultParallelism), run_dir)


def probe_status(vsteps: DataFrame, run_dir: str) -> DataFrame:
    """#7 by VarStep: ``(vs_id, marker)`` for the ``status.*`` files in each
    VarStep's folder ``<run_dir>/<vs_id>/`` -- the reference's own lookup,
    spread over the executors (each lists the folders of its VarSteps through
    ``pyarrow.fs``); no listing of the whole run folder."""
    return _probe(vsteps.select("vs_id").distinct(), run_dir)


def _probe(folders: DataFrame, run_dir: str) -> DataFrame:
    root = default_root(folders.sparkSession)

    def probe(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        fs, base = open_path(run_dir.rstrip("/"), root)
        for pdf in batches:
            got_vs, got_m = [], []
            for vs in pdf["vs_id"]:
                sel = pafs.FileSelector(f"{base}/{vs}", allow_not_found=True)
                for info in fs.get_file_info(sel):
                    if info.type == pafs.FileType.File and info.base_name.startswith("status."):
                        got_vs.append(vs)
                        got_m.append(info.base_name[len("status."):])
            yield pd.DataFrame({"vs_id": pd.Series(got_vs, dtype=object), "marker": pd.Series(got_m, dtype=object)})

    return folders.mapInPandas(probe, "vs_id string, marker string")


def write_status_markers(markers: DataFrame, run_dir: str) -> None:
    """Create the empty marker files ``<run_dir>/<vs_id>/status.<marker>``.

    Executors create the files themselves (``foreachPartition`` over the
    markers, through ``pyarrow.fs``, which reaches local, HDFS and object
    stores by URI); nothing goes through the driver.
    """
    root = default_root(markers.sparkSession)

    def make(rows):
        fs, base = open_path(run_dir.rstrip("/"), root)
        made = set()
        for r in rows:
            folder = f"{base}/{r['vs_id']}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(f"{folder}/status.{r['marker']}"):
                pass

    markers.select("vs_id", "marker").foreachPartition(make)
