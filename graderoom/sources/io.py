"""Readers and writers for sample files, problem files, split lists, fingerprints and reports.

All paths may be any Hadoop-compatible URI. Position-dependent semantics ("line i of a file",
"last duplicate wins") use the scan's file metadata plus a per-split row index, never a
single-partition window or a driver-side loop.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_SCHEMA = "task_id string, completion string, solution string"
PROBLEM_SCHEMA = ("task_id string, prompt string, contract string, canonical_solution string, "
                  "entry_point string, atol double, variant string")


# ---------------------------------------------------------------- position inside files


def with_file_position(df: DataFrame, out: str = "_line") -> DataFrame:
    """Add ``_path`` and the 1-based record number inside its file.

    Rows of one file split are read in order, so (file, split start, monotonically increasing id)
    orders records; per-split counts (one row per split) give each split's offset inside its file.
    Must be applied directly on a file scan."""
    d = df.select("*", F.col("_metadata.file_path").alias("_path"),
                  F.col("_metadata.file_block_start").alias("_block"),
                  F.monotonically_increasing_id().alias("_mid"))
    splits = d.groupBy("_path", "_block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = d.join(splits.select("_path", "_block", "_first", "_offset"), ["_path", "_block"])
    return j.withColumn(out, F.col("_offset") + (F.col("_mid") - F.col("_first")) + 1).drop(
        "_block", "_mid", "_first", "_offset")


# ---------------------------------------------------------------- samples


def read_samples_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """JSON-lines samples (plain or .gz, blank lines skipped). Returns (valid, quarantined): lines that are not JSON
    of the schema (their text in ``_bad_line``) and rows with neither ``completion`` nor ``solution`` are quarantined
    instead of failing the job."""
    raw = spark.read.schema(f"{schema}, _bad_line string").option("columnNameOfCorruptRecord", "_bad_line").json(path)
    ok = F.col("_bad_line").isNull() & (F.col("completion").isNotNull() | F.col("solution").isNotNull())
    return raw.where(ok).drop("_bad_line"), raw.where(~ok)


def sample_identity(samples_scan: DataFrame) -> DataFrame:
    """'<task_id> (line <i> in <file>)' for samples read from JSON-lines files."""
    d = with_file_position(samples_scan)
    return d.withColumn("_identifier", F.concat(
        F.col("task_id"), F.lit(" (line "), F.col("_line").cast("string"), F.lit(" in "), F.col("_path"), F.lit(")")))


def write_samples_jsonl(df: DataFrame, path: str, append: bool = False, drop_builtin: bool = True,
                        gzip: bool = False) -> None:
    cols = [c for c in df.columns if not (drop_builtin and c.startswith("_"))]
    w = df.select(*cols).write.mode("append" if append else "overwrite")
    if gzip:
        w = w.option("compression", "gzip")
    w.json(path)


def read_samples_dir(spark: SparkSession, path: str) -> DataFrame:
    """Folder of ``<task>/<n>.py`` files: one row per file, '_' in the folder name means '/'. Spark's file
    listing passes over empty files, so an empty sample has no row and counts as missing."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
    p = F.col("_metadata.file_path")
    return raw.select(
        F.replace(F.regexp_extract(p, r"([^/]+)/[^/]+\.py$", 1), F.lit("_"), F.lit("/")).alias("task_id"),
        F.regexp_extract(p, r"/([^/]+)\.py$", 1).cast("int").alias("n"),
        F.col("value").alias("solution"),
        p.alias("_identifier"),
    )


def _write_files(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        filesystem, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            paths = []
            for task, n, text in zip(b["task_id"], b["n"], b["solution"]):
                rel = f"{task.replace('/', '_')}/{int(n)}.py"
                target = f"{base.rstrip('/')}/{rel}"
                filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.part-{uuid.uuid4().hex}"  # a task that dies leaves no half file under the final name
                with filesystem.open_output_stream(part) as fh:
                    fh.write((text or "").encode("utf-8"))
                filesystem.move(part, target)
                paths.append(rel)
            yield pd.DataFrame({"task_id": b["task_id"], "n": b["n"], "path": paths})

    return run


def write_samples_by_task(df: DataFrame, root: str, manifest: str, order: str = "_order") -> DataFrame:
    """Number samples 0..n-1 within their task (skew-safe indexing) and write each as
    ``<task>/<n>.py`` under ``root``; the list of written files is saved at ``manifest``."""
    from graderoom.operators.ranking import index_within

    numbered = index_within(df, "task_id", order, "n")
    written = numbered.select("task_id", "n", "solution").mapInPandas(
        _write_files(root), "task_id string, n long, path string")
    written.write.mode("overwrite").parquet(manifest)
    return df.sparkSession.read.parquet(manifest)


# ---------------------------------------------------------------- problems and splits


def load_problems(spark: SparkSession, path: str, schema: str = PROBLEM_SCHEMA) -> DataFrame:
    """Problem table keyed by task id; when a task id repeats, the last record in file order wins."""
    raw = with_file_position(spark.read.schema(schema).json(path))
    cols = [c for c in raw.columns if not c.startswith("_")]
    latest = raw.groupBy("task_id").agg(
        F.max_by(F.struct(*[c for c in cols if c != "task_id"]), F.struct("_path", "_line")).alias("p"))
    return latest.select("task_id", "p.*")


def resolve_variant(problems: DataFrame, dataset: str = "humaneval", mini: bool = False,
                    noextreme: bool = False) -> DataFrame:
    """Pick the dataset variant; on a table partitioned by ``variant`` this is partition pruning."""
    if mini and noextreme:
        raise ValueError("Mini and NoExtreme are exclusive")
    if mini and dataset == "mbpp":
        raise ValueError("MBPP has no Mini variant")
    chosen = "mini" if mini else "noextreme" if noextreme else "full"
    return problems.where(F.col("variant") == chosen)


def dataset_fingerprint(df: DataFrame, cols: Sequence) -> DataFrame:
    """Order-insensitive fingerprint of a table with its repeated rows: the md5 of each row is read as four 32-bit
    numbers, each is summed over all rows, and the sums and the row count are hashed. Sums merge in any
    order, so every partition sends one row and no list of hashes exists. An empty table has a fingerprint too."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("<null>")) for c in cols]
    rows = df.select(F.md5(F.concat_ws("\x1f", *parts)).alias("h"))
    words = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(28,0)") for i in range(4)]
    zero = F.lit(0).cast("decimal(38,0)")
    sums = rows.agg(*[F.coalesce(F.sum(w), zero).alias(f"s{i}") for i, w in enumerate(words)], F.count(F.lit(1)).alias("n_rows"))
    text = F.concat_ws(":", *[F.col(f"s{i}").cast("string") for i in range(4)], F.col("n_rows").cast("string"))
    return sums.select(F.md5(text).alias("fingerprint"), "n_rows")


def export_split_ids(ids: DataFrame, path: str, key: str = "task_id") -> None:
    """Write a split as one JSON array of ids in numeric order of the number after '/' (a split file is
    one document; its size is bounded by the number of tasks)."""
    num = F.split(F.col(key), "/").getItem(1).cast("long")
    ids.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(num.alias("n"), F.col(key).alias("id")))),
                                  lambda s: s["id"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ids (a bare string is wrapped into a one-element list) -> one row per id."""
    raw = spark.read.text(path, wholetext=True)
    v = F.trim(F.col("value"))
    arr = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(
        F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"))
    return raw.select(F.explode(arr).alias("task_id"))


def load_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Model fingerprints (parquet, one folder per model); vectors cast to float32; fails when no
    fingerprint exists or dimensions differ."""
    fps = spark.read.parquet(path).select("model_identifier", F.col("embedding").cast("array<float>").alias("embedding"))
    stats = fps.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("embedding")).alias("dims")).first()
    if stats["n"] == 0:
        raise ValueError("no fingerprints found")
    if stats["dims"] > 1:
        raise ValueError("fingerprints have different dimensions")
    return fps


# ---------------------------------------------------------------- reports and selections


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to a name that must be free; on file systems with atomic renames one of two writers wins."""
    fs, p = _filesystem(spark, target)
    fs.mkdirs(p.getParent())
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(source)), fs.makeQualified(p), none)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            raise FileExistsError(f"{target} is there already") from None
        raise


def _commit(rows: DataFrame, root: str, name: str, existing: str = "refuse") -> str:
    """Writes rows beside ``root/name`` and moves them there when they are whole, so that a failed or
    repeated write leaves nothing a reader sees. What is there already is refused, reused (nothing is written) or
    moved to ``root/_backup/name/<n>``, n counting up. Returns the folder."""
    if existing not in ("refuse", "reuse", "backup"):
        raise ValueError(f"existing is refuse, reuse or backup, not {existing}")
    spark, root = rows.sparkSession, root.rstrip("/")
    target = f"{root}/{name}"
    if _exists(spark, target):
        if existing == "reuse":
            return target
        if existing == "refuse":
            raise FileExistsError(f"{name} is already in {root}")
    staged = f"{root}/_staged/{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    if existing == "backup" and _exists(spark, target):
        fs, p = _filesystem(spark, f"{root}/_backup/{name}")
        taken = [int(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []
        _rename(spark, target, f"{root}/_backup/{name}/{max(taken, default=0) + 1}")
    _rename(spark, staged, target)
    return target


def write_eval_report(rows: DataFrame, root: str, run_id: str, existing: str = "refuse") -> DataFrame:
    """Adds one run under ``run_id=<id>`` in one move. A run that is there already is refused, reused as it is, or
    moved to the backups (``existing``). Returns the run's rows."""
    _commit(rows, root, f"run_id={run_id}", existing)
    return rows.sparkSession.read.parquet(root).where(F.col("run_id") == run_id)


def read_report_backups(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Earlier versions of a run with their number, 1 being the oldest."""
    base = f"{root.rstrip('/')}/_backup/run_id={run_id}"
    version = F.regexp_extract(F.col("_metadata.file_path"), r"/_backup/run_id=[^/]*/([0-9]+)/[^/]*$", 1).cast("int")
    return spark.read.parquet(f"{base}/*").select("*", version.alias("version"))


def export_pass_at_k_json(pass_at_k: DataFrame, path: str) -> None:
    """pass@k as JSON maps: {suite: {"pass@k": value}} per model."""
    m = pass_at_k.groupBy("model", "suite").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("pass@"), F.col("k").cast("string")), F.col("pass_at_k")))).alias("scores"))
    m.select("model", F.to_json(F.create_map("suite", "scores")).alias("pass_at_k")).write.mode("overwrite").json(path)


def write_selection(models: DataFrame, path: str, rank: str = "rank", key: str = "model_identifier") -> None:
    """Ordered model list as text, one identifier per line (K lines, one file)."""
    models.orderBy(rank).select(key).coalesce(1).write.mode("overwrite").text(path)


def load_selection(spark: SparkSession, path: str) -> DataFrame:
    """Lines trimmed, blank lines dropped, ranked in file order."""
    raw = with_file_position(spark.read.text(path))
    kept = raw.select(F.trim("value").alias("model_identifier"), "_path", "_line").where(F.col("model_identifier") != "")
    w = Window.orderBy("_path", "_line")  # a selection file holds K lines
    return kept.select(F.row_number().over(w).alias("rank"), "model_identifier")


def write_provenance(rows: DataFrame, root: str, run_id: str, step: int | None = None) -> DataFrame:
    """Per-sample provenance (prompt, refinement prompt, raw output) of a run, each step under
    run_id=<id>/step=<n>. With ``step`` the rows are those of one step (without a column of it), written when it
    ends; a step that is there is refused. Without, all steps are written at once by their
    column ``step`` and the run must be new. Returns the run's rows of all steps."""
    spark, name = rows.sparkSession, f"run_id={run_id}"
    if step is not None:
        _commit(rows.drop("step"), root, f"{name}/step={int(step)}")
    else:
        if _exists(spark, f"{root.rstrip('/')}/{name}"):
            raise FileExistsError(f"{name} is already in {root}")
        staged = f"{root.rstrip('/')}/_staged/{uuid.uuid4().hex}"
        rows.write.partitionBy("step").parquet(staged)
        _rename(spark, staged, f"{root.rstrip('/')}/{name}")
    return spark.read.parquet(root).where(F.col("run_id") == run_id)


def upgrade_legacy_report(df: DataFrame) -> DataFrame:
    """Old rows carry a ``files`` list and no ``nfiles``: nfiles = len(files)."""
    return df.withColumn("nfiles", F.coalesce(F.col("nfiles"), F.size("files"))).drop("files")
