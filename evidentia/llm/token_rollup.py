"""Token totals by source, language and tokenizer version, kept up to date by signed batches that count once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm.bpe import batches, byte_encoder, word_encoder
from evidentia.llm.shared import by_id, materialize, python_workers, vocabulary

KEYS = ("source", "lang", "version")
#: Tokenizer versions: public vocabularies of the tokenizers library.
VERSIONS = ("byte_bpe_50k", "word_bpe_49k")
#: A folder's name.
_NAME = "[0-9a-f]{32}"
_DELTAS = "source string, lang string, version string, d_docs long, d_tokens long"


def count_tokens(rows: DataFrame, text: str = "text", paths: dict[str, str] | None = None) -> DataFrame:
    """``rows`` without ``text``, plus one column of token counts a version (``paths``: version -> vocabulary file).

    Columns of ``rows`` named like a version are replaced; no other name clashes. Counts are those of the tokenizers library without special tokens added; null and empty texts have none. Whole texts are encoded, in slices
    of about a megabyte; nothing is shuffled.
    """
    paths = paths or {v: vocabulary(f"{v}.json") for v in VERSIONS}
    python_workers(rows.sparkSession)
    kept = [c for c in rows.columns if c != text and c not in paths]
    schema = rows.select(*kept).schema
    held_as = "_text" + "_" * max((len(c) for c in kept), default=0)
    for v in paths:
        schema = schema.add(v, "long")

    def run(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {v: word_encoder(p) if v.startswith("word") else byte_encoder(p) for v, p in paths.items()}
        for batch, texts in batches(held, held_as):
            counts = []
            for tool in tools.values():
                counts.append(pa.array([len(x) // (4 if isinstance(x, bytes) else 1) for x in tool.encode(texts)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], [*kept, *tools])

    return rows.select(*kept, F.col(text).cast("binary").alias(held_as)).mapInArrow(run, schema)


def deltas(changes: DataFrame) -> DataFrame:
    """(source, lang, version, d_docs, d_tokens) of change rows (op, source, lang, version, n_tokens, old_tokens).

    insert adds a document and its tokens, delete takes both away, revise adds the new count minus the old one. A null count is 0, a null key
    is a group of its own, another op is an error. Rows are combined before the exchange, so a source with a third of all rows is no hot spot.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("d_docs"), F.sum(tokens).cast("long").alias("d_tokens"))


class Rollup:
    """Additive totals under ``path``.

    data/<name> holds the deltas of one attempt at a batch; commits/<batch id> is a small file with the one name that counts. An attempt writes its data
    first, then that file under another name (pending/<name>), and renames it, which does not replace a file that is there. So a commit file is there with
    all its content or not at all, and whoever commits a batch a second time, also at the same moment, changes nothing: a batch has one file, and a file
    names one folder. A commit file without a whole name (of a writer that did not rename) is no commit, and the next attempt replaces it. ``compact``
    sums what is committed into one folder under data and writes the batches in it to batches/<same name>; snapshots/<number> names that folder. Totals read the
    last snapshot and the commits after it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, path: str) -> str:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _whole(self, path: str) -> bool:
        """Whether there is a file with the whole name of a folder."""
        p, fs = self._fs(path)
        return fs.exists(p) and bool(re.fullmatch(_NAME, self._read(path)))

    def _create(self, path: str, name: str) -> bool:
        """A file at ``path`` with ``name``; False if there is a whole one already."""
        jvm = self.spark._jvm
        if self._whole(path):
            return False
        source, fs = self._fs(f"pending/{name}")
        stream = fs.create(source, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        target, _ = self._fs(path)
        fs.mkdirs(target.getParent())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if fs.exists(target) and not self._whole(path) else rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, how)
        except Exception as x:
            fs.delete(source, False)
            if "exist" in str(x):
                return False
            raise
        return self._read(path) == name

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` as batch ``batch_id``; False, and no change, if that batch is there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._whole(f"commits/{batch_id}"):
            return False
        name = self._write(deltas(changes))
        if self._create(f"commits/{batch_id}", name):
            return True
        folder, fs = self._fs(f"data/{name}")
        fs.delete(folder, True)
        return False

    def _snapshot(self) -> str:
        """The folder of the last whole snapshot; '' if there is none."""
        for number in reversed(self._names("snapshots")):
            if self._whole(f"snapshots/{number}"):
                return self._read(f"snapshots/{number}")
        return ""

    def _commits(self, snapshot: str) -> DataFrame:
        """(batch, folder) of the commits that are not in the snapshot: their files are read as one table."""
        if not self._names("commits"):
            return self.spark.createDataFrame([], "batch string, folder string")
        files = self.spark.read.schema("value string").text(f"{self.path}/commits", wholetext=True)
        found = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("batch"), F.col("value").alias("folder")).filter(F.col("folder").rlike(f"^{_NAME}$"))
        return found.join(self.spark.read.schema("batch string").parquet(f"{self.path}/batches/{snapshot}"), "batch", "left_anti") if snapshot else found

    def _sources(self, snapshot: str) -> list[str]:
        """The folders that make up the totals: the snapshot's, and one for each batch committed since."""
        return [snapshot] * bool(snapshot) + sorted(r["folder"] for r in self._commits(snapshot).select("folder").collect())

    def _sums(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in folders]
        rows = self.spark.read.schema(_DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def compact(self) -> None:
        """Sum all committed batches into one snapshot. Two compactions at once are harmless: one of them makes the next snapshot."""
        last = self._snapshot()
        new = [(r["batch"], r["folder"]) for r in self._commits(last).collect()]
        if not new:
            return
        name = self._write(self._sums([last] * bool(last) + sorted(folder for _, folder in new)))
        batches = self.spark.createDataFrame([(b,) for b, _ in new], "batch string")
        if last:
            batches = batches.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/batches/{last}"))
        batches.write.parquet(f"{self.path}/batches/{name}")
        self._create(f"snapshots/{len(self._names('snapshots')):09d}", name)

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches; groups that came to nothing are left out."""
        sums = self._sums(self._sources(self._snapshot()))
        return sums.withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"}).filter("n_docs <> 0 OR n_tokens <> 0")


def document_changes(docs: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Batch id -> change rows: every document under each tokenizer version, then revised counts of documents labelled as low quality (runs of
    white space count as one blank), then the deletion of those labelled toxic, with the counts they have by then.

    Every row of ``docs`` counts, repeated ones too. Of repeated labels the strictest counts; null ids have none."""
    own = docs.select("doc_id", "source", "lang", "text")
    counted = materialize(count_tokens(own), "token-counts")
    known = materialize(labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")), "marks")
    marked = materialize(counted.join(known, "doc_id"), "marked")
    # Texts are picked by id, which is broadcast up to a bound, so they are not exchanged; marks are joined to the counts.
    low = by_id(own, materialize(known.filter("quality = 0").select("doc_id"), "low-ids"), "doc_id").withColumn("squeezed", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    both = low.select("doc_id", "source", "lang", F.explode(F.array(F.struct(F.lit(False).alias("new"), F.col("text").alias("t")), F.struct(F.lit(True).alias("new"), F.col("squeezed").alias("t")))).alias("v"))
    counts = count_tokens(both.select("doc_id", "source", "lang", F.col("v.new").alias("new"), F.col("v.t").alias("text")))
    revised = materialize(materialize(counts, "low-counts").join(known.select("doc_id", "toxic"), "doc_id"), "revised-counts")
    none = F.lit(None).cast("long")

    def rows(df: DataFrame, op: str, n: str = "", old: str = "") -> DataFrame:
        one = F.array(*(F.struct(F.lit(v).alias("version"), (F.col(v) if n else none).alias("n_tokens"), (F.col(v) if old else none).alias("old_tokens")) for v in VERSIONS))
        return df.select(F.lit(op).alias("op"), "source", "lang", F.explode(one).alias("x")).select("op", "source", "lang", "x.*")

    return {
        "0-insert": rows(counted, "insert", n="new"),
        "1-revise": rows(revised.filter("new"), "revise", n="new").unionByName(rows(revised.filter("NOT new"), "revise", old="old")),
        "2-delete": rows(marked.filter("toxic = 1 AND coalesce(quality, 1) <> 0"), "delete", n="new").unionByName(rows(revised.filter("new AND toxic = 1"), "delete", n="new")),
    }
