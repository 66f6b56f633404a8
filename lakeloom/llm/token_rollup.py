"""Token counts as additive totals that are maintained by signed deltas."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeloom.llm.text import SOLID, Texts, in_batches, lean

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts texts before byte pairs are merged; it belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["docs", "chars", "tokens"]
_ENTRY = "doc_id long, source string, lang string, tokenizer string, docs long, chars long, tokens long"


def byte_pairs(path: str = TOKENIZER_FILE) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file, read on the driver."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def count_tokens(docs: DataFrame, versions: dict[str, dict[bytes, int] | None]) -> DataFrame:
    """One entry per document and tokenizer version: docs 1, chars (code points) and tokens.
    A version without ranks counts words without white space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        made = {v: ranks and tiktoken.Encoding(v, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) for v, ranks in versions.items()}
        for batch in batches:
            texts = Texts.of(batch.column(3))
            chars = np.array([int(np.count_nonzero(np.frombuffer(texts.raw[a:b], np.uint8) & 0xC0 != 0x80)) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)], np.int64)
            for version, encoding in made.items():
                if encoding is None:
                    n = np.concatenate([np.diff(rows.spans(SOLID)[2]) for _, rows in texts.chunks()])
                else:
                    n = np.array([len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(3).to_pylist()], np.int64)
                one = np.ones(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([version] * len(n)), pa.array(one), pa.array(chars), pa.array(n.astype(np.int64))], names=["doc_id", "source", "lang", "tokenizer", "docs", "chars", "tokens"])

    return in_batches(docs).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(lean(task), _ENTRY)


@dataclass(frozen=True)
class Commit:
    """An entry of the log: the folder of a batch, or of a compaction."""

    version: int
    batch: str
    folder: str
    compacts: bool


class TokenRollup:
    """Totals of docs, chars and tokens by source, lang and tokenizer version, kept in a folder
    that all executors share.

    A batch writes signed entries, one per document and version, into a folder of its own: an
    insert adds, a delete takes away what the document's entries add up to now, a revision does
    both.  Their sums are the batch's delta.  The batch counts once its entry is in the log: a file
    with the next number, written aside and then renamed, which fails where another run has that
    number (the file system's rename has to be atomic, as HDFS's is).  A run that died before leaves nothing that is read, and one that died at any moment
    leaves no half-written entry.  Who loses a number looks at what came in between: the same batch
    is done; a batch that only inserts takes the next number; one that deletes or revises works out
    its entries anew, so that two batches that delete one document take it away once.

    ``compact`` sums up what the log holds: readers start from its folder and read later batches only.
    """

    def __init__(self, spark: SparkSession, path: str, versions: dict[str, dict[bytes, int] | None]):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), versions

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _append(self, entry: Commit) -> bool:
        """Adds an entry to the log; False if there is one of this number."""
        jvm = self.spark._jvm
        fs, aside = self._fs(f"aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(asdict(entry)).encode()))
        out.close()
        _, final = self._fs(f"log/{entry.version:012d}.json")
        fs.mkdirs(final.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # an existing file is an error
        try:
            files.rename(aside, final, keep)
        except Exception:  # noqa: BLE001  it exists: another run was first
            if fs.exists(final):
                return False
            raise
        finally:
            fs.delete(aside, False)
        return True

    def log(self) -> list[Commit]:
        """The entries that count: the last compaction and what came after it, in order, read at once.
        Marks tell which entries need not be read; without them more are read."""
        fs, p = self._fs("log")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        mark = max((x.removesuffix(".mark") for x in names if x.endswith(".mark")), default="")
        paths = [f"{self.path}/log/{x}" for x in names if x.endswith(".json") and x.removesuffix(".json") >= mark]
        rows = self.spark.read.text(paths, wholetext=True).collect() if paths else []
        found = sorted((Commit(**json.loads(r.value)) for r in rows), key=lambda c: c.version)
        return found[max((i for i, c in enumerate(found) if c.compacts), default=0) :]

    def _batches(self, log: list[Commit]) -> set[str]:
        """The batches among the log's entries, without those that a compaction has taken in."""
        return {c.batch for c in log if not c.compacts}

    def _done(self, batch_id: str, log: list[Commit]) -> bool:
        if batch_id in self._batches(log):
            return True
        base = [c for c in log if c.compacts]
        return bool(base) and not self.spark.read.schema("batch string").parquet(f"{self.path}/{base[0].folder}/batches").where(F.col("batch") == batch_id).isEmpty()

    def _read(self, kind: str, log: list[Commit]) -> DataFrame:
        paths = [f"{self.path}/{c.folder}/{kind}" for c in log]
        schema = _ENTRY if kind == "entries" else _ENTRY.partition(", ")[2]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, log: list[Commit] | None = None) -> DataFrame:
        """What each document adds to the totals now."""
        sums = [F.sum(c).alias(c) for c in TOTALS]
        entries = self._read("entries", self.log() if log is None else log)
        return entries.groupBy("doc_id", *KEYS).agg(*sums).where("docs <> 0 OR chars <> 0 OR tokens <> 0")

    def _write(self, entries: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        entries.write.parquet(f"{self.path}/{folder}/entries")
        written = self.spark.read.schema(_ENTRY).parquet(f"{self.path}/{folder}/entries")
        self._sums(written).write.parquet(f"{self.path}/{folder}/delta")
        return folder

    def commit(self, batch_id: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Applies a batch: rows to insert, doc_ids to delete, rows that replace documents.  False,
        and no change, if a batch of this id is committed already."""
        gone = [x.select(F.col("doc_id").cast("long")) for x in (deletes, revisions) if x is not None]
        fresh = [count_tokens(x, self.versions) for x in (inserts, revisions) if x is not None]
        if not gone and not fresh:
            raise ValueError("a batch has inserts, deletes or revisions")
        folder = None
        while True:
            log = self.log()
            if self._done(batch_id, log):
                return False
            if folder is None or gone:
                entries = list(fresh)
                if gone:
                    ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
                    old = self.current(log).join(ids.distinct(), "doc_id", "left_semi")
                    entries.append(old.select("doc_id", *KEYS, *[(-F.col(c)).alias(c) for c in TOTALS]))
                folder = self._write(reduce(DataFrame.unionByName, entries))
            version = log[-1].version + 1 if log else 0
            if self._append(Commit(version, batch_id, folder, False)):
                return True

    def compact(self) -> bool:
        """Sums up all that is committed into one folder; False if nothing is or a batch came in between."""
        log = self.log()
        if not log:
            return False
        folder = self._write(self.current(log))
        names = self.spark.createDataFrame([(b,) for b in sorted(self._batches(log))], "batch string")
        before = [c for c in log if c.compacts]
        if before:
            names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/{before[0].folder}/batches"))
        names.write.parquet(f"{self.path}/{folder}/batches")
        entry = Commit(log[-1].version + 1, "", folder, True)
        if not self._append(entry):
            return False
        fs, mark = self._fs(f"log/{entry.version:012d}.mark")
        fs.create(mark, True).close()
        return True

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, chars, tokens of what is there now; groups that deletes
        have emptied are left out.  Null sources and languages are groups."""
        return self._sums(self._read("delta", self.log())).where("docs <> 0 OR chars <> 0 OR tokens <> 0")


def token_totals(docs: DataFrame, path: str, tokenizer_file: str = TOKENIZER_FILE, batch_id: str = "load") -> DataFrame:
    """Loads all of ``docs`` as one batch, runs the batch again as a restarted job would (which
    changes nothing), and returns the totals.  Null texts have 0 chars and tokens; rows that
    repeat a doc_id each count; other columns are ignored; an empty table gives no rows."""
    rollup = TokenRollup(docs.sparkSession, path, {"words-1": None, "byte-bpe-50k": byte_pairs(tokenizer_file)})
    rollup.commit(batch_id, inserts=docs)
    rollup.commit(batch_id, inserts=docs)
    return rollup.totals()

