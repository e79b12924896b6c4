"""Token ids as flat binary files, written and read by Spark tasks.

A folder holds, for every partition of the documents in ascending doc_id order, `*.bin` (unsigned little-endian ids
of 16 bits if the vocabulary has at most 65,536 tokens, else of 32, one document after the other, each closed by the
end id) and `*.idx` (64-bit little-endian: the number of
documents n, n + 1 offsets within the file, n doc_ids, n flags that are 1 for a null doc_id), and one table `manifest`
(part, name, width in bytes, n_docs, n_tokens, base). The base of a partition, the number of ids before it, is a prefix sum over the
partitions' totals; base + offset is a document's place in the whole sequence. Files are memory-mapped where their
folder is local, else read by the file system's own calls.

File names carry a random part and count only if the manifest lists them, so a repeated or lost task leaves nothing that
is read. Ids come from the tokenizers library, called once for each distinct piece of text a worker meets. Null and
empty texts hold the end id alone; null doc_ids come first; rows of one doc_id are ordered by their text's hash;
repeated rows are written each. An empty table gives an empty manifest. Other columns are not written.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotrail.llm.bpe import Encoder, Vocabulary, vocabulary_file
from echotrail.llm.common import crc, settled, small_batches

MANIFEST = "part int, name string, width int, n_docs long, n_tokens long"
#: Pieces handed to the library at once, and pieces whose tokens a worker keeps.
GROUP, KEPT = 48, 1_000_000


class LibraryEncoder(Encoder):
    """Token ids by the tokenizers library, for pieces not seen before."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        super().__init__(Vocabulary(file), KEPT)
        self.widths = np.array([len(t) for t in self.v.tokens])

    def learn(self) -> None:
        """Tokens of new pieces: runs of pieces that cannot merge go to the library as one text and are cut by bytes."""
        new = self.known.new
        if not new:
            return
        texts, run, special = [], [], {i: t for t, i in self.v.special.items()}
        for x in new:
            if not isinstance(x, int) and x[:1] == " " and not x[-1:].isspace():
                run.append(x)
                if len(run) < GROUP:
                    continue
                x = ""
            texts.append("".join(run))
            texts.append(special[x] if isinstance(x, int) else x)
            run = []
        texts.append("".join(run))
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.uint32)
        sizes = [len(self.v.tokens[x]) if isinstance(x, int) else len(x) if x.isascii() else len(x.encode("utf-8", "replace")) for x in new]
        places, ends = self.widths[ids].cumsum(), np.array(sizes).cumsum()
        counts = np.searchsorted(places, ends, "right")
        if len(ids) and not (places[counts[counts > 0] - 1] == ends[counts > 0]).all():
            raise AssertionError("a token crosses two pieces")
        self.starts.frombytes((counts + len(self.flat)).astype("<i8").tobytes())
        self.flat.frombytes(ids.tobytes())
        new.clear()


@lru_cache(1)
def library_encoder(file: str) -> LibraryEncoder:
    return LibraryEncoder(file)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI; a bare path is local."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> None:
    """Writes (doc_id, text) rows as token files with a manifest below `folder`, a place all executors share."""
    file = vocabulary_file(path)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        coder, part = library_encoder(file), TaskContext.get().partitionId()
        system, base = opened(folder)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}"
        ids, nulls, counts, out = [], [], [], None
        width = 2 if max(len(coder.v.tokens) - 1, end_id) < 1 << 16 else 4
        for batch, texts in small_batches(batches, "text"):
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{name}.bin")
            flat, n = coder.encode(texts)
            out.write(np.insert(flat.astype(f"<u{width}"), np.cumsum(n), end_id).tobytes())
            column = batch.column("doc_id")
            nulls.append(column.is_null().to_numpy(zero_copy_only=False).astype("<i8"))
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            counts.append(n + 1)
        if out is not None:
            out.close()
            counts = np.concatenate(counts)
            parts = [[len(counts)], [0], np.cumsum(counts), *ids, *nulls]
            with system.open_output_stream(f"{base}/{name}.idx") as index:
                index.write(np.concatenate(parts).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "width": pa.array([width], pa.int32()), "n_docs": [len(counts)],
                                              "n_tokens": [int(counts.sum())]})

    totals = settled(rows.mapInArrow(run, MANIFEST), "token-file-totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    totals.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")


def mapped(system: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array of numbers: memory-mapped if it is local."""
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of all documents, from the files of a folder."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.count()

    def run(batches):
        system, base = opened(folder)
        for batch in batches:
            for name, width, first in zip(*[batch.column(c).to_pylist() for c in ("name", "width", "base")], strict=True):
                index = mapped(system, f"{base}/{name}.idx", "<i8")
                n = int(index[0])
                ends, ids, nulls = index[1:n + 2], index[n + 2:2 * n + 2], index[2 * n + 2:]
                tokens = mapped(system, f"{base}/{name}.bin", f"<u{width}")
                sums = [crc(tokens[a:b].astype("<u4")) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ids), pa.int64(), mask=np.array(nulls, bool)), pa.array(first + ends[:-1]),
                     pa.array(np.diff(ends)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("name", "width", "base").repartition(max(1, files)).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
