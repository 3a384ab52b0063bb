"""A manifest that is written to by many: records are upserted by document, in versions that appear as a whole.

A version is a Parquet folder and a pointer file `log/<number>` that names it. A writer lays its version down under a name of
its own and then claims the next number; a claim succeeds for one writer only, and who comes too late merges
with what is there by then and tries again. Written twice under one token, records count once.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.sources.artefacts import MANIFEST, upserted


class ManifestStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        log = self.path(f"{self.folder}/log")
        names = [x.getPath().getName() for x in self.fs.listStatus(log)] if self.fs.exists(log) else []
        return sorted(int(x) for x in names if x.isdigit())

    def _claim(self, number: int, content: str) -> bool:
        """Give a version its number; False if another has it. The pointer appears with its content, or not at all."""
        draft, target = f"{self.folder}/draft-{uuid.uuid4().hex}", f"{self.folder}/log/{number}"
        self.fs.mkdirs(self.path(f"{self.folder}/log"))
        out = self.fs.create(self.path(draft), False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a rename replaces what is there, a link doesn't
                local = self.path(draft).toUri().getPath()
                os.link(local, self.path(target).toUri().getPath())
                return True
            return not self.fs.exists(self.path(target)) and bool(self.fs.rename(self.path(draft), self.path(target)))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self.path(draft), False)

    def read(self, number: int | None = None) -> DataFrame:
        """The records of a version, the last one if none is given; no records before the first."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], MANIFEST)
        name = self._text(f"{self.folder}/log/{number or versions[-1]}").split("\n")[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/{name}")

    def upsert(self, records: DataFrame, token: str, attempts: int = 20) -> int:
        """Write records (one of each document, the newest, counts) and return the number of the version that holds them.

        A token that a version was written under is not written again, so a repeated call changes nothing. Of
        two records of a document the one updated later stays, of equally old ones the one written later.
        """
        new = records.select(*[x.split()[0] for x in MANIFEST.split(", ")]).filter("document IS NOT NULL")
        for _ in range(attempts):
            versions = self._versions()
            for n in reversed(versions):
                if self._text(f"{self.folder}/log/{n}").split("\n")[1] == token:
                    return n
            last = versions[-1] if versions else 0
            name = f"version-{last + 1}-{uuid.uuid4().hex}"
            upserted(self.read(last) if versions else self.read(), new).write.parquet(f"{self.folder}/{name}")
            if self._claim(last + 1, f"{name}\n{token}"):
                return last + 1
            self.fs.delete(self.path(f"{self.folder}/{name}"), True)
        raise RuntimeError(f"the manifest changed {attempts} times while it was written")

    def expire(self, keep: int = 2) -> None:
        """Remove the data of all but the last versions; their pointers stay, so their tokens are still known."""
        for n in self._versions()[:-keep]:
            name = self._text(f"{self.folder}/log/{n}").split("\n")[0]
            self.fs.delete(self.path(f"{self.folder}/{name}"), True)


def manifest_records(inspected: DataFrame, previous: DataFrame) -> DataFrame:
    """Records of inspected documents: what was found now, with the error of the record before where none is new.

    inspected has document, input_path, hashes, statuses, sections (array of codes, or null), document_kind and images (array of file names).
    """
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    png: Column = F.filter("images", lambda x: F.lower(x).endswith(".png"))
    plain = (F.col("document_kind") == "non-hs-reference") | (count("sections") <= 0)
    before = previous.select(F.col("document").alias("_document"), F.col("error").alias("_error"))
    d = inspected.join(before, F.col("document") == F.col("_document"), "left")
    return d.select(
        "document", "input_path", "input_hash", "markdown_hash", "sections_hash", "tree_source_markdown_hash", "parse_status", "page_index_status",
        F.when(F.coalesce(plain, count("sections") <= 0), "non-hs-reference").otherwise("hs-chapter").alias("document_type"),
        F.greatest(count("sections"), F.lit(0)).cast("int").alias("hs_section_count"), F.greatest(count(png), F.lit(0)).cast("int").alias("image_count"),
        F.coalesce("error", "_error").alias("error"), "updated_at",
    )
