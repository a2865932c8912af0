"""Small files and folders on whatever file system a path names, through Hadoop's file API."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        # a classic session's handles: the Python API has no files of its own, so a remote session cannot open a store
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file whole or not at all; False if it exists, so that of two writers one wins.

        The text is written aside and then takes its name without replacing another: by a hard link on this machine's
        own file system, elsewhere by a rename that refuses to overwrite.
        """
        fs, p = self._at(path)
        aside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        if fs.getUri().getScheme() == "file":
            local = lambda at: self._jvm.org.apache.hadoop.fs.Path(at).toUri().getPath()
            try:
                with open(local(aside), "w", encoding="utf-8") as f:
                    f.write(text)
                    f.flush()
                    os.fsync(f.fileno())
                os.link(local(aside), local(path))
            except FileExistsError:
                return False
            finally:
                if os.path.exists(local(aside)):
                    os.unlink(local(aside))
            return True
        stream = fs.create(self._jvm.org.apache.hadoop.fs.Path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return self._take_name(aside, path)

    def _take_name(self, aside: str, path: str) -> bool:
        """Rename a file, or delete it and give False where the name is taken."""
        fs, p = self._at(path)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            context.rename(self._jvm.org.apache.hadoop.fs.Path(aside), p, how)
        except Exception as e:  # the gateway wraps FileAlreadyExistsException
            if "AlreadyExists" in str(e):
                fs.delete(self._jvm.org.apache.hadoop.fs.Path(aside), False)
                return False
            raise
        return True

    def modified_ms(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime()

    def copy(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        to_fs, to = self._at(target)
        to_fs.mkdirs(to.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to_fs, to, False, self._conf)

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        to_fs, to = self._at(target)
        to_fs.mkdirs(to.getParent())
        if not fs.rename(p, to):
            raise OSError(f"cannot move {source} to {target}")
