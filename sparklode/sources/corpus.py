"""Corpus scan: a Python data source over source trees.

``binaryFile`` hides names that start with ``_`` or ``.``, which would lose
``__init__.py``; so the tree is listed here. Only the upper ``depth`` levels
are listed when the scan is planned; each directory found there becomes a
partition that walks the rest and reads file bytes on an executor. Ignored
directories are pruned on the way down, links to directories are not followed. A
file that cannot be read comes as a row with NULL content and an ``error``, so it is
not taken for a deleted one; a folder that cannot be listed fails the scan. Paths may be local (a folder every
executor sees) or any URI that pyarrow's file systems know.

    spark.dataSource.register(CorpusSource)
    spark.read.format("corpus").option("path", root).load()

Options: path, repo_id (default: last path component), depth (1), content
(true; false lists only), exclude_tests (true), extensions (comma list),
max_bytes (0 = no limit).
"""

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparklode import model as M


class _Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive


class CorpusSource(DataSource):
    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return M.SCANNED_FILES

    def reader(self, schema):
        return _CorpusReader(dict(self.options))


class _CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.repo = options.get("repo_id") or self.root.rsplit("/", 1)[-1]
        self.depth = int(options.get("depth", 1))
        self.content = options.get("content", "true").lower() == "true"
        self.skip_tests = options.get("exclude_tests", "true").lower() == "true"
        self.extensions = tuple(
            e for e in options.get("extensions", ",".join(M.SOURCE_EXTENSIONS)).split(",") if e)
        self.max_bytes = int(options.get("max_bytes", M.MAX_FILE_BYTES))

    def _open(self):
        from pyarrow import fs
        if "://" in self.root:
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), self.root

    def _list(self, store, folder: str):
        """(kept sub-folders, kept files) of one folder, sorted."""
        from pyarrow import fs
        found = store.get_file_info(fs.FileSelector(folder))
        local = isinstance(store, fs.LocalFileSystem)
        dirs = [f.path for f in found if f.type == fs.FileType.Directory
                and not (local and os.path.islink(f.path))
                and f.base_name not in M.IGNORED_DIRS and not f.base_name.startswith(".")
                and not (self.skip_tests and f.base_name.lower() in M.TEST_DIRS)]
        files = [f for f in found if f.type == fs.FileType.File and self._keep(f)]
        return sorted(dirs), sorted(files, key=lambda f: f.path)

    def _keep(self, f) -> bool:
        stem, dot, ext = f.base_name.rpartition(".")
        if not stem.strip("."):
            stem, dot, ext = f.base_name, "", ""
        if self.extensions and dot + ext not in self.extensions:
            return False
        if self.skip_tests and (stem.startswith("test_") or stem.endswith("_test")):
            return False
        return not self.max_bytes or f.size <= self.max_bytes

    def partitions(self):
        from pyarrow import fs
        store, root = self._open()
        if store.get_file_info(root).type != fs.FileType.Directory:
            raise ValueError(f"not an existing directory: {self.root}")
        parts, level = [], [root]
        for _ in range(self.depth):
            parts += [_Folder(f, False) for f in level]
            level = [d for f in level for d in self._list(store, f)[0]]
        return parts + [_Folder(f, True) for f in level]

    def read(self, partition):
        store, root = self._open()
        todo = [partition.path]
        while todo:
            dirs, files = self._list(store, todo.pop())
            if partition.recursive:
                todo += dirs
            for f in files:
                rel = f.path[len(root):].lstrip("/")
                data = error = None
                try:
                    if self.content:
                        with store.open_input_stream(f.path) as stream:
                            data = stream.read()
                except OSError as e:
                    error = f"cannot be read ({type(e).__name__})"
                yield (self.repo, f"{self.root}/{rel}", rel, f.size, data, error)


def scan_corpus(spark, path: str, **options):
    """DataFrame of the files under ``path`` (schema ``model.SCANNED_FILES``)."""
    spark.dataSource.register(CorpusSource)
    reader = spark.read.format("corpus").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()
