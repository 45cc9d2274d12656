"""Upkeep of a stored index: changed files in, touched buckets out."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from sparklode.functions.storage import materialize
from sparklode.operators import incremental as inc
from sparklode.operators.postings import build_segments
from sparklode.plans.index import IndexResult, build_index
from sparklode.sources.buckets import BUCKETS, StoredIndex, buckets_of, new_index, open_index
from sparklode.sources.snapshots import NoSnapshot


def update_index(files: DataFrame, base: str, listing: bool = True, force: bool = False,
                 exclude_tests: bool = True, repos: DataFrame | None = None,
                 embed: Callable[[DataFrame], DataFrame] | None = None,
                 withdrawn: DataFrame | None = None, buckets: int = BUCKETS,
                 postings: bool = False) -> tuple[StoredIndex, IndexResult]:
    """Brings the index under ``base`` up to ``files`` and gives its new version.

    With ``listing`` the files are all of their repositories (or of ``repos``), and stored ones
    that are missing go. Without it only the given files are looked at, with the hashes of their
    buckets, and the (repo_id, file_path) of ``withdrawn`` go. Chunks, hashes and vectors of
    touched buckets are written anew and all switched to at once, with ``postings`` also the
    segments of keyword search, which an index that has them keeps up in every run; untouched
    buckets are neither read nor written. ``errors`` holds the files that this run could not index. A run without
    changes and errors writes nothing.
    """
    spark = files.sparkSession
    try:
        store = open_index(spark, base)
    except NoSnapshot:
        store = new_index(spark, base, buckets)
    hashes = store.read("hashes") if listing else None
    if not listing:
        keys = files.select(*inc.KEYS)
        if withdrawn is not None:
            keys = keys.unionByName(withdrawn.select(*inc.KEYS))
        keys = materialize(keys.distinct())
        # Of the files looked at, only withdrawn ones are not listed now.
        hashes = store.read("hashes", buckets_of(keys, store.buckets))
        hashes = hashes if hashes is None else hashes.join(keys, inc.KEYS, "left_semi")
        repos = keys.select("repo_id")
    run = build_index(files, hashes=hashes, force=force, exclude_tests=exclude_tests,
                      repos=repos, embed=embed)
    stale = inc.to_index(run.changes).select(*inc.KEYS).unionByName(run.gone)
    touched = buckets_of(stale, store.buckets)
    parts = {}
    if touched or not store.entries:
        def after(part, fresh):
            old = store.read(part, touched)
            return fresh if old is None else old.join(stale, inc.KEYS, "left_anti").select(
                *fresh.columns).unionByName(fresh)

        done = inc.to_index(run.changes).select(*inc.KEYS, "sha256")
        parts = {"chunks": after("chunks", run.new_chunks), "hashes": after("hashes", done)}
        if embed is not None:
            parts["vectors"] = after("vectors", materialize(run.vectors))
        indexed = any(e["part"] == "postings" for e in store.entries)
        if postings or indexed:
            parts["chunks"] = now = materialize(parts["chunks"])
            if store.entries and not indexed:   # asked for now: all buckets get segments
                rest = sorted(set(range(store.buckets)) - set(touched))
                now = now.unionByName(store.read("chunks", rest).select(*now.columns))
            parts["postings"] = build_segments(now, store.buckets)
        parts = {part: (rows, None if part == "postings" and not indexed else touched)
                 for part, rows in parts.items()}
    # Errors of files that this run did not look at stay.
    failed, seen = materialize(run.errors), run.changes.select(*inc.KEYS).unionByName(run.gone)
    known = store.read("errors")
    ends = failed.select(*inc.KEYS) if known is None else failed.select(
        *inc.KEYS).unionByName(known.join(seen, inc.KEYS, "left_semi").select(*inc.KEYS))
    touched = buckets_of(ends, store.buckets)
    if touched or not store.entries:
        old = store.read("errors", touched)
        parts["errors"] = (failed if old is None else old.join(
            seen, inc.KEYS, "left_anti").unionByName(failed), touched)
    return (store.replace(parts) if parts else store), run
