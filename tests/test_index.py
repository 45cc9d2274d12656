"""Corpus scan, incremental index, snapshots and the stream that feeds them."""

import pytest
from pyspark.sql import functions as F

from sparklode import model as M
from sparklode.operators import incremental as inc
from sparklode.plans.index import build_index
from sparklode.plans.upkeep import update_index
from sparklode.sources import snapshots
from sparklode.sources.buckets import buckets_of, open_index
from sparklode.sources.corpus import scan_corpus
from sparklode.streaming.ingest import ingest_batch, start_ingest

FILES = "repo_id string, file_path string, file_rel_path string, length long, content binary"


def files(spark, **texts):
    return spark.createDataFrame(
        [("r", f"/r/{n}.py", f"{n}.py", len(t), t.encode() if isinstance(t, str) else t)
         for n, t in texts.items()], FILES)


def stats(run):
    return run.stats.first().asDict()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for rel, size in {
        "main.py": 3, "pkg/__init__.py": 0, "pkg/_x.ts": 5, "pkg/sub/deep/d.jsx": 4, "README.md": 2,
        "__pycache__/m.py": 1, "venv/lib/site.py": 1, ".hidden/c.py": 1, "tests/t.py": 1,
        "pkg/test_a.py": 1, "pkg/b_test.py": 1, "pkg/a.test.ts": 1, "pkg/X.PY": 1, "pkg/.py": 1,
        "max.py": M.MAX_FILE_BYTES, "over.py": M.MAX_FILE_BYTES + 1,
    }.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    return str(root)


KEPT = ["main.py", "max.py", "pkg/__init__.py", "pkg/_x.ts", "pkg/a.test.ts", "pkg/sub/deep/d.jsx"]


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_scan(spark, tree, depth):
    rows = scan_corpus(spark, tree, depth=depth, repo_id="r").orderBy("file_path").collect()
    assert [r["file_rel_path"] for r in rows] == KEPT
    assert all(r["repo_id"] == "r" and len(r["content"]) == r["length"] for r in rows)


def test_scan_with_tests_and_without_content(spark, tree):
    rows = scan_corpus(spark, tree, exclude_tests=False, content=False).collect()
    assert {r["file_rel_path"] for r in rows} - set(KEPT) == {
        "tests/t.py", "pkg/test_a.py", "pkg/b_test.py"}
    assert all(r["content"] is None for r in rows)


def test_scan_of_missing_path(spark):
    with pytest.raises(Exception, match="not an existing directory"):
        scan_corpus(spark, "/tmp/no-such-folder-here").collect()


def test_index_life_cycle(spark):
    first = build_index(files(spark, a="def f():\n    g()\n", b="x = 1\n", c="def c(): pass\n"))
    want = dict(repo_id="r", total_files=3, indexed=3, skipped=0, total_chunks=2, cleaned=0, errors=0)
    assert stats(first) == want
    assert first.hashes.count() == 3   # also the file without chunks
    same = build_index(files(spark, a="def f():\n    g()\n", b="x = 1\n", c="def c(): pass\n"),
                       first.chunks, first.hashes)
    assert stats(same) == {**want, "indexed": 0, "skipped": 3, "total_chunks": 0}
    forced = build_index(files(spark, a="def f():\n    g()\n"), first.chunks, first.hashes, force=True)
    assert stats(forced) == {**want, "total_files": 1, "indexed": 1, "total_chunks": 1, "cleaned": 2}
    edit = build_index(files(spark, a="def f():\n    h()\ndef n(): pass\n", c="def c(): pass\n"),
                       first.chunks, first.hashes)
    assert stats(edit) == {**want, "total_files": 2, "indexed": 1, "skipped": 1, "total_chunks": 2,
                           "cleaned": 1}
    assert sorted((r["name"], tuple(r["calls"])) for r in edit.chunks.collect()) == [
        ("c", ()), ("f", ("h",)), ("n", ())]
    assert sorted(r["file_path"] for r in edit.hashes.collect()) == ["/r/a.py", "/r/c.py"]


def test_broken_file_is_reported_and_keeps_its_chunks(spark):
    first = build_index(files(spark, a="def f(): pass\n", b="def b(): pass\n"))
    run = build_index(files(spark, a=b"def f(): \xff\n", b="def b2(): pass\n"), first.chunks, first.hashes)
    assert [r["file_path"] for r in run.errors.collect()] == ["/r/a.py"]
    assert sorted(r["name"] for r in run.chunks.collect()) == ["b2", "f"]


def test_embedding_batches_keep_order(spark):
    sizes = []

    def embedder(texts):
        assert len(texts) <= 7
        return [[float(t)] for t in texts]

    c = spark.range(50).select(F.col("id").cast("string").alias("chunk_key"),
                               F.col("id").cast("string").alias("search_text"))
    out = inc.embed(c, embedder, batch=7).collect()
    assert len(out) == 50 and all(float(r["chunk_key"]) == r["embedding"][0] for r in out)


def test_links_and_unreadable_files(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    for name in ("a.py", "pkg/b.py", "pkg/c.py"):
        (root / name).write_text("def f(): pass\n")
    (root / "pkg" / "up").symlink_to(root)
    (root / "gone.py").symlink_to(root / "nowhere")
    rows = scan_corpus(spark, str(root), repo_id="r").collect()
    assert sorted(r["file_rel_path"] for r in rows if r["error"] is None) == [
        "a.py", "pkg/b.py", "pkg/c.py"]
    first = build_index(scan_corpus(spark, str(root), repo_id="r"))
    broken = scan_corpus(spark, str(root), repo_id="r").withColumns({
        "content": F.when(F.col("file_rel_path") != "a.py", F.col("content")),
        "error": F.when(F.col("file_rel_path") == "a.py", "cannot be read (OSError)")})
    run = build_index(broken, first.chunks, first.hashes)
    assert [r["error"] for r in run.errors.collect()] == [
        f"{root}/a.py: cannot be read (OSError)"]
    assert run.chunks.count() == 3 and stats(run)["cleaned"] == 0


def test_vectors_follow_the_chunks(spark):
    def embed(chunks):
        return inc.embed(chunks, lambda texts: [[float(len(t))] for t in texts])
    first = build_index(files(spark, a="def f(): pass\n", b="def b(): pass\n"), embed=embed)
    run = build_index(files(spark, a="def longer_name(): pass\n"), first.chunks, first.hashes,
                      embed=embed, vectors=first.vectors)
    keys = [(r.repo_id, r.chunk_key) for r in run.chunks.collect()]
    assert [(r.repo_id, r.chunk_key) for r in run.vectors.collect()] == keys and len(keys) == 1


def test_other_repositories_stay(spark):
    one = files(spark, a="def f(): pass\n")
    two = one.withColumn("repo_id", F.lit("s"))
    first = build_index(one.unionByName(two))
    run = build_index(one, first.chunks, first.hashes)
    assert run.hashes.count() == 2 and run.chunks.count() == 2
    named = spark.createDataFrame([("r",), ("s",)], "repo_id string")
    run = build_index(one, first.chunks, first.hashes, repos=named)
    assert [r.repo_id for r in run.chunks.collect()] == ["r"]


def test_snapshot_keeps_types_and_few_files(spark, tmp_path):
    base = str(tmp_path / "typed")
    df = spark.range(1000).select(F.lit("007").alias("repo_id"), "id").repartition(40)
    path = snapshots.write_snapshot(df, base)
    snapshots.publish(spark, base, path)
    got = snapshots.current_snapshot(spark, base)
    assert got.schema["repo_id"].dataType == df.schema["repo_id"].dataType
    assert got.select("repo_id").distinct().first()[0] == "007" and got.count() == 1000
    assert len(spark.read.parquet(path).inputFiles()) <= snapshots.FILES_PER_PARTITION


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "snap")
    with pytest.raises(snapshots.NoSnapshot):
        snapshots.current_snapshot(spark, base)
    for n in (3, 5):
        df = spark.range(n).withColumn("repo_id", F.lit("r"))
        snapshots.publish(spark, base, snapshots.write_snapshot(df, base))
        assert snapshots.current_snapshot(spark, base).count() == n


def test_stream(spark, tmp_path):
    landing, base = str(tmp_path / "in"), str(tmp_path / "index")
    schema = FILES + ", version long"

    def land(version, **texts):
        rows = [("r", f"/r/{n}.py", f"{n}.py", len(t or ""), t and t.encode(), version)
                for n, t in texts.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        q = start_ingest(spark.readStream.schema(schema).parquet(landing), base, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["name"] for r in open_index(spark, base).read("chunks").collect())

    assert land(1, a="def a(): pass\n", b="def b(): pass\n") == ["a", "b"]
    assert land(2, a="def a2(): pass\n", c="def c(): pass\n") == ["a2", "b", "c"]
    assert land(3, b=None) == ["a2", "c"]


def data_files(base):
    """Every file of the stored parts with its modification time."""
    return {str(p.relative_to(base)): p.stat().st_mtime_ns
            for p in (base / "data").rglob("*.parquet")}


def embed_sizes(chunks):
    return inc.embed(chunks, lambda texts: [[float(len(t))] for t in texts])


def test_one_changed_file_writes_one_bucket(spark, tmp_path):
    texts = {f"f{i}": f"def g{i}(): pass\n" for i in range(60)}
    first, _ = update_index(files(spark, **texts), str(tmp_path), embed=embed_sizes, buckets=16)
    before = data_files(tmp_path)
    # The changed file moves its definition; its neighbours in the bucket stay as they are.
    texts["f7"] = "\n\ndef moved(): pass\n"
    second, run = update_index(files(spark, **texts), str(tmp_path), embed=embed_sizes)
    assert stats(run)["indexed"] == 1 and second.buckets == 16
    now = data_files(tmp_path)
    assert {p: now[p] for p in before} == before
    (bucket,) = buckets_of(files(spark, f7="").select("repo_id", "file_path"), 16)
    assert {"/".join(p.split("/")[2:4]) for p in now.keys() - before.keys()} == {
        f"{part}/bucket={bucket}" for part in ("chunks", "hashes", "vectors")}
    for part in ("chunks", "hashes", "vectors"):
        old = {e["bucket"]: e["path"] for e in first.entries if e["part"] == part}
        new = {e["bucket"]: e["path"] for e in second.entries if e["part"] == part}
        assert {b for b in new if new[b] != old.get(b)} == {bucket}
    stored = open_index(spark, str(tmp_path))
    assert sorted(r.name for r in stored.read("chunks").collect()) == sorted(
        [f"g{i}" for i in range(60) if i != 7] + ["moved"])
    assert {r.chunk_key for r in stored.read("vectors").collect()} == {
        r.chunk_key for r in stored.read("chunks").collect()}
    # A reader that opened the first version goes on with it.
    assert first.read("chunks").where("name = 'g7'").count() == 1
    same, run = update_index(files(spark, **texts), str(tmp_path), embed=embed_sizes)
    assert same.version == second.version and stats(run)["skipped"] == 60
    del texts["f9"]
    third, run = update_index(files(spark, **texts), str(tmp_path), embed=embed_sizes)
    assert stats(run)["cleaned"] == 1 and third.read("hashes").count() == 59


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    from sparklode.sources import buckets
    update_index(files(spark, a="def a(): pass\n"), str(tmp_path))
    seen = open_index(spark, str(tmp_path)).version

    def fail(*args):
        raise OSError("lost")
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(buckets, "publish", fail)
        update_index(files(spark, a="def b(): pass\n"), str(tmp_path))
    stored = open_index(spark, str(tmp_path))
    assert stored.version == seen and stored.read("chunks").first().name == "a"
    update_index(files(spark, a="def b(): pass\n"), str(tmp_path))
    assert open_index(spark, str(tmp_path)).read("chunks").first().name == "b"


def test_unreadable_and_withdrawn_files_of_a_batch(spark, tmp_path):
    kinds = FILES + ", error string, withdrawn boolean"

    def batch(**rows):
        return ingest_batch(spark.createDataFrame(
            [("r", f"/r/{n}.py", f"{n}.py", 9, t and t.encode(), e, w)
             for n, (t, e, w) in rows.items()], kinds), str(tmp_path))[0]

    def state(stored):
        return (sorted(r.name for r in stored.read("chunks").collect()),
                sorted((r.file_path, r.error) for r in stored.read("errors").collect()),
                stored.read("hashes").count())
    a, b, c = ((f"def {n}(): pass\n", None, False) for n in "abc")
    assert state(batch(a=a, b=b, c=c)) == (["a", "b", "c"], [], 3)
    lost = "cannot be read (OSError)"
    got = batch(a=(None, lost, False), b=(None, None, False), c=(None, None, True))
    bad = [("/r/a.py", f"/r/a.py: {lost}"), ("/r/b.py", "/r/b.py: content is missing")]
    assert state(got) == (["a", "b"], bad, 2)
    assert state(batch(c=c)) == (["a", "b", "c"], bad, 3)    # others keep their errors
    assert state(batch(a=a)) == (["a", "b", "c"], bad[1:], 3)
    assert state(batch(b=(None, None, True))) == (["a", "c"], [], 2)


def test_stored_postings_follow_the_chunks(spark, tmp_path):
    from sparklode.operators.postings import keyword_topk_segments
    from sparklode.operators.search import keyword_topk
    asked = spark.createDataFrame([(1, "moved g7 pass"), (2, "def g1"), (3, "g9")],
                                  "query_id long, question string")

    def agrees(store):
        rows = [sorted(map(repr, found.select("query_id", "repo_id", "chunk_key", "matches", "krank")
                           .collect())) for found in (
            keyword_topk_segments(asked, store.read("postings")),
            keyword_topk(asked, store.read("chunks")))]
        return rows[0] == rows[1] and len(rows[0]) > 0

    texts = {f"f{i}": f"def g{i}(): pass\n" for i in range(40)}
    update_index(files(spark, **texts), str(tmp_path), buckets=16)
    texts["f7"] = "def moved(): pass\n"
    first, _ = update_index(files(spark, **texts), str(tmp_path), postings=True)
    assert agrees(first)   # asked for later: segments of all buckets
    texts["f9"] = "def other(): pass\n"
    second, _ = update_index(files(spark, **texts), str(tmp_path))
    assert agrees(second)  # kept up without being asked for again
    old, new = ({e["bucket"]: e["path"] for e in s.entries if e["part"] == "postings"}
                for s in (first, second))
    (bucket,) = buckets_of(files(spark, f9="").select("repo_id", "file_path"), 16)
    assert {b for b in new if new[b] != old.get(b)} == {bucket}
    del texts["f1"]
    third, _ = update_index(files(spark, **texts), str(tmp_path))
    assert agrees(third)
