import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.sources.stored import Collection, Conflict
from loomtext.streaming import ingest

SCHEMA = "id long, tag string, v array<double>"


def made(spark, rows=(), **more):
    empty = spark.createDataFrame([], SCHEMA)
    c = Collection.create(spark, tempfile.mkdtemp(prefix="spark-") + "/c", empty.schema, "id", buckets=4, **more)
    if rows:
        c.upsert(spark.createDataFrame(list(rows), SCHEMA))
    return c


def content(c):
    return sorted((r.id, r.tag, tuple(r.v or ())) for r in c.rows().collect())


def test_changes_and_reopening(spark):
    c = made(spark, [(i, "a", [float(i)]) for i in range(20)], metric="l2")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    c.upsert(frame([(3, "b", None), (3, "c", None), (50, "d", [1.0])]))
    c.append(frame([(4, "no", None), (60, "e", None)]))
    c.delete(spark.createDataFrame([(0,), (1,), (999,)], "id long"))
    c.delete(spec={"tag": {"$in": ["d"]}})
    again = Collection(spark, c.folder)
    rows = content(again)
    assert rows == sorted([(i, "a", (float(i),)) for i in range(2, 20) if i != 3] + [(3, "c", ()), (60, "e", ())])
    assert again.version().metric == "l2" and again.count() == len(rows)
    assert sorted(r.id for r in again.get([2, 3, 0, 60]).collect()) == [2, 3, 60]
    assert again.rows({"tag": "e"}).count() == 1
    with pytest.raises(ValueError, match="holds a collection"):
        Collection.create(spark, c.folder, c.rows().schema, "id")
    with pytest.raises(ValueError, match="no collection"):
        Collection(spark, c.folder + "-none").version()


def test_only_touched_buckets_are_written(spark):
    c = made(spark, [(i, "a", None) for i in range(200)])
    before = c.version().folders
    c.upsert(spark.createDataFrame([(5, "b", None)], SCHEMA))
    after = c.version().folders
    changed = [b for b in before if after[b] != before[b]]
    assert len(before) == 4 and len(changed) == 1
    assert sum(1 for r in c.rows().collect() if r.tag == "b") == 1 and c.count() == 200


def test_a_change_that_dies_changes_nothing(spark, monkeypatch):
    c = made(spark, [(1, "a", None)])
    change = spark.createDataFrame([(1, "b", None), (2, "b", None)], SCHEMA)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(c._files, "write_new", dies)
    with pytest.raises(KeyboardInterrupt):
        c.upsert(change)  # the data is written, the version isn't
    monkeypatch.undo()
    assert content(Collection(spark, c.folder)) == [(1, "a", ())]
    for _ in range(2):
        c.upsert(change)
        assert content(c) == [(1, "b", ()), (2, "b", ())]
    c.cleaned()
    assert len(list(Path(c.folder, "data").iterdir())) == 1 and content(Collection(spark, c.folder)) == [(1, "b", ()), (2, "b", ())]


def test_of_two_changes_at_once_one_goes_on(spark, monkeypatch):
    a = made(spark, [(1, "a", None)])
    b = Collection(spark, a.folder)
    seen = b.version()
    a.upsert(spark.createDataFrame([(2, "a", None)], SCHEMA))
    monkeypatch.setattr(b, "version", lambda: seen)
    with pytest.raises(Conflict):
        b.upsert(spark.createDataFrame([(3, "b", None)], SCHEMA))
    assert [r[0] for r in content(a)] == [1, 2]


def test_batches_merge_once(spark):
    c = made(spark)
    row = lambda i: spark.createDataFrame([(i, "x", None)], SCHEMA)
    assert c.upsert(row(1), source="s", batch=0) == 1 and c.upsert(row(2), source="s", batch=0) is None
    assert c.upsert(row(2), source="t", batch=0) == 2 and c.append(row(3), source="s", batch=1) == 3
    assert [r[0] for r in content(c)] == [1, 2, 3]
    c.reset()
    assert content(c) == [] and c.upsert(row(7), source="s", batch=0) is not None


def test_files_are_taken_in_once(spark):
    inbox, work = Path(tempfile.mkdtemp(prefix="spark-")), tempfile.mkdtemp(prefix="spark-")
    c = ingest.created(spark, f"{work}/c", 4)
    run = lambda: ingest.ingested(spark, str(inbox), c, f"{work}/checkpoint")
    (inbox / "a.md").write_text("# One\n\nfirst words here")
    (inbox / "sub").mkdir()
    (inbox / "sub" / "b.md").write_text("\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(9)))
    (inbox / "c.txt").write_text("other")
    run()
    rows = {r.id: r.text for r in c.rows().collect()}
    assert rows["a.md#0"].startswith("# One") and sum(k.startswith("sub/b.md#") for k in rows) > 3 and not any("c.txt" in k for k in rows)
    version = c.version().number
    run()  # nothing new
    assert c.version().number == version
    (inbox / "d.md").write_text("later")
    run()
    assert {r.source for r in c.rows().collect()} == {"a.md", "sub/b.md", "d.md"} and c.version().number == version + 1
    # What died after the merge and before the checkpoint knew comes again: no effect.
    files = spark.createDataFrame([("d.md", "changed")], "source string, text string")
    last = c.version().merged["files"]
    assert ingest.merged(c, files, last) is None and c.rows({"source": "d.md"}).first().text == "later"
    assert ingest.merged(c, files.withColumn("text", F.lit("now")), last + 1) and c.rows({"source": "d.md"}).first().text == "now"
    # A shorter file leaves no old chunks behind.
    ingest.merged(c, spark.createDataFrame([("sub/b.md", "short")], "source string, text string"), last + 2)
    assert [r.text for r in c.rows({"source": "sub/b.md"}).collect()] == ["short"]
    ingest.merged(c, spark.createDataFrame([("sub/b.md", " ")], "source string, text string"), last + 3)
    assert c.rows({"source": "sub/b.md"}).count() == 0
