"""Readers, batches on disk, the CSV export and the stream."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.rules import audit
from ledgerlens.sources import readers, store
from ledgerlens.streaming import audit_stream
from tests.test_rules import SOUND


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "docs").mkdir()
    for k in range(3):
        (tmp_path / "docs" / f"doc{k}.json").write_text(json.dumps({**SOUND, "numero": f"=F{k}", "total": 1089 + 100 * k}, indent=1))
    (tmp_path / "docs" / "notes.txt").write_text("x")
    (tmp_path / "docs" / "empty.pdf").write_text("")
    return tmp_path


def test_files_are_routed_not_raised(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: (r["reader"], r["error"]) for r in readers.read_files(spark, str(folder / "docs")).select("path", "reader", "error").collect()}
    assert rows["doc0.json"] == ("json", None) and rows["notes.txt"] == (None, "unsupported suffix: txt") and rows["empty.pdf"][1] == "empty file"


def test_documents_manifest_and_cases(spark, folder):
    docs = readers.read_documents(spark, str(folder / "docs" / "*.json"))
    assert sorted((r["doc_id"], r["numero"]) for r in docs.collect()) == [("doc0", "=F0"), ("doc1", "=F1"), ("doc2", "=F2")]
    (folder / "manifest.json").write_text(json.dumps({"banco": "x", "facturas": [{"fichero": "a", "total": 1.5}, {"fichero": "b"}]}))
    assert [r["fichero"] for r in readers.read_manifest(spark, str(folder / "manifest.json")).collect()] == ["a", "b"]
    both = readers.cases(docs.filter("doc_id = 'doc0'"), docs.filter("doc_id = 'doc1'").drop("numero"), "ES")
    assert sorted((r["doc_id"], r["trap"]) for r in both.collect()) == [("doc0", False), ("doc1", True)]
    files = spark.createDataFrame([("/x/doc0.pdf",)], "path string")
    assert {r["doc_id"]: r["input"] for r in readers.with_files(docs, files).collect()} == {"doc0": "file", "doc1": "record", "doc2": "record"}


def test_store(spark, folder):
    audited = audit(readers.read_documents(spark, str(folder / "docs" / "*.json")), "2025-06-01")
    home = str(folder / "home")
    for k in range(4):
        store.save(audited, home, f"b/../{k}", "test", f"2025-01-0{k + 1} 00:00:00")
    assert [r["batch_id"] for r in store.listing(spark, home).collect()] == ["b3", "b2", "b1", "b0"] and store.listing(spark, home).first()["validas"] == 1
    assert store.read(spark, home, "b2").count() == 3
    assert sorted(store.prune(spark, home, 2)) == ["b0", "b1"] and store.delete(spark, home, "b3") and not store.delete(spark, home, "b3")
    assert [r["batch_id"] for r in store.listing(spark, home).collect()] == ["b2"]
    with pytest.raises(ValueError):
        store.clean_batch_id("../..")


def test_surplus_files_and_pages(spark):
    files = readers.route_files(spark.createDataFrame([(f"/x/{n}.json", 5) for n in "dbca"] + [("/x/a.txt", 5)], "path string, length long"))
    rows = {r["path"]: r["error"] for r in readers.reject_surplus(files, 3).collect()}
    assert rows == {"/x/a.json": None, "/x/b.json": None, "/x/c.json": None, "/x/d.json": "too many files", "/x/a.txt": "unsupported suffix: txt"}
    assert readers.first_pages(spark.range(28, 33).select(F.col("id").alias("page"))).count() == 3


def test_json_dump_and_baseline(spark, folder):
    store.to_json(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), str(folder / "dump"))
    assert sorted(r["value"] for r in spark.read.text(str(folder / "dump")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert store.read_baseline(spark, str(folder / "none")) is None
    store.save_baseline(spark.createDataFrame([(0.9, 3)], "precision double, traps long"), str(folder / "line"), "2025-01-01")
    assert store.read_baseline(spark, str(folder / "line")).first().asDict() == {"precision": 0.9, "traps": 3, "fecha": "2025-01-01"}


def test_csv(spark, folder):
    audited = audit(readers.read_documents(spark, str(folder / "docs" / "*.json")), "2025-06-01")
    store.to_csv(audited.withColumn("numero", F.concat("numero", F.lit(',"x"'))), str(folder / "csv"))
    rows = [row for path in glob.glob(str(folder / "csv" / "*.csv")) for row in csv.DictReader(open(path, encoding="utf-8"))]
    assert len(rows) == 3 and all(len(r) == 21 for r in rows) and {r["numero"] for r in rows} == {f"'=F{k},\"x\"" for k in range(3)}
    assert {r["valida"] for r in rows} == {"sí", "no"} and {r["cuota_impuesto"] for r in rows} == {"189.00"}


def test_stream(spark, folder):
    out = str(folder / "out")
    stream = audit_stream.audited(audit_stream.arriving(spark, str(folder / "docs" / "*.json"), files_per_trigger=1), "2025-06-01")
    sink = lambda rows, number: rows.select("doc_id", "estado").write.mode("overwrite").parquet(f"{out}/part={number}")
    audit_stream.to_batches(stream, sink, str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r["doc_id"], r["estado"]) for r in rows) == [("doc0", "conforme"), ("doc1", "no_conforme"), ("doc2", "no_conforme")] and len({r["part"] for r in rows}) == 3


def test_ten_thousand_files_are_listed_in_tasks(spark, tmp_path):
    """The same rows as Spark's own scan, and besides those of files without bytes; each once, dealt over the tasks."""
    for k in range(10_000):
        folder = tmp_path / ("flat" if k % 2 else f"a{k % 6}/b{k % 5}/c")
        if k < 60:
            folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f {k}é+%.json").write_bytes(b"" if k % 100 == 7 else str(k).encode())
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / "flat" / ".hidden.json").write_text("x")
    got = readers.read_files(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).collect()
    rows = {r["path"]: (r["length"], bytes(r["content"])) for r in got}
    assert len(got) == len(rows) == 10_000 and {p: v for p, v in rows.items() if v[0]} == {r["path"]: (r["length"], bytes(r["content"])) for r in scan}
    assert sum(r["error"] == "empty file" for r in got) == 100 and all((r["error"] is None) == (r["length"] > 0) for r in got)
    assert len({r["task"] for r in got}) == 16 and max(sum(r["task"] == t for r in got) for t in range(16)) < 3_000
    changed = {r["path"]: r["modificationTime"] for r in scan}
    assert all(abs((r["modificationTime"] - changed[r["path"]]).total_seconds()) < 0.01 for r in got if r["length"])
    for depth in (1, 3, 9):
        again = spark.read.format("folder_files").options(path=str(tmp_path), depth=depth, slices=5, content="false").load()
        assert {r["path"] for r in again.collect()} == set(rows) and again.count() == 10_000


def test_files_of_any_state_and_pattern(spark, tmp_path):
    import os

    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.PDF").write_bytes(b"%" * 40)
    (tmp_path / "c.txt").write_text("x")
    os.mkfifo(tmp_path / "pipe.json")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.json")  # a link to nothing is no file
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["pipe.json"]["content"] is None and got["pipe.json"]["error"] == "not a file that can be read"
    assert (got["b.PDF"]["reader"], got["b.PDF"]["error"], len(got["b.PDF"]["content"])) == ("pdf", None, 40) and got["c.txt"]["error"] == "unsupported suffix: txt"
    names = lambda **kw: sorted(r["path"].rsplit("/", 1)[1] for r in readers.read_files(spark, f"file:{tmp_path}", **kw).collect())
    assert names(pattern="*.{json,txt}") == ["a.json", "c.txt", "pipe.json"] and names(pattern="[ab].*", content=False) == ["a.json", "b.PDF"]
    large = spark.read.format("folder_files").options(path=str(tmp_path), maxBytes=10, pattern="b*").load().first()
    assert large["length"] == 40 and large["content"] is None
    one = readers.read_files(spark, str(tmp_path / "a.json")).collect()
    assert len(one) == 1 and bytes(one[0]["content"]) == b"{}"
    (tmp_path / "none").mkdir()
    assert readers.read_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no such path"):
        readers.read_files(spark, str(tmp_path / "missing")).count()


def test_files_arrive_once(spark, folder):
    """Two runs over one checkpoint: each file comes once, rejects too, and the records among them give the table's audit."""
    import time

    home, seen = str(folder / "seen"), lambda: spark.read.parquet(str(folder / "seen")).collect()

    def run():
        time.sleep(0.5)
        stream = audit_stream.arriving_files(spark, str(folder / "docs"), settle=0.2, slices=3)
        stream.writeStream.format("parquet").option("path", home).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination(120)

    run()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in seen()) == ["doc0.json", "doc1.json", "doc2.json", "empty.pdf", "notes.txt"]
    (folder / "docs" / "late.json").write_text(json.dumps({**SOUND, "numero": "L1"}))
    run()
    run()
    rows = [r["path"].rsplit("/", 1)[1] for r in seen()]
    assert sorted(rows) == ["doc0.json", "doc1.json", "doc2.json", "empty.pdf", "late.json", "notes.txt"]
    found = lambda docs: sorted((r["doc_id"], r["estado"]) for r in audit_stream.audited(docs, "2025-06-01").collect())
    assert found(audit_stream.invoices(spark.read.parquet(home))) == found(readers.read_documents(spark, str(folder / "docs" / "*.json")))


def test_top_findings_of_repeats_and_ties(spark):
    """Codes repeated inside a document, ties, documents without findings and without a list, against plain counts."""
    from ledgerlens.operators.batch import top_findings

    docs = [(k, [(f"C{(k * j) % 5}", f"s{k}{j}") for j in range(k % 7)] if k % 11 else None) for k in range(60)]
    times, held, first = {}, {}, {}
    for k, findings in docs:
        for at, (code, severity) in enumerate(findings or []):
            times[code] = times.get(code, 0) + 1
            held.setdefault(code, set()).add(k)
            first.setdefault(code, (k, at, severity))
    expected = [(c, first[c][2], times[c], len(held[c])) for c in sorted(times, key=lambda c: (-times[c], first[c][:2]))]
    frame = spark.createDataFrame(docs, "doc_id long, findings array<struct<code:string,severity:string>>").repartition(5)
    assert [tuple(r) for r in top_findings(frame).collect()] == expected and [tuple(r) for r in top_findings(frame, limit=2).collect()] == expected[:2]
    assert top_findings(frame.limit(0)).count() == 0
