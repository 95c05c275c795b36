"""Versions, increments and the stream sink: nothing half done is ever seen, nothing counted twice."""

import itertools

import pytest
from cases import AS_OF, SMALL

from pagoscope.operators import findings as fd, increments, quality
from pagoscope.operators import totals as tt
from pagoscope.plans import assessment, queries
from pagoscope.sources import files, versions
from pagoscope.streaming import zones as streamed


def rows(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def test_a_broken_run_leaves_the_old_outputs(spark, payments, tmp_path, monkeypatch):
    output = f"{tmp_path}/out"
    with pytest.raises(ValueError):
        assessment.current(spark, output)
    first = assessment.run(spark, payments.limit(200), output, as_of=AS_OF)
    before = rows(versions.read(spark, output, "snapshot"))

    def broken(*args, **more):
        raise RuntimeError("lost between two outputs")

    with monkeypatch.context() as m:
        m.setattr(assessment.scores, "findings_by_framework", broken)
        with pytest.raises(RuntimeError, match="between"):
            assessment.run(spark, payments, output, as_of=AS_OF)
    assert assessment.current(spark, output) == first and rows(versions.read(spark, output, "snapshot")) == before
    second = assessment.run(spark, payments, output, as_of=AS_OF)
    assert assessment.current(spark, output) == second != first
    assert versions.read(spark, output, "snapshot").first().total_records == 1500
    assert spark.read.parquet(first["snapshot"]).first().total_records == 200  # a reader that had started


def test_versions_expire_and_must_be_complete(spark, tmp_path):
    output = f"{tmp_path}/out"

    def write(*names):
        folder = versions.new_folder(output)
        for name in names:
            files.write_parquet(spark.range(3), f"{folder}/{name}")
        return folder

    assert versions.history(spark, output) == [] and versions.current(spark, output) is None
    a, b = write("x", "y"), write("x")
    versions.publish(spark, output, a, ["x", "y"], notes={"why": "first"})
    with pytest.raises(ValueError, match="y is not complete"):
        versions.publish(spark, output, b, ["x", "y"])
    kept = {"y": versions.current(spark, output).outputs["y"]}
    assert versions.publish(spark, output, b, ["x"], kept).number == 2
    assert versions.expired(spark, output, keep=1) == []  # version 2 still reads y of the first
    for _ in range(2):
        versions.publish(spark, output, write("x", "y"), ["x", "y"])
    assert versions.remove_expired(spark, output) == sorted([a, b])
    assert versions.read(spark, output, "y").count() == 3
    assert [v.number for v in versions.history(spark, output)] == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="no published output"):
        versions.read(spark, output, "z")


@pytest.mark.parametrize("group_by", [(), ("source_system",)])
def test_batches_equal_one_run(spark, payments, tmp_path, group_by):
    output = f"{tmp_path}/state"
    with pytest.raises(ValueError, match="no batch"):
        increments.summary(spark, output)
    whole = tt.run_totals(payments, group_by, as_of=AS_OF)
    for number, batch in enumerate((1, 2, 1, 0, 3)):
        part = payments.where(f"row_id % 3 = {batch}")  # the last one is empty
        version = increments.apply(spark, output, f"b{batch}", part, group_by, AS_OF, buckets=3)
        assert version.number == number + (number < 2)  # the third changed nothing
    assert increments.applied(spark, output) == ["b0", "b1", "b2", "b3"]
    assert rows(increments.totals(spark, output)) == rows(whole)
    assert rows(increments.summary(spark, output)) == rows(quality.summary(payments, group_by, as_of=AS_OF))
    assert rows(increments.failures(spark, output)) == rows(quality.failures_by_code(payments, group_by, as_of=AS_OF))
    found = fd.group_findings(payments, group_by)
    assert rows(increments.group_findings(spark, output)) == rows(found) and not found.isEmpty()
    areas = fd.weight_by_area(fd.findings(payments, group_by), group_by)
    assert rows(increments.risk_areas(spark, output)) == rows(areas)
    with pytest.raises(ValueError, match="was built with"):
        increments.apply(spark, output, "b9", payments, group_by, AS_OF, buckets=4)


def test_a_finding_appears_when_its_minimum_is_crossed(spark, table, tmp_path):
    def batch(n, name="Ann"):
        return table(*[{"customer_name": name, "amount": "9500", "payment_id": f"{name}-{n}-{i}"} for i in range(n)])

    minimum = next(r.minimum for r in fd.FINDINGS if r.rule == "AML_STRUCTURING_PATTERN")
    for order in itertools.permutations((minimum - 1, 1)):
        output, seen = f"{tmp_path}/{order[0]}", []
        for n in order:
            increments.apply(spark, output, f"{n}", batch(n), as_of=AS_OF, buckets=2)
            seen.append([(r.rule, r.affected_records) for r in increments.group_findings(spark, output).collect()])
        assert seen == [[], [("AML_STRUCTURING_PATTERN", minimum)]]


def test_only_the_buckets_of_a_batch_are_rewritten(spark, table, tmp_path):
    output = f"{tmp_path}/state"
    many = table(*[{"payment_id": f"P{i}", "amount": "5"} for i in range(60)])
    first = increments.apply(spark, output, "a", many, as_of=AS_OF, buckets=8)
    second = increments.apply(spark, output, "b", table({"payment_id": "P1", "amount": "5"}), as_of=AS_OF, buckets=8)
    changed = [k for k, path in second.outputs.items() if first.outputs.get(k) != path]
    assert len(changed) == 2 and increments.COUNTS in changed
    assert [r.record for r in increments.group_findings(spark, output).collect()] == ["P1"]


def test_a_stream_goes_on_after_a_restart(spark, payments, tmp_path, monkeypatch):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    payments.repartition(6, "row_id").write.parquet(source)

    def run():
        stream = spark.readStream.schema(payments.schema).option("maxFilesPerTrigger", 2).parquet(source)
        query = streamed.route(stream, out, checkpoint, as_of=AS_OF).trigger(availableNow=True).start()
        query.awaitTermination()

    calls, real = [], streamed._replace

    def failing(frame, path, *partitions):
        real(frame, path, *partitions)
        calls.append(path)
        if len(calls) == 3:  # the second batch's zones are written, its counts and its commit are not
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(streamed, "_replace", failing)
        with pytest.raises(Exception, match="lost"):
            run()
    assert streamed.read_counts(spark, out).count() == 1
    run()
    whole = quality.evaluate(payments, as_of=AS_OF)
    zones = streamed.read_zones(spark, out)
    assert zones.count() == 1500 and zones.where("zone = 'errors'").count() == 103
    assert rows(zones.select("row_id", "dq_errors", "warning")) == rows(whole.select("row_id", "dq_errors", "warning"))
    totals = streamed.read_counts(spark, out).agg({"total_records": "sum", "error_records": "sum"}).first()
    assert sorted(totals) == [103, 1500]
    payments.limit(10).coalesce(1).write.mode("append").parquet(source)
    run()
    assert streamed.read_zones(spark, out).count() == 1510


def test_a_larger_table_makes_more_files_of_a_stream_and_no_larger_ones(spark, payments, tmp_path, monkeypatch):
    monkeypatch.setattr(streamed, "FILE_ROWS", 100, raising=False)
    zones = queries.QUERIES["io_stream_zones"](spark, SMALL)
    assert zones.count() == payments.count()
    base = zones.inputFiles()[0].split("/out/")[0]
    files = spark.read.parquet(f"{base}/in").selectExpr("_metadata.file_path as file").groupBy("file").count()
    assert files.count() >= 15 and files.agg({"count": "max"}).first()[0] <= 100
    assert streamed.read_counts(spark, f"{base}/out").count() > 1
