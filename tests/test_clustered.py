"""Clustered zones, catalog statistics and rules over Arrow batches."""

import re
from collections import Counter

import pytest
from cases import AS_OF

from pagoscope.operators import findings as fd, quality, reports
from pagoscope.operators.batch_rules import batch_rule, iban_rule
from pagoscope.operators.quality_rules import CRITICAL, RULES, WARNING, extend
from pagoscope.sources import catalog, clustered, zones


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def bag(frame) -> Counter:
    return Counter(map(tuple, frame.select(*sorted(frame.columns)).collect()))


@pytest.fixture(scope="module")
def written(spark, payments, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("clustered"))
    zones.write_zones(quality.evaluate(payments, as_of=AS_OF), f"{base}/zones")
    database = catalog.fresh_database(spark, "clustered", f"{base}/database")
    yield base, database, zones.read_zones(spark, f"{base}/zones")
    spark.sql(f"DROP DATABASE {database} CASCADE")


@pytest.mark.parametrize("heavy", [0, 3, 1000])
def test_clustered_rows_and_counts(spark, payments, written, heavy):
    base, database, rows = written
    table = f"{database}.payments_{heavy}"
    clustered.write(rows, table, f"{base}/tables_{heavy}", 6, heavy)
    assert bag(clustered.read(spark, table)) == bag(rows)
    assert bag(clustered.read(spark, table, zones.ERRORS)) == bag(rows.where("zone = 'errors'"))
    assert bag(clustered.duplicate_rows(spark, table)) == bag(fd.duplicate_rows(rows))
    assert bag(clustered.batch_profile(spark, table)) == bag(reports.batch_profile(payments))
    expected = payments.where("payment_id IS NOT NULL").groupBy("payment_id").count().where("count > 1")
    assert bag(clustered.duplicate_counts(spark, table).toDF("payment_id", "count")) == bag(expected)
    spread = spark.table(clustered.spread_table(table))
    assert spread.where("payment_id IS NOT NULL").select("payment_id").distinct().count() <= heavy
    assert spark.table(table).where("payment_id IS NULL").count() == 0


def test_counts_by_id_do_not_exchange_the_buckets(spark, written):
    base, database, rows = written
    table = f"{database}.payments_plan"
    clustered.write(rows, table, f"{base}/tables_plan", 6, 3)
    even, _ = clustered.parts(spark, table)
    assert "Exchange" not in plan(even.groupBy("payment_id").count())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(clustered.duplicate_rows(spark, table))
        assert "SortMergeJoin" in text and "Exchange" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the one exchange by id is that of the spread rows
    text = plan(clustered.duplicate_counts(spark, table))
    assert len(re.findall(r"Exchange hashpartitioning\(payment_id", text)) == 1


def test_clustering_of_odd_tables(spark, table, tmp_path):
    database = catalog.fresh_database(spark, "odd", str(tmp_path / "database"))
    rows = quality.evaluate(table({"payment_id": None}, {"payment_id": "  "}, {"payment_id": "  "},
                                  {"payment_id": None}, {"payment_id": "x"}), as_of=AS_OF)
    for name, given in (("some", rows), ("none", rows.limit(0))):
        zones.write_zones(given, str(tmp_path / name))
        read = spark.read.schema(rows.drop("critical", "warning", "is_error").schema.add("zone", "string")).parquet(str(tmp_path / name))
        clustered.write(read, f"{database}.{name}", str(tmp_path / f"{name}_tables"), 3)
        assert bag(clustered.read(spark, f"{database}.{name}")) == bag(read)
    assert clustered.duplicate_rows(spark, f"{database}.some").count() == 2
    assert clustered.duplicate_rows(spark, f"{database}.none").count() == 0
    assert clustered.batch_profile(spark, f"{database}.none").first().total_records == 0
    with pytest.raises(ValueError, match="heavy_ids"):
        clustered.write(rows, f"{database}.more", str(tmp_path / "more"), 3, 10**6)
    spark.sql(f"DROP DATABASE {database} CASCADE")


# ------------------------------------------------------------------ statistics
@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_partitions_are_pruned_by_the_catalog(spark, payments, tmp_path, file_format):
    path = str(tmp_path / "zones")
    zones.write_zones(quality.evaluate(payments, as_of=AS_OF), path, file_format)
    database = catalog.fresh_database(spark, "pruned", str(tmp_path / "database"))
    name = f"{database}.payments"
    catalog.create_partitioned_table(
        spark, name, catalog.payments_columns(True, True), path, zones.ZONE, file_format
    )
    errors = spark.table(name).where("zone = 'errors'")
    text = plan(errors)
    assert re.search(r"PartitionFilters: \[[^\]]*zone#\d+ = errors", text)
    assert "PushedFilters: []" in text
    assert catalog.table_rows(spark, name) is None
    catalog.analyze(spark, name, ("payment_id",), zones.ZONE)
    assert catalog.table_rows(spark, name) == payments.count()
    assert catalog.partition_rows(spark, name, zones.ZONE, "errors") == errors.count() > 0
    assert catalog.null_count(spark, name, "payment_id") == payments.where("payment_id IS NULL").count()
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_the_size_of_one_zone_decides_the_join(spark, payments, tmp_path):
    path = str(tmp_path / "zones")
    evaluated = quality.evaluate(payments, as_of=AS_OF)
    few = evaluated.where("row_id % 50 = 0 OR NOT is_error")
    zones.write_zones(few, path)
    database = catalog.fresh_database(spark, "sized", str(tmp_path / "database"))
    name = f"{database}.payments"
    catalog.create_partitioned_table(spark, name, catalog.payments_columns(True, True), path)
    catalog.analyze(spark, name, ("row_id",), zones.ZONE)

    def size(frame) -> int:
        return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    clean, errors = (spark.table(name).where(f"zone = '{z}'").select("row_id") for z in ("clean", "errors"))
    assert size(errors) < size(clean)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str((size(errors) + size(clean)) // 2))
    try:
        whole = spark.table(name)
        assert "BroadcastHashJoin" in plan(whole.join(errors, "row_id", "left_semi"))
        assert "BroadcastHashJoin" not in plan(whole.join(clean, "row_id", "left_semi"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    spark.sql(f"DROP DATABASE {database} CASCADE")


# ------------------------------------------------------------------ batch rules
def right(iban: str) -> bool:
    """Check digits by the whole number, as the standard describes them."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


IBANS = [
    "GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606",
    "MT84MALT011000012345MTLCAST001S", "GB82 WEST 1234 5698 7654 32", "de89370400440532013000",
    "GB82TEST12345698765432", "DE88370400440532013000", "XX00" + "A" * 30, "XX00" + "9" * 30,
    "DE8937040044", "8937040044053201300000", "DE89-3704-0044-0532-0130-00", "XX00" + "9" * 31, "ÜE89370400440532013000",
]


def test_iban_check_digits(spark, table):
    given = [None, "", "   ", *IBANS]
    rows = table(*[{} for _ in given]).join(
        spark.createDataFrame(list(enumerate(given, 1)), "row_id BIGINT, iban STRING"), "row_id"
    )
    found = {r.row_id: r.code for r in quality.rule_failures(rows, iban_rule(), AS_OF).collect()}
    for i, iban in enumerate(given, 1):
        plain = (iban or "").replace(" ", "").upper()
        if not plain:
            expected = None
        elif not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain):
            expected = "iban_formato_invalido"
        else:
            expected = None if right(plain) else "iban_digito_control"
        assert found.get(i) == expected, iban
    assert quality.rule_failures(rows.limit(0), iban_rule(), AS_OF).count() == 0


def test_batch_rules_share_the_pass(spark, payments, tmp_path):
    payments.write.parquet(str(tmp_path / "payments"))
    rows = spark.read.parquet(str(tmp_path / "payments"))

    def odd(amount, system):
        import pyarrow as pa
        import pyarrow.compute as pc

        hit = pc.and_(pc.is_null(amount), pc.fill_null(pc.equal(system, "SWIFT"), False))
        return pc.if_else(hit, pa.scalar("swift_sin_monto:x"), pa.scalar(None, pa.string()))

    rules = extend(RULES, iban_rule(), batch_rule("odd", WARNING, ("amount", "source_system"), odd, ()))
    counts = quality.failures_by_code(rows, rules=rules, as_of=AS_OF)
    text = plan(quality.counted(quality.with_codes(rows, rules, AS_OF), rules, ()))
    assert text.count("FileScan") == 1 and len(re.findall(r"Arrow\w*EvalPython", text)) == 1
    got = {r.rule_name: r.failed_records for r in counts.collect()}
    plainly = {r.rule_name: r.failed_records for r in quality.failures_by_code(rows, as_of=AS_OF).collect()}
    # a family outside the declared ones is counted as for rules in SQL
    hits = rows.where("amount IS NULL AND source_system = 'SWIFT'").count()
    assert hits > 0 and got == {**plainly, "swift_sin_monto": hits}
    zone = quality.evaluate(rows, extend(RULES[:1], iban_rule(CRITICAL)), AS_OF)
    assert zone.where("is_error").count() == rows.where("trim(coalesce(payment_id, '')) = ''").count()
    with pytest.raises(ValueError, match="duplicate rule name"):
        extend(RULES, iban_rule(), iban_rule())
