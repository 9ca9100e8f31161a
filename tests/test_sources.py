import json
import random

import pytest
from pyspark.sql import functions as F
from shopfloor.functions import text
from shopfloor.sources import contracts, export, ingest, scales, sensors, staging

HEADER = "ID,Process_Step,Component,Function,Failure_Mode,Effect,Severity,Cause,Occurrence,Current_Control,Detection"


def csv(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def line(ident, s="5", o="5", d="5", mode="Crack"):
    return f"{ident},Weld,Bracket,Hold,{mode},Leak,{s},Heat,{o},Look,{d}"


def messages(df):
    return [r.message for r in df.orderBy("row_no", "ord").collect()]


def test_row_errors_name_row_column_and_value(spark, tmp_path):
    path = csv(tmp_path, "f.csv", HEADER, line(1), line(2, s="11"), line(3, o="abc"), line(4, d=""), line(5, s="5.0"), line(6, mode="   "), line(-1), line(1), line(1))
    df = ingest.read_table(spark, path)
    scale = "out of range. Valid range is 1–10 (AIAG FMEA-4 scale)"
    assert messages(contracts.FMEA.errors(df)) == [
        f"Row 3, column 'Severity': {scale} (got 11).",
        f"Row 4, column 'Occurrence': Input should be a valid integer (got 'abc').",
        f"Row 5, column 'Detection': Input should be a valid integer (got None).",
        f"Row 6, column 'Severity': Input should be a valid integer (got 5.0).",
        f"Row 7, column 'Failure_Mode': Value error, field must not be blank or whitespace-only (got '   ').",
        f"Row 8, column 'ID': Input should be greater than 0 (got -1).",
        f"FMEA dataset is invalid: duplicate IDs found: [1].",
        f"FMEA dataset is invalid: duplicate IDs found: [1].",
    ]
    with pytest.raises(contracts.IngestError, match="Row 3, column 'Severity'"):
        ingest.load_table(spark, path, contracts.FMEA)
    twice = csv(tmp_path, "g.csv", HEADER, line(7), line(7))
    with pytest.raises(contracts.IngestError, match=r"duplicate IDs found: \[7\]"):
        ingest.load_table(spark, twice, contracts.FMEA)


def test_good_table_is_typed_and_extra_columns_stay(spark, tmp_path):
    path = csv(tmp_path, "s.csv", "stream,subgroup,value,lsl", " a ,1,2.5,x", "b,2.0,3,", "c,3,NaN,")
    df = ingest.read_table(spark, path)
    assert messages(contracts.SPC.errors(df)) == [
        "Row 4, column 'value': Input should be a valid number (got None)."
    ]
    rows = contracts.SPC.typed(df).orderBy("_row_no").collect()
    assert [(r.stream, r.subgroup, r.value, r.lsl) for r in rows] == [("a", 1, 2.5, "x"), ("b", 2, 3.0, None), ("c", 3, None, None)]


def test_shape_and_file_errors(spark, tmp_path):
    with pytest.raises(contracts.IngestError, match="Unsupported file type"):
        ingest.read_table(spark, "x.txt")
    with pytest.raises(contracts.IngestError, match="Could not read"):
        ingest.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(contracts.IngestError, match="No data rows found"):
        ingest.load_table(spark, csv(tmp_path, "e.csv", "stream,subgroup,value"), contracts.SPC)
    with pytest.raises(contracts.IngestError, match=r"Missing required column\(s\): \['value'\]"):
        ingest.load_table(spark, csv(tmp_path, "m.csv", "stream,subgroup", "a,1"), contracts.SPC)


def test_long_values_are_cut_in_messages(spark, tmp_path):
    path = csv(tmp_path, "l.csv", "stream,subgroup,value", "a,1," + "z" * 80)
    (message,) = messages(contracts.SPC.errors(ingest.read_table(spark, path)))
    assert "(got '" + "z" * 46 + "...)" in message


def test_plan_contract(spark):
    columns = "characteristic string, lsl string, usl string, target string, measurement_method string, sample_size string, frequency string, recommended_chart string, reaction_plan string, source_cause_id string, _row_no long"
    rows = [
        ("A", "1", "8", "5", "Gauge", "5", "hourly", "Xbar-R", "Stop", "  ", 2),
        ("B", "9", "8", None, "Gauge", "5", "hourly", None, "Stop", None, 3),
        ("C", "1", "8", "9", "Gauge", "5", "hourly", "EWMA", "Stop", None, 4),
        ("D", "1", "8", "9", "Gauge", "5", "hourly", None, "Stop", None, 5),
        ("A", None, None, None, "Gauge", "0", "hourly", None, "Stop", None, 6),
    ]
    df = spark.createDataFrame(rows, columns)
    got = [(r.row_no, r.column, r.msg) for r in contracts.PLAN.errors(df).orderBy("row_no", "ord").collect()]
    assert got == [
        (3, None, "usl must be greater than lsl"),
        (4, "recommended_chart", "Input should be 'Xbar-R', 'Xbar-S', 'I-MR', 'p', 'c' or 'u'"),
        (5, None, "target must be within [lsl, usl]"),
        (6, "sample_size", "Input should be greater than or equal to 1"),
        (6, None, "duplicate characteristic rows found"),
    ]
    assert contracts.PLAN.typed(df).where("characteristic = 'A'").first().source_cause_id is None
    few = df.select("characteristic", "measurement_method", "sample_size", "frequency", "reaction_plan", "_row_no").where("_row_no < 6")
    assert contracts.PLAN.errors(few).count() == 0


def test_typed_input_without_text(spark):
    df = spark.createDataFrame([("a", 1, float("nan"), 2), ("a", 0, float("inf"), 3)], "stream string, subgroup int, value double, _row_no long")
    got = [(r.row_no, r.column, r.msg) for r in contracts.SPC.errors(df).orderBy("row_no", "ord").collect()]
    assert got == [
        (2, "value", "Input should be a valid number"),
        (3, "subgroup", "Input should be greater than or equal to 1"),
        (3, "value", "Input should be a finite number"),
    ]


def test_row_numbers_hold_across_splits(spark, tmp_path):
    lines = ["stream,subgroup,value"] + [f"s,{i},{i}" for i in range(1, 4001)]
    path = csv(tmp_path, "big.csv", *lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = ingest.read_table(spark, path)
        assert df.rdd.getNumPartitions() > 3
        assert df.where(F.col("_row_no") != F.col("subgroup").cast("long") + 1).count() == 0 and df.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sensor_files(spark, tmp_path):
    data = csv(tmp_path, "m.data", "1.5 NaN 3", " 4 5  6", "7 8")
    label = csv(tmp_path, "l.data", '-1 "19/07/2008 11:55:00"', '1 "not a time"', '-1 "31/02/2008 00:00:00"')
    matrix, labels = sensors.load_sensor_study(spark, data, label)
    got = {(r.row_id, r.signal): r.value for r in matrix.collect()}
    assert got == {
        (0, "sensor_000"): 1.5, (0, "sensor_001"): None, (0, "sensor_002"): 3.0,
        (1, "sensor_000"): 4.0, (1, "sensor_001"): 5.0, (1, "sensor_002"): 6.0,
        (2, "sensor_000"): 7.0, (2, "sensor_001"): 8.0, (2, "sensor_002"): None,
    }
    stamped = labels.orderBy("row_id").collect()
    assert [r.label for r in stamped] == [-1, 1, -1] and str(stamped[0].timestamp) == "2008-07-19 11:55:00"
    assert stamped[1].timestamp is None and stamped[2].timestamp is None
    assert sensors.with_labels(matrix, labels).where("label = 1").count() == 3
    with pytest.raises(contracts.IngestError, match="row-count mismatch: 3 feature rows vs 1"):
        sensors.load_sensor_study(spark, data, csv(tmp_path, "s.data", '-1 "19/07/2008 11:55:00"'))
    with pytest.raises(contracts.IngestError, match="out-of-domain"):
        sensors.load_sensor_study(spark, data, csv(tmp_path, "b.data", '-1 "a"', '0 "b"', '1 "c"'))


def test_an_ordered_set_of_files_reads_as_one(spark, tmp_path):
    """Part 2 comes before part 10, blank lines and empty files do not count, and splits may cut anywhere."""
    folder = tmp_path / "parts"
    folder.mkdir()
    rng = random.Random(3)
    expected = []
    for part in range(12):
        lines = []
        for _ in range(rng.randrange(0, 60) if part != 4 else 0):
            expected.append(f"{len(expected)}.5 {part}")
            lines += [expected[-1], ""] if rng.random() < 0.2 else [expected[-1]]
        (folder / f"part-{part}.txt").write_text("\n".join(lines) + "\n" * bool(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        raw = spark.read.text(str(folder)).where(F.trim("value") != "")
        found = [r.value for r in ingest.number_file_set(raw, "n").orderBy("n").collect()]
        numbers = sorted(r.n for r in ingest.number_file_set(raw, "n").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == expected and numbers == list(range(len(expected)))


def test_matrix_and_labels_cut_into_different_files(spark, tmp_path):
    rng = random.Random(5)
    units = [(k, [rng.choice([None, float(k), k / 7]) for _ in range(3)], rng.choice([-1, 1]), f"2024-02-{1 + k % 28:02} 10:00:00") for k in range(300)]
    frame = spark.createDataFrame(units, "k long, cells array<double>, label int, t string").withColumn("timestamp", F.to_timestamp("t"))
    data, label = str(tmp_path / "x.data"), str(tmp_path / "x.labels")
    sensors.write_matrix(frame.repartition(5), data, "k", files=11)
    sensors.write_labels(frame.repartition(3), label, "k", files=4)
    assert len(list((tmp_path / "x.data").glob("part-*"))) > 5
    found = {(r.row_id, r.signal): (r.value, r.label, str(r.timestamp)) for r in sensors.read_labelled(spark, data, label).collect()}
    assert found == {(k, f"sensor_{i:03}"): (v, lab, t) for k, vs, lab, t in units for i, v in enumerate(vs)}
    sensors.write_labels(frame.where("k > 0"), str(tmp_path / "short"), "k")
    with pytest.raises(contracts.IngestError, match="row-count mismatch: 300 feature rows vs 299"):
        sensors.read_labelled(spark, data, str(tmp_path / "short"))


def test_rating_scales(spark, tmp_path):
    good = {f: {str(i): f"{f} {i}" for i in range(1, 11)} for f in scales.FACTORS}
    write = lambda name, doc: csv(tmp_path, name, json.dumps(doc))
    loaded = scales.load_scales(spark, write("ok.json", {"name": "x", **good}))
    assert [r.Score for r in scales.scale_table(loaded, "severity").collect()] == list(range(10, 0, -1))
    assert scales.scale_errors(scales.default_scales(spark).withColumn("raw_key", F.col("score").cast("string"))).count() == 0
    for name, change, message in [
        ("missing", {"severity": {k: v for k, v in good["severity"].items() if k != "4"}}, "missing rating 4"),
        ("extra", {"detection": {**good["detection"], "11": "x"}}, "unexpected rating 11"),
        ("blank", {"occurrence": {**good["occurrence"], "2": " "}}, "blank description"),
        ("collide", {"severity": {**good["severity"], "1.0": "again"}}, "collide on rating 1"),
    ]:
        with pytest.raises(ValueError, match=message):
            scales.load_scales(spark, write(f"{name}.json", {**good, **change}))
    with pytest.raises(ValueError, match="Could not parse"):
        scales.load_scales(spark, csv(tmp_path, "bad.json", "{not json"))


def test_escaping_and_csv_round_trip(spark, tmp_path):
    cases = [("=1", "'=1"), ("+1", "'+1"), ("-1", "'-1"), ("@x", "'@x"), ("\tx", "'\tx"), ("\rx", "'\rx"), ("  =x", "'  =x"), ("\n-x", "'\n-x"), ("  x", "  x"), ("'=1", "'=1"), ("a=b", "a=b"), (None, None)]
    df = spark.createDataFrame(cases, "raw string, safe string")
    assert df.where(~text.spreadsheet_safe(F.col("raw")).eqNullSafe(F.col("safe"))).count() == 0
    once = export.sanitized(df)
    assert once.exceptAll(export.sanitized(once)).count() == 0
    numbers = spark.createDataFrame([(-5, -1.5, "=x"), (1, 2.0, 'say "hi", now')], "n int, d double, t string")
    export.write_csv(numbers, str(tmp_path / "out.csv"))
    back = ingest.read_table(spark, str(tmp_path / "out.csv")).orderBy("n").collect()
    assert [(r.n, r.d, r.t) for r in back] == [("-5", "-1.5", "'=x"), ("1", "2.0", 'say "hi", now')]


def test_number_text(spark):
    row = spark.range(1).select(
        text.fixed_point(F.lit(1.23456789), 4), text.fixed_point(F.lit(None).cast("double"), 4), text.fixed_point(F.lit(float("inf")), 2), text.percent(F.lit(13.9226)), text.percent(F.lit(None).cast("double"))
    ).first()
    assert tuple(row) == ("1.2346", "N/A", "inf", "13.92%", "N/A")


def test_action_errors_are_addressed_by_id(spark):
    edited = spark.createDataFrame([(4, "Ann", "Done", "2026-01-01", 3), (8, "Bob", None, "soon", 11), (9, " ", "Nope", "never", 99)], "row_id long, owner string, status string, due string, s_after int")
    got = {r.message for r in contracts.action_errors(edited).collect()}
    assert got == {
        "Row ID 4, 'status': 'Done' is not a valid status",
        "Row ID 8, 'due': Input should be a valid date",
        "Row ID 8, 's_after': Input should be less than or equal to 10",
    }


def test_staged_tables_can_be_released(spark):
    other = staging.stage(spark.range(2).toDF("x"), "probe")
    with staging.scope() as mine:
        df = staging.stage(spark.range(3).toDF("x"), "probe")
        staging.stage_all({"a": df, "b": df})
    assert df.count() == 3 and len(mine.paths) == 3
    assert mine.release(spark) == 3 and other.count() == 2


def test_identifiers_beyond_double_precision_keep_their_value(spark):
    big = 2**53
    rows = [(str(big + 1),), (str(big),), (str(big + 1),), ("99999999999999999999",), (" 7 ",)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{contracts.ROW_NO} long, ID string")
    assert [r.ID for r in contracts.FMEA.typed(df).collect()] == [big + 1, big, big + 1, None, 7]
    assert [(r.row_no, r.value) for r in contracts.FMEA.duplicates(df).collect()] == [(2, str(big + 1))]
    assert [r.row_no for r in contracts.FMEA.row_errors(df).collect()] == [3]
    typed = spark.createDataFrame([(0, big + 1), (1, None)], f"{contracts.ROW_NO} long, ID long")
    assert [r.ID for r in contracts.FMEA.typed(typed).collect()] == [big + 1, None]
