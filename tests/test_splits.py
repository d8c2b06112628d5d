import random

import pytest

from vitalspark.sources import files, splits


@pytest.fixture
def small_parts(spark):
    """Ranges of some hundred bytes, so that a small file is read by many tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    yield lambda size: [spark.conf.set(k, v) for k, v in (keys | {"spark.sql.files.maxPartitionBytes": str(size)}).items()]
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, text):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(text.encode())


def message(i):
    segments = ["MSH|^~\\&|a", f"PID|1||P{i}", f"DG1|1||C34.{i % 9}|NSCLC x", "MSH|^~\\&|oru", *([f"PID|1||P{i}"] if i % 2 else []), f"OBX|1|NM|718-7^Hb||{i}", "MSH|^~\\&|rde", "RXA|0|1|||1^Drug"]
    return ["\r", "\n", "\r\n"][i % 3].join(segments[: 2 if i % 5 == 0 else 8])


@pytest.mark.parametrize("size", [97, 700, 10_000])
def test_messages_over_borders(spark, tmp_path, small_parts, size):
    """One file of many messages gives the rows of one file a message, by several tasks."""
    for i in range(120):
        write(tmp_path / "one" / f"{i}.hl7", message(i))
    write(tmp_path / "many" / "all.hl7", "ZZZ|stray\r" + "\r".join(map(message, range(120))) + "\n\n")
    write(tmp_path / "many" / "empty.hl7", "")
    want = files.hl7_records(files.read(spark, str(tmp_path / "one"))).drop("name").collect()
    small_parts(size)
    read = splits.read_messages(spark, str(tmp_path / "many"))
    got = files.hl7_records(read).drop("name").collect()
    assert splits._lines(spark, str(tmp_path / "many"), None).rdd.getNumPartitions() > (1 if size < 10_000 else 0)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 96
    assert read.count() == 121 and read.select("name").distinct().count() == 121  # the stray line is a record without a patient


def test_a_patient_named_past_a_border(spark, tmp_path, small_parts):
    """Header and PID in different ranges, a record longer than several ranges, and one of several messages that each name the patient."""
    again = [x for i in range(6) for x in (f"MSH|{i}", "PID|1||C", f"OBX|{i}|{'v' * 20}")]
    long = "\r".join(["MSH|x", "PID|1||A"] + [f"NTE|{i}|{'y' * 50}" for i in range(40)])
    write(tmp_path / "in" / "a.hl7", "\r".join([long, "MSH|" + "z" * 95, "PID|1||B", "MSH|oru", "OBX|1|NM|718-7", *again]))
    for size in (60, 101, 333):
        small_parts(size)
        got = sorted(r.text for r in splits.read_messages(spark, str(tmp_path / "in")).collect())
        assert got == sorted([long, "MSH|" + "z" * 95 + "\rPID|1||B\rMSH|oru\rOBX|1|NM|718-7", "\r".join(again)])


@pytest.mark.parametrize("size", [50, 131, 20_000])
def test_extracts_over_borders(spark, tmp_path, small_parts, size):
    """Quoted cells with commas, doubled quotes and line breaks; stray quotes; a byte order mark."""
    rng = random.Random(3)
    cells = ["", "plain", 'x 5" tube', '"a, b"', '"say ""hi"""', '"two\nlines"', '"one\r\n\r\ntwo, ""q""\nend"', '""', " padded "]
    for name in ("a", "b"):
        rows = ["Patient_ID,histology,start_date"] + [f"P{rng.randrange(9)},{rng.choice(cells)},{rng.choice(['2020-01-02', '', '2021-05-06'])}" for _ in range(150)]
        write(tmp_path / "in" / f"{name}.csv", "﻿" * (name == "a") + "\r\n".join(rows) + "\r\n\r\n")
    plain = lambda rows: sorted(((r.name.rsplit("/")[-1], sorted(r.row.items())) for r in sorted(rows, key=lambda r: (r.name, r.line))), key=lambda x: x[0])
    want = plain(files.csv_rows(files.read(spark, str(tmp_path / "in"))).collect())
    records = lambda rows: sorted(str(r) for r in files.extract_records(rows).drop("name").collect())
    whole = records(files.csv_rows(files.read(spark, str(tmp_path / "in"))))
    small_parts(size)
    rows = splits.read_extract_rows(spark, str(tmp_path / "in"))
    assert plain(rows.collect()) == want and len(want) == 300
    assert records(rows) == whole


def test_ends_inside():
    for line, outside, inside in (("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('"a"",', True, False), ('a"b,c', False, False), ('","', False, True), ('x,"",y', False, True), ('",', True, False), ('"', True, False)):
        assert splits.ends_inside(line, False) == outside, line
        assert splits.ends_inside(line, True) == inside, line
