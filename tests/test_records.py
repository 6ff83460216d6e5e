"""CSV records read in splits, against Spark's own reading of whole files."""

import csv
import io
import random

import pytest
from conftest import dicts

from tallyline.operators.cleaning import clean_employees
from tallyline.sources.batches import with_position
from tallyline.sources.employees import FILE_ORDER, read_employees_csv
from tallyline.sources.records import leaves_open, read_records


@pytest.fixture
def split_bytes(spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, old)


def write(folder, name, text):
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as file:
        file.write(text)


def as_whole(spark, path):
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
    return spark.read.options(**options).csv(path)


def cell(rng):
    kinds = ['plain', 'with "quotes" in it', "two\nlines", "a, b", '"', "", "N/A", "three\n\nlines\n", 'x,"\n"y', "été", " sp "]
    return rng.choice(kinds) + (str(rng.randint(0, 999)) if rng.random() < 0.7 else "")


def test_lines_that_leave_a_cell_open(spark):
    cases = {
        '': False, 'a,b': False, '"a': True, '"a"': False, '"a""': True, '"a"""': False, 'a,"b': True, 'a,"b"': False,
        'a"b': False, 'a"b,"c': True, '"a,b",c"': False, '"abc,""def': True, '"abc,"def"': False, ',"': True, '"",""': False,
        '"""': True, '""""': False, '"a"x,"b': True, '",': True, 'a,""': False, 'a,"""': True, '"a, "b", c': False,
    }
    frame = spark.createDataFrame(list(cases.items()), "line string, want boolean")
    wrong = [(r.line, r.want) for r in frame.withColumn("got", leaves_open(frame.line)).where("got <> want").collect()]
    assert wrong == []
    for line, want in cases.items():
        if line and not line.startswith('"a, "') and '"a"x' not in line:
            # Python's reader goes on to the next line where a cell is open.
            assert len(list(csv.reader(io.StringIO(f"{line}\nz\n")))) == (1 if want else 2), line


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [64, 300, 5000])
def test_rows_and_order_of_whole_files(spark, folder, split_bytes, size, end):
    rng = random.Random(size)
    for name in ("a.csv", "b.csv"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["email", "full_name", "practice", "level", "location"])
        for i in range(150):
            writer.writerow([f"{name}{i}@x.io", *(cell(rng) for _ in range(4))])
            if rng.random() < 0.1:
                out.write(end)
        long = "x\ny, \"\"z\n" * 200
        out.write(f'long@x.io,"{long}",a,b,c{end}last@x.io,"no end of line",,,"')
        out.write('"' if name == "a.csv" else 'still open')
        write(folder, name, out.getvalue())
    for name in ("a.csv", "b.csv"):
        want = [tuple(r) for r in as_whole(spark, f"{folder}/{name}").collect()]
        split_bytes(size)
        table = read_employees_csv(spark, f"{folder}/{name}")
        if size < 5000:
            assert spark.read.text(f"{folder}/{name}").rdd.getNumPartitions() > 8
        got = [tuple(r)[:5] for r in table.orderBy(*FILE_ORDER).collect()]
        empty = {"", "N/A"}
        assert got == [tuple(None if c in empty else c for c in r) for r in want]
    both = read_employees_csv(spark, folder)
    assert both.count() == 2 * 152 and both.select(FILE_ORDER[0]).distinct().count() == 2


def test_records_that_span_many_splits(spark, folder, split_bytes):
    write(folder, "a.csv", "\n\nh1,h2\n" + '1,"' + "line\n" * 500 + '"\n2,b\n3,"' + '""\n' * 300 + '"\n4,d')
    split_bytes(200)
    lines = with_position(spark.read.option("lineSep", "\n").text(folder))
    rows = read_records(lines).orderBy("_split", "_row").collect()
    assert [r.first for r in rows] == [True, False, False, False, False]
    assert [r.record for r in rows] == ["h1,h2", '1,"' + "line\n" * 500 + '"', "2,b", '3,"' + '""\n' * 300 + '"', "4,d"]


def test_first_of_equal_mails_over_splits(spark, folder, split_bytes):
    rows = "".join(f'm{i % 40}@x.io,"name\n{i}",P,L{i},C\n' for i in range(400))
    write(folder, "a.csv", "email,full_name,practice,level,location\n" + rows)
    split_bytes(256)
    kept = dicts(clean_employees(read_employees_csv(spark, folder)))
    assert sorted((r["email"], r["level"]) for r in kept) == sorted((f"m{i}@x.io", f"L{i}") for i in range(40))


def test_another_header_fails(spark, folder):
    write(folder, "a.csv", "email,level\na,1\n")
    write(folder, "b.csv", "level,email\n1,a\n")
    with pytest.raises(Exception, match="another header"):
        read_employees_csv(spark, folder).collect()


def test_file_is_no_unit_of_parallelism(spark, folder):
    write(folder, "a.csv", "email,level\na,1\n")
    plan = read_employees_csv(spark, folder)._jdf.queryExecution().executedPlan().toString()
    # Text is dealt by file and split, or by file and record; windows by file see splits only.
    for line in plan.splitlines():
        if "Exchange hashpartitioning(source_file#" in line and "_split" not in line and "_began" not in line:
            assert "value" not in line
    assert "MapInArrow" not in plan and "Python" not in plan
