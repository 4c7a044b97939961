"""CSV with line ends in its fields, read in ranges, against Spark's one-task reader."""

import random

import pytest

from veilscan.sources import csv_ranges as C


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def made_file(seed, records, end="\n"):
    rng = random.Random(seed)
    lines = [f"file,message,extra{end}"]
    for k in range(records):
        kind = rng.randrange(8)
        text = "".join(rng.choice(['a', 'é', '"', '""', ',', end, end + end, ' x ', '","']) for _ in range(rng.randrange(40)))
        if kind == 0:
            text = ('long "line", ' + end) * rng.randrange(40, 200)
        row = [str(k), quoted(text), ["", '""', "plain", quoted("q,q")][rng.randrange(4)]]
        if kind == 1:
            row = [str(k), "no quotes at all"]
        if kind == 2:
            lines.append(end)
        lines.append(",".join(row) + end)
    return "".join(lines)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "397", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected(spark, path):
    return rows(spark.read.csv(str(path), header=True, multiLine=True, escape='"'))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_equal_the_one_task_reader(spark, tmp_path, small_ranges, end):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(made_file(k, 25, end).encode())
    read = C.read(spark, str(tmp_path))
    assert read.columns == ["file", "message", "extra"]
    got = rows(read)
    assert len(got) == 75 and got == expected(spark, tmp_path)


def test_a_record_longer_than_many_ranges_and_a_long_header(spark, tmp_path, small_ranges):
    names = ["file", quoted("message\nin two, lines " * 20)]
    body = 'x "y"\n,' * 500
    (tmp_path / "a.csv").write_text(",".join(names) + "\n1," + quoted(body) + "\n2,b\n")
    got = rows(C.read(spark, str(tmp_path / "a.csv")))
    assert got == [("1", body), ("2", "b")]


def test_odd_files(spark, tmp_path, small_ranges):
    cases = {
        "empty quotes": 'a,b\n"",\n,""\n"",x\nx,"" \n"""",""""""\n"" ,x\n"a" ,"b" \n "a","b"\n c,d\n', "tail": 'a,b\n"x"y,2\n"x"y"z,"q"r\n', "no end": 'a,b\n1,2', "stray quotes": 'a,b\n5" pipe,6" pipe\nx,"y"\n', "only header": "a,b\n",
        "too many": "a,b\n1,2,3\n", "too few": "a,b\n1\n", "blank lines": "a,b\n\n\n1,2\n\n", "quote in plain": 'a,b\nx"y,"1\n2"\n',
    }
    for name, text in cases.items():
        path = tmp_path / f"{name.replace(' ', '_')}.csv"
        path.write_text(text)
        assert rows(C.read(spark, str(path))) == expected(spark, path), name
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
    assert rows(C.read(spark, str(tmp_path / "open.csv"))) == [("1", "never closed\n2,3")]
    (tmp_path / "bytes.csv").write_bytes(b'a,b\n1,"\xff\xfe"\n')
    assert rows(C.read(spark, str(tmp_path / "bytes.csv"))) == [("1", "��")]


def test_states_of_lines():
    text = b'1,"a ""quoted"" word, and\nmore ""\n"" end",x"y,"z\n"\nplain'
    inside, states = False, []
    for line in text.split(b"\n"):
        inside = C.inside_after(line, inside)
        states.append(inside)
    assert states == [True, True, True, False, False]
    assert C.fields(text.split(b"\nplain")[0], 4) == ["1", 'a "quoted" word, and\nmore "\n" end', 'x"y', "z\n"]


def test_a_mail_corpus_uses_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "m.csv").write_text("file,message\n" + "".join(f'm{k},"Subject: S{k}\n\nbody ""{k}"""\n' for k in range(200)))
    read = C.read(spark, str(tmp_path / "m.csv"))
    assert read.rdd.getNumPartitions() > 10
    assert ("m105", 'Subject: S105\n\nbody "105"') in rows(read)
