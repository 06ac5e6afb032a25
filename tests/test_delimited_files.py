import random

import pytest
from pyspark.sql import functions as F

from opinara.sources import readers, records, sinks

VALUES = ["a", "", None, "x,y", 'say "hi"', "two\nlines", "cr\r\nlf", '"', "\n\n", "\\", "é👍", " lead and trail ", "\\N", "\\\\N", "\\N2", ",", "lone\r", "\r", "# no comment", '""', "a\n\"b\n\"\nc"]
SCHEMA = "t string, n int, z string"


def field(value):
    if value is None:
        return ""
    return '"' + value.replace('"', '""') + '"' if not value or any(c in value for c in ',"\n\r') else value


@pytest.fixture
def split_size(spark):
    """Sets how many bytes of a file one task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        for n, v in zip(names, (size, "0", "1")):
            spark.conf.set(n, v)

    yield use
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def rows_of(df):
    return [(r["t"], r["n"], r["z"]) for r in df.orderBy("n").collect()]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_one_file_gives_equal_rows_however_it_is_split(spark, tmp_path, split_size, newline):
    rng = random.Random(newline)
    plain = [v for v in VALUES if v not in ("\\N", "\\\\N", "lone\r", "\r")]
    rows = [(rng.choice(plain), i, rng.choice(plain)) for i in range(2000)]
    rows[700] = ("long\n" * 900 + 'quoted "text"', 700, "x")
    path = tmp_path / "one.csv"
    path.write_text("t,\"n\nm\",z" + newline + "".join(f"{field(t)},{n},{field(z)}{newline}" for t, n, z in rows), newline="")
    parts = set()
    for size in ("128m", str(path.stat().st_size // 15), "500"):
        split_size(size)
        parts.add(spark.read.text(str(path)).rdd.getNumPartitions())
        assert rows_of(readers.read_csv(spark, str(path), SCHEMA)) == rows
    assert 1 in parts and 16 in parts and max(parts) > 50


def test_order_columns_follow_the_file(spark, tmp_path, split_size):
    rng = random.Random(3)
    path = tmp_path / "one.csv"
    path.write_text("t,n,z\n" + "".join(f"{field(rng.choice(VALUES[:9]))},{i},x\n" for i in range(500)), newline="")
    split_size("700")
    rows = readers.read_csv(spark, str(path), SCHEMA, with_order=True).orderBy("source_file", "block_start", "row_order").collect()
    assert [r["n"] for r in rows] == list(range(500))


def test_round_trip_keeps_null_and_empty(spark, tmp_path, split_size):
    rows = [(v, i, w) for i, (v, w) in enumerate((v, w) for v in VALUES for w in VALUES)]
    df = spark.createDataFrame(rows, SCHEMA)
    for size in ("128m", "300"):
        split_size(size)
        path = str(tmp_path / f"out-{size}")
        sinks.write_csv(df.repartition(3), path)
        assert rows_of(readers.read_csv(spark, path, SCHEMA)) == rows


def test_files_of_other_tools(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('t,n,z\n"",1,\n\\N,2,\\\\N\nshort\na,3,b,more\n\nlast,4,"open\nto the end', newline="")
    assert [tuple(r) for r in readers.read_csv(spark, str(path), SCHEMA).collect()] == [
        ("", 1, None), (None, 2, "\\N"), ("short", None, None), ("a", 3, "b"), ("last", 4, "open\nto the end")]
    assert [tuple(r) for r in readers.read_csv(spark, str(path), SCHEMA, mark="").limit(2).collect()] == [(None, 1, None), ("\\N", 2, "\\\\N")]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert readers.read_csv(spark, str(empty), SCHEMA).collect() == []
    empty.write_text("t,n,z\n")
    assert readers.read_csv(spark, str(empty), SCHEMA).collect() == []
    with pytest.raises(readers.MissingData):
        readers.read_csv(spark, str(tmp_path / "nowhere"), SCHEMA)


def test_only_pieces_at_the_ends_of_splits_move(spark, tmp_path, split_size):
    path = tmp_path / "one.csv"
    path.write_text("t,n,z\n" + "".join(f'"a\n{i}",{i},x\n' for i in range(3000)), newline="")
    split_size("2000")
    read = records.lines(spark, str(path))
    assert records.starts_inside(read, '"')
    found = records.records(spark, str(path))
    assert found.count() == 3001
    pieces = found.groupBy("source_file", "block_start").count()
    assert pieces.agg(F.sum("count")).first()[0] == 3001 and found.select("block_start", "row_order").distinct().count() == 3001


def test_only_texts_with_a_backslash_in_front_are_searched(spark):
    from pyspark.sql import functions as F

    from opinara.functions import text
    from opinara.sources import readers

    values = ["\\N", "\\\\N", "N", "\\NN", "a\\N", "", None, "\\"]
    df = spark.createDataFrame([(x,) for x in values], "x string")
    changed = [r[0] for r in df.select(readers.slashed("x", r"^(\\+N)$", r"\\$1")).collect()]
    assert changed == ["\\\\N", "\\\\\\N", "N", "\\NN", "a\\N", "", None, "\\"]
    back = spark.createDataFrame([(x,) for x in changed], "x string").select(readers.slashed("x", r"^\\(\\+N)$", "$1"))
    assert [r[0] for r in back.collect()] == values
    # A word, being bound already, is handed to its lemma without an array around it.
    lemma = text.remove_stop_words(F.lit("a b"), ["x"], lambda w: F.upper(w))
    assert spark.range(1).select(lemma.alias("x")).first()["x"] == "A B"
    assert "array(namedlambda" not in spark.range(1).select(text.remove_stop_words(F.col("id").cast("string"), ["x"], F.upper))._jdf.queryExecution().analyzed().toString()
