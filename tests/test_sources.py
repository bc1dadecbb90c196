import pytest

from glossa.plans.dictionary import Dictionary
from glossa.sources import keysets


def test_lines(spark):
    lines = ["key", "key\t2.5", "a\tb\t3", "a\tb", "x\t", "1.0 is\t 1.0 ", "f\t1f", "d\t1d", "h\t0x1p3", "i\tinf", "e\t.5e1", "w\t7\r", "", "\t4"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [(bytes(r.key).decode(), r.weight) for r in keysets.parse_lines(df).collect()]
    assert got == [
        ("key", 1.0), ("key", 2.5), ("a\tb", 3.0), ("a\tb", 1.0), ("x\t", 1.0), ("1.0 is\t 1.0 ", 1.0), ("f\t1f", 1.0), ("d\t1d", 1.0),
        ("h\t0x1p3", 1.0), ("i", float("inf")), ("e", 5.0), ("w", 7.0), ("", 1.0), ("", 4.0),
    ]


def test_one_carriage_return_goes(spark):
    df = spark.createDataFrame([("ab\r\r",), ("ab\r",), ("\r\r\r",), ("a\rb",), ("k\t2\r",)], "value string")
    assert [(bytes(r.key), r.weight) for r in keysets.parse_lines(df).collect()] == [(b"ab\r", 1.0), (b"ab", 1.0), (b"\r\r", 1.0), (b"a\rb", 1.0), (b"k", 2.0)]


def test_nan_weights_raise(spark):
    df = spark.createDataFrame([("n\tnan",)], "value string")
    with pytest.raises(Exception, match="NaN"):
        keysets.parse_lines(df).collect()


def test_bags(spark):
    df = spark.createDataFrame([("a b  a",), (None,), ("",)], "text string")
    bag = keysets.tokens(df, "text")
    assert sorted(bytes(r.key) for r in bag.collect()) == [b"a", b"a", b"b"]
    more = keysets.append(bag, bag)
    row = keysets.statistics(more).first()
    assert (row.num_keys, row.total_length) == (6, 6)
    placed = spark.createDataFrame([(0, bytearray(b"x")), (1, bytearray(b"y"))], "i long, key binary")
    assert [bytes(r.key) for r in keysets.at(placed, "i", 1).collect()] == [b"y"] and keysets.at(placed, "i", 2).isEmpty()
    nulls = spark.createDataFrame([(None, 1.0), ("k", None)], "k string, w double")
    assert [(bytes(r.key), r.weight) for r in keysets.keyset(nulls, "k", "w").collect()] == [(b"k", 1.0)]


def test_text_files(spark, tmp_path):
    (tmp_path / "keys.txt").write_bytes(b"one\t2\r\ntwo\n\nthree\t0.5\n")
    got = {bytes(r.key).decode(): r.weight for r in keysets.read_lines(spark, str(tmp_path / "keys.txt")).collect()}
    assert got == {"one": 2.0, "two": 1.0, "": 1.0, "three": 0.5}


def test_storage(spark, tmp_path):
    d = Dictionary.from_rows(spark, [b"app", b"apple", b"\xff\x00", b"application"])
    stored = d.save(str(tmp_path / "d"))
    assert stored.io_size() > 0 and stored.config == d.config and stored.num_nodes() == d.num_nodes()
    assert sorted(map(tuple, stored.keys.collect())) == sorted(map(tuple, d.keys.collect()))
    assert sorted(map(tuple, Dictionary.mmap(spark, str(tmp_path / "d")).dump().collect())) == sorted(map(tuple, d.dump().collect()))
    with pytest.raises(FileExistsError):
        d.save(str(tmp_path / "d"))
    d.save(str(tmp_path / "d"), overwrite=True)
    with pytest.raises(FileNotFoundError):
        Dictionary.load(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        Dictionary.load(spark, str(tmp_path / "empty"))
    for p in (tmp_path / "d" / "header").glob("*.txt"):
        p.write_text('{"format": "other"}')
    for p in (tmp_path / "d" / "header").glob(".*crc"):
        p.unlink()
    with pytest.raises(ValueError):
        Dictionary.load(spark, str(tmp_path / "d"))


def test_views(spark):
    Dictionary.from_rows(spark, ["b", "a", b"\xff"]).create_views("tiny")
    assert [r.key_text for r in spark.sql("select key_text from tiny_keys order by key_id").collect()] == ["a", "b", "�"]
    assert spark.sql("select max(dfs_hi) from tiny_locus").first()[0] == 2
