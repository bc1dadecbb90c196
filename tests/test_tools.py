import io

from glossa.cli import run
from glossa.plans.dictionary import Dictionary
from glossa.streaming import common_prefix_stream, lookup_stream, predictive_count_stream

WORDS = "a app apple application apply banana band".split()


def call(spark, argv, stdin=()):
    out, err = io.StringIO(), io.StringIO()
    return run(spark, argv, stdin, out, err), out.getvalue(), err.getvalue()


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "d")
    code, _, err = call(spark, ["build", "-o", path], [w + "\n" for w in WORDS])
    assert code == 0 and "#keys: 7\n#nodes: 10\n" in err
    assert call(spark, ["lookup", path], ["a\n", "apple\n", "banana\n", "bandit\n", "zebra"])[:2] == (0, "0\ta\n4\tapple\n2\tbanana\n-1\tbandit\n-1\tzebra\n")
    assert call(spark, ["common-prefix-search", path], ["application\n", "x\n"])[1] == "3 found\n0\ta\tapplication\n1\tapp\tapplication\n5\tapplication\tapplication\nnot found\n"
    assert call(spark, ["predictive-search", "-n", "2", path], ["ap\n"])[1] == "4 found\n1\tapp\tap\n4\tapple\tap\n"
    assert call(spark, ["reverse-lookup", path], [" 3 \n", "0\n"])[1] == "3\tband\n0\ta\n"
    assert call(spark, ["reverse-lookup", path], ["x\n"])[0] == 30
    assert call(spark, ["reverse-lookup", path], ["7\n"])[0] == 30
    code, out, err = call(spark, ["dump", "-d", "|", path])
    assert (code, out, err) == (0, "a|app|apple|application|apply|banana|band|", "#keys: 7\n")
    assert call(spark, ["lookup", str(tmp_path / "none")])[0] == 20
    assert call(spark, ["dump", str(tmp_path / "none")])[0] == 20
    assert call(spark, ["build", "-n", "0", "-o", path])[0] == 1
    assert call(spark, ["build", "-c", "9", "-o", path])[0] == 1
    assert call(spark, ["build", "-o", path], ["x\n"])[0] == 30
    assert call(spark, ["build", "-o", path + "2", str(tmp_path / "none.txt")])[0] == 10


def test_label_order_and_weights(spark, tmp_path):
    (tmp_path / "k.txt").write_text("b\t5\na\t1\n")
    for flag, first in (("-w", "b"), ("-l", "a")):
        path = str(tmp_path / flag)
        assert call(spark, ["build", flag, "-b", "-c", "5", "-n", "2", "-o", path, str(tmp_path / "k.txt")])[0] == 0
        assert call(spark, ["dump", path])[1].splitlines()[0] == first
        d = Dictionary.load(spark, path)
        assert (d.tail_mode, d.cache_level, d.num_tries) == ("binary", "huge", 2)


def test_streams(spark, tmp_path):
    d = Dictionary.from_rows(spark, WORDS).cache()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.txt").write_text("apple\nap\nzebra\n")
    lines = spark.readStream.text(str(tmp_path / "in"))

    def result(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {r.value: r.key_id for r in result(lookup_stream(lines, d), "s1")} == {"apple": 4, "ap": -1, "zebra": -1}
    assert {r.value: r.n_found for r in result(predictive_count_stream(lines, d), "s2")} == {"apple": 1, "ap": 4, "zebra": 0}
    assert sorted((r.value, bytes(r.key).decode()) for r in result(common_prefix_stream(lines, d), "s3")) == [("ap", "a"), ("apple", "a"), ("apple", "app"), ("apple", "apple")]
