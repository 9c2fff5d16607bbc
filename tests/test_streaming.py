"""Following a stream of changes gives what full detection gives."""

from strandline.plans import detect
from strandline.sources.facts import Facts
from strandline.streaming.follow import follow

ACCESS = "idx long, tid long, pos long, kind string, sig string, loc string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_of_changes(spark, tmp_path):
    access = [(0, 2, 1, "WRITE", "v", "2:1"), (1, 3, 1, "READ", "v", "3:1"), (2, 3, 2, "WRITE", "w", "3:2")]
    threads = spark.createDataFrame([(1, None, 0, None), (2, 1, 0, None), (3, 1, 0, None)], "tid long, ptid long, s long, j long")
    facts = Facts(spark.createDataFrame(access, ACCESS), spark.createDataFrame([], "idx long, tid long, pos long, kind string, lk string"), threads)
    schema = "op string, seq long, " + ACCESS
    edits = [("-", 1, 1, 3, 1, "READ", "v", "3:1"), ("+", 2, 9, 2, 5, "READ", "w", "2:5"), ("-", 1, 9, 2, 5, "READ", "w", "2:5")]
    spark.createDataFrame(edits, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), facts, "file://" + str(tmp_path / "state"), lambda a, r, n: seen.append((rows(a.select("sig")), rows(r.select("sig")), n))).awaitTermination()
    assert seen == [([("w",)], [("v",)], 0)]
    assert [r.sig for r in detect.detect_races(facts).collect()] == ["v"]
