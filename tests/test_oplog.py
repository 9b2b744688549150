"""Operation lines in batches."""

from quiverdf.plans.graph import Graph
from quiverdf.streaming import oplog


def test_properties_and_repeats(spark, tmp_path):
    empty = Graph(spark.createDataFrame([], "id string, type string"), spark.createDataFrame([], "tail string, head string"))
    follower = oplog.Follower(spark, f"file://{tmp_path}", empty)
    line = oplog.line
    add = line(1, 4, "arc", "A", "hit", "M_CNT", 2, "B")
    batches = [
        [line(1, 1, "vxn", "A", "t"), line(1, 2, "vps", "A", "size", 3), line(1, 3, "vps", "A", "size", 5), add, add, line(1, 5, "vps", "A", "name", "x y")],
        [add, line(1, 2, "vps", "A", "size", 3), line(2, 1, "vps", "B", "name", "b"), line(2, 2, "arc", "A", "hit", "M_CNT", 1, "B")],
    ]
    for k, lines in enumerate(batches):
        follower._apply(spark.createDataFrame([(x,) for x in lines], "value string"), k)
    rows = {r["id"]: (r["num"] or {}, r["text"] or {}) for r in follower.kept.vertices.collect()}
    assert rows == {"A": ({"size": 5.0}, {"name": "x y"}), "B": ({}, {"name": "b"})}
    assert [r["value"] for r in follower.kept.arcs.collect()] == [3.0]
    assert follower.kept.property_types == {"size": "real", "name": "str"}


def followed(spark, folder, lines):
    empty = Graph(spark.createDataFrame([], "id string, type string"), spark.createDataFrame([], "tail string, head string"))
    follower = oplog.Follower(spark, f"file://{folder}", empty)
    if lines:
        follower._apply(spark.createDataFrame([(x,) for x in lines], "value string"), 0)
    return follower


def test_a_new_follower_goes_on_from_the_last_state(spark, tmp_path):
    line = oplog.line
    first = [line(1, 1, "vxn", "A", "t"), line(1, 2, "vps", "A", "size", 3), line(1, 3, "arc", "A", "hit", "M_CNT", 2, "B")]
    followed(spark, tmp_path, first)
    again = followed(spark, tmp_path, [*first, line(2, 1, "arc", "A", "hit", "M_CNT", 5, "B")])
    assert [(r["tail"], r["value"]) for r in again.kept.arcs.collect()] == [("A", 7.0)]
    assert again.kept.property_types == {"size": "real"}
    assert followed(spark, tmp_path, []).kept.arcs.count() == 1


def test_operations_take_effect_in_their_order(spark, tmp_path):
    line = oplog.line
    ops = [
        line(1, 1, "vxn", "A", "old"), line(1, 2, "vps", "A", "gone", 1), line(1, 3, "arc", "A", "r", "M_INT", 1, "B"), line(1, 4, "vxd", "A"), line(1, 5, "vxn", "A", "new"), line(1, 6, "vps", "A", "kept", 2),
        line(1, 7, "arc", "A", "r", "M_INT", 9, "C"), line(2, 1, "vxn", "D", "t"), line(2, 2, "vxd", "D"), line(2, 3, "arc", "C", "r", "M_CNT", 4, "B"), line(2, 4, "vod", "C"), line(2, 5, "arc", "C", "r", "M_CNT", 3, "B"),
        line(2, 6, "arc", "C", "s", "M_INT", 1, "E"), line(2, 7, "vid", "E"), line(2, 8, "arc", "C", "t", "M_INT", 1, "F"), line(2, 9, "ard", "C", "t", "M_INT", "F"), line(2, 10, "arc", "C", "t", "M_INT", 8, "F"),
        line(3, 1, "vxn", "G", "a"), line(3, 2, "vxt", "G", "b"), line(3, 3, "vxr", "G", 2, 3), line(3, 4, "vvs", "G", "1,2.5"), line(3, 5, "vps", "G", "x", 1), line(3, 6, "vpd", "G", "x"), line(3, 7, "vps", "G", "y", "text"),
        line(3, 8, "vxn", "H", "a"), line(3, 9, "vps", "H", "x", 1), line(3, 10, "vpc", "H"), line(3, 11, "vps", "H", "z", 5), line(3, 12, "vvs", "H", "1"), line(3, 13, "vvd", "H"), line(3, 14, "vxx", "H", 50), line(3, 15, "vxc", "G", 1),
    ]
    graph = followed(spark, tmp_path, ops[::-1]).kept
    arcs = {(r["tail"], r["rel"], r["head"]): r["value"] for r in graph.arcs.collect()}
    assert arcs == {("A", "r", "C"): 9.0, ("C", "r", "B"): 3.0, ("C", "t", "F"): 8.0}
    rows = {r["id"]: r for r in graph.vertices.collect()}
    assert "D" not in rows and rows["A"]["type"] == "new" and rows["A"]["num"] == {"kept": 2.0}
    g, h = rows["G"], rows["H"]
    assert (g["type"], g["c1"], g["c0"], g["vector"], g["num"], g["text"], g["virtual"]) == ("b", 2.0, 3.0, [1.0, 2.5], {}, {"y": "text"}, True)
    assert (h["num"], h["vector"], h["tmx"]) == ({"z": 5.0}, None, 50)
    left = followed(spark, tmp_path, [oplog.line(4, 1, "evx", 60)]).kept
    assert "H" not in {r["id"] for r in left.vertices.collect()}
    assert followed(spark, tmp_path, [oplog.line(5, 1, "grt"), oplog.line(5, 2, "vxn", "Z", "t")]).kept.vertices.select("id").collect()[0]["id"] == "Z"
