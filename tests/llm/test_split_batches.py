"""Splits of records that come in batches."""

from framelake.llm import splits as S

SHAPE = "e bigint, op string, p bigint, repo string, w int"


def test_quarantine_stays(spark):
    first = spark.createDataFrame([(1, 1, "train"), (2, 2, "test")], "node bigint, component bigint, split string")
    rows = spark.createDataFrame([(1, "a", None, "r", 1), (2, "b", None, "r", 1), (3, "a", 2, "r", 1)], SHAPE)
    shares = spark.createDataFrame([], "home string, train double, val double, test double")
    for _ in range(2):
        first = S.split_records(rows, "e", ["op"], "p", "repo", "w", shares, previous=first).cache()
        assert {(r["split"], r["status"]) for r in first.collect()} == {("quarantine", "quarantined")}


def test_new_records_alone(spark, tmp_path):
    shares = spark.createDataFrame([], "home string, train double, val double, test double")
    batches = [
        [*[(i, f"op{i}", None, "r", 1) for i in range(20)], (20, "w1", 77, "r", 1), (21, "w2", 77, "r", 1)],
        [(30, " OP3 ", None, "r", 1), (31, None, 4, "r", 1), (77, None, None, "r", 1)],
        [(40, "op3", None, "r", 1), (41, "new", None, "r", 1)],
    ]
    root, seen = str(tmp_path / "state"), []
    for rows in batches:
        state = S.update_splits(spark.createDataFrame(rows, SHAPE), "e", ["op"], "p", "repo", "w", shares, S.read_state(spark, root))
        seen.append({r["node"]: r for r in S.write_state(state, root).nodes.collect()})
    last = seen[-1]
    assert len(last) == 27 and (last[30]["component"], last[40]["component"], last[31]["component"]) == (3, 3, 4)
    assert last[40]["split"] == last[30]["split"] == seen[0][3]["split"] and last[40]["status"] == "kept"
    assert last[41]["status"] == "new" and {last[20]["component"], last[21]["component"], last[77]["component"]} == {20}
    assert seen[0][20]["component"] != seen[0][21]["component"]  # a parent that is no record links nothing
    train, test = (next(n for n in range(20) if seen[0][n]["split"] == s and n not in (3, 4)) for s in ("train", "test"))
    for more in ([(50, f"op{train}", test, "r", 1)], [(51, f"op{test}", None, "r", 1)]):  # a conflict, and a run after it
        state = S.write_state(S.update_splits(spark.createDataFrame(more, SHAPE), "e", ["op"], "p", "repo", "w", shares, S.read_state(spark, root)), root)
    got = {r["node"]: r for r in state.nodes.collect()}
    apart = {n for n, r in last.items() if r["split"] == S.QUARANTINE}  # perhaps 20, 21 and 77, which met in the second run
    assert {n for n, r in got.items() if r["split"] == S.QUARANTINE} == {train, test, 50, 51} | apart and apart <= {20, 21, 77}
    assert all(got[n]["split"] == r["split"] for n, r in last.items() if n not in (train, test))


def test_forest_in_small_chunks(spark):
    edges = [(i, i - 1) for i in range(1, 60)] + [(i, 100) for i in range(101, 140)] + [(150, 30), (150, 120)]
    df = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in edges], "u bigint, v bigint")
    for chunk in (1, 7, 1000):
        stars = S._contract(df, chunk)
        assert {r["component"] for r in S.components(stars).collect()} == {0}
