from rostrum.operators import validation


def test_only_single_choice_groups_are_counted(spark):
    rows = [(1, "F", "A"), (1, "F", "R"), (1, "O", "A"), (1, "O", "R"), (2, "F", "A"), (2, "F", "x"), (3, None, "A"), (4, None, "A"), (4, None, "R")]
    tags, known = spark.createDataFrame(rows, "arg long, grp string, tag string"), spark.createDataFrame([("A",), ("R",)], "tag string")
    got = validation.valid_tags(tags, known, ["F"])
    assert {tuple(r) for r in got.collect()} == {(1, "O", "A"), (1, "O", "R"), (2, "F", "A"), (3, None, "A")} and got.count() == 4
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
