from rostrum.plans import registry  # noqa: F401  (loads all plans)
from rostrum.plans import files


def test_arguments_are_nested_once_for_all_perspectives(spark, sf, monkeypatch):
    seen, write = [], files.sinks.write_partitioned_json
    monkeypatch.setattr(files.sinks, "write_partitioned_json", lambda df, *a: seen.append(df) or write(df, *a))
    assert files.k02_fan_out(spark, sf).count() == 6
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
