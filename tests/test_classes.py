"""Classes of facts: texts are taken apart once."""

from sediment.operators import consolidate

FACTS = [(1, "never red green blue boxes"), (2, "Blue boxes: red, green! never"), (3, "keep red green blue boxes"), (4, "too short"), (5, None), (6, "boxes blue green red keep"), (7, "never red green blue boxes")]


def test_fact_classes_read_texts_once(spark):
    facts = spark.createDataFrame(FACTS, "id long, text string").repartition(2)
    told = consolidate._told(facts)._jdf.queryExecution().executedPlan().toString()
    assert told.count("regexp_extract_all(") == 1
    got = consolidate.fact_classes(facts)
    assert "regexp_extract_all(" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["class_id"], r["n_facts"]) for r in got.collect()) == [(1, 1, 3), (2, 1, 3), (3, 3, 2), (6, 3, 2), (7, 1, 3)]
