"""Values that are long only by what the normal form leaves out."""

import pytest

from corpusloom.llm import linking as L


@pytest.mark.parametrize("filling", [" " * 5000, " ." * 3000, "\t-\n" * 2000])
def test_padding_inside_is_read(spark, filling):
    values = spark.createDataFrame([(f"fistula{filling}formation",), ("word " * 2000,)], "label string")
    reference = spark.createDataFrame([(7, "fistula formation"), (8, "bone defect")], "id long, concept string")
    found = {r["label"]: r["ref_id"] for r in L.link_values(values, reference, value="label", entry="concept", entry_id="id").collect()}
    assert found == {f"fistula{filling}formation": 7, "word " * 2000: None}
