"""Typed views: the few fields go to the cells, not the cells of a field to one task."""

from itemloom.model import Field, FieldType
from itemloom.operators import views
from itemloom.sources.narrow import fields_frame


def test_cells_are_not_moved_to_their_fields(spark):
    fields = fields_frame(spark, [Field(1, "a", FieldType.NOMINAL), Field(2, "b", FieldType.NUMERIC)])
    cells = spark.range(100).selectExpr("id", "int(id % 2 + 1) AS field", "string(id) AS value_nominal", "if(id < 50, double(id), null) AS value_numeric")
    shown = views.typed_instances(cells, fields)
    assert "hashpartitioning" not in shown._jdf.queryExecution().executedPlan().toString()
    found = {r.id: r.value_numeric for r in shown.collect()}
    assert found == {i: (float(i) if i % 2 else None) for i in range(100) if i % 2 == 0 or i < 50}
    values = cells.selectExpr("field", "value_nominal", "value_numeric", "1L AS frequency")
    page = views.values_page(values, fields, 2, 0, 10)
    assert "hashpartitioning" not in page._jdf.queryExecution().executedPlan().toString()
    assert [r.value_nominal for r in page.collect()] == [str(i) for i in range(1, 20, 2)]
